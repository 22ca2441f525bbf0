"""From raw documents to token ids: quality rules, line de-duplication, near-duplicates, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``.  SQL cannot express near-duplicate components or BPE, so there is no ``ORACLE_SQL``; the
stages are tested against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strata.llm.bpe import stage_byte_bpe
from strata.llm.common import shared_dir, table
from strata.llm.decontamination import stage_decontamination
from strata.llm.line_dedup import stage_line_dedup
from strata.llm.quality_rules import stage_quality_rules
from strata.llm.simhash import stage_simhash

STAGES = [
    ("quality_rules", stage_quality_rules),
    ("line_dedup", stage_line_dedup),
    ("simhash", stage_simhash),
    ("decontamination", stage_decontamination),
    ("byte_bpe", stage_byte_bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; intermediate tables go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
