"""Summary texts in segments, and issues in parts, against the whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import rollups as RU
from strata.streaming import progress as PG
from strata.streaming import rope as RP

SCHEMA = "analysis_id string, seq long, kind string, text string, outcome string"


def events(rng, n):
    kinds = ["chunk"] * 12 + ["start", "summary", "unavailable", "failed", "complete"]
    return [(rng.choice(["a", "b", "c", None]), i, rng.choice(kinds), rng.choice([None, "", "x", "é" * rng.randint(1, 30), "word \U0001F642 "]),
             rng.choice([None, None, "failed"])) for i in range(n)]


@pytest.mark.parametrize("seed,size", [(1, 7), (2, 64), (3, 1), (4, 100_000)])
def test_segments_are_the_text(spark, seed, size):
    df = spark.createDataFrame(events(random.Random(seed), 60 * seed), SCHEMA).repartition(5)
    whole = {r.analysis_id: r for r in PG.assemble_chunks(df).collect()}
    ropes = {}
    for r in sorted(RP.text_segments(df, size).collect(), key=lambda r: (r.analysis_id or "", r.segment)):
        mine = ropes.setdefault(r.analysis_id, [])
        assert r.segment == len(mine) and r.offset == size * r.segment and r.length == len(r.text) <= size
        mine.append(r.text)
    for analysis, r in whole.items():
        assert "".join(ropes.get(analysis, [])) == r.summary
        assert all(len(t) == size for t in ropes.get(analysis, [""])[:-1])
    states = {r.analysis_id: r for r in RP.chunk_states(df).collect()}
    assert {k: (r.chars, r.chunks, r.status, r.progress) for k, r in states.items()} == {
        k: (len(r.summary), r.chunks, r.status, r.progress) for k, r in whole.items()}


def test_a_long_analysis_is_many_rows(spark):
    """200,000 chunks of one analysis: no row holds more than a segment."""
    df = spark.range(200_000, numPartitions=8).select(F.lit("a").alias("analysis_id"), F.col("id").alias("seq"), F.lit("chunk").alias("kind"),
                                                      F.concat(F.lit("chunk "), F.col("id").cast("string"), F.lit(";")).alias("text"))
    out = RP.text_segments(df, 4096).select("segment", "text").collect()
    assert max(len(r.text) for r in out) == 4096 and len(out) > 500
    assert "".join(r.text for r in sorted(out, key=lambda r: r.segment)) == "".join(f"chunk {i};" for i in range(200_000))


def test_parts_are_the_list(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["r", None]), rng.choice(["f", "g", None]), rng.randint(1, 40), rng.choice(["A", "B"]), "low") for _ in range(300)]
    issues = spark.createDataFrame(rows, "repo_id string, file_path string, line_number int, rule_id string, severity string").repartition(4)
    whole = {(r.repo_id, r.file_path): r.issues for r in RU.issues_by_file(issues).collect()}
    parts = {}
    for r in sorted(RU.issues_by_file_parts(issues, 9).collect(), key=lambda r: r.part):
        mine = parts.setdefault((r.repo_id, r.file_path), [])
        assert r.first == len(mine) + 1 and len(r.issues) <= 9
        mine += r.issues
    assert {k: [tuple(x) for x in v] for k, v in parts.items()} == {k: [tuple(x) for x in v] for k, v in whole.items()}
