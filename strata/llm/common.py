"""Helpers shared by the training-data operators."""

from __future__ import annotations

import base64
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the decontamination and licence contracts, in lower-cased text: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ said
#: positively, which Java matches several times faster.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once (an optimiser may inline plain columns into lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def upto(n: Column) -> Column:
    """[0, 1, ..., n-1]; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; an empty array for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def row_key(text: str = "text") -> Column:
    """What a document is besides its doc_id, so that a repeated doc_id with another text is another document."""
    return F.xxhash64(F.col(text))


def nested(docs: DataFrame) -> DataFrame:
    """row (the caller's columns), id, key, text: no name of the caller's can meet one of ours."""
    return docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").alias("id"), row_key().alias("key"), F.col("text").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without one gets a temporary folder; a cluster session without one is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="strata-llm-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages read the shared folder and need no lost executor's files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Most rows and bytes of an Arrow batch between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def land(df: DataFrame, path: str) -> DataFrame:
    """A written table: lineage ends there, and the shuffle files that made it are freed at once."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input for a task of a written phase.
PHASE_BYTES = 32 << 20


def sized(df: DataFrame) -> DataFrame:
    """Small input partitions read together: a phase that is written leaves a file for every task.

    Tasks stay several times the cores, and no partition is split or moved.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    return df.coalesce(max(3 * spark.sparkContext.defaultParallelism, min(size // PHASE_BYTES + 1, 1 << 30)))


def ship(spark: SparkSession) -> None:
    """Send this library to the Python workers (as ``spark-submit --py-files`` would), once per application,
    and bound the session's Arrow batches."""
    # texts are long: batches that go to Python and back are bounded by bytes, not by the default ten thousand rows
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch",
                   min(BATCH_ROWS, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_strata_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = os.path.join(tempfile.mkdtemp(prefix="strata-py-"), "strata.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "strata").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(archive)
    sc._strata_shipped = True


def map_columns(df: DataFrame, columns: Iterable[str], schema: str, fn: Callable[[Iterator[list]], Iterator[list]],
                rows: int = 256) -> DataFrame:
    """``fn`` gets slices of at most ``rows`` rows as lists, one per column, and yields lists for ``schema``.

    Runs in Arrow batches inside Spark's own partitions; no row is moved.
    """
    ship(df.sparkSession)
    columns = list(columns)
    arrow = _arrow_schema(df.sparkSession, schema)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield [part.column(c).to_pylist() for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(slices(batches)):
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type)
                                               for v, f in zip(out, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def vocabulary(name: str, path: str | None = None) -> str:
    """Place of a public vocabulary file; ``path`` overrides it."""
    return path or public_tokenizers.path(name)


@lru_cache(maxsize=4)
def ranks_encoding(path: str):
    """The byte-level BPE of a rank file (one per Python worker)."""
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def piece_model(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def json_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)
