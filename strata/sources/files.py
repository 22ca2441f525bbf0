"""File-tree sources: landed file tables or raw files read with ``binaryFile``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import schemas as S
from strata.functions.languages import detect_language, is_binary
from strata.functions.paths import has_skipped_suffix, in_skipped_dir, is_hidden
from strata.functions.text import line_count, read_text_lossy


def _raw_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def oversized_files(spark: SparkSession, root: str, max_bytes: int = S.TREE_MAX_BYTES) -> DataFrame:
    """(path, size) of the files that ``read_repo_files`` leaves out, from the listing alone."""
    return (_raw_files(spark, root).filter(F.col("length") > max_bytes)
            .select("path", F.col("length").cast("long").alias("size")))


def read_repo_files(spark: SparkSession, root: str, repo_depth: int = 1,
                    max_bytes: int = S.TREE_MAX_BYTES) -> DataFrame:
    """Raw files under ``root/<repo>/...`` -> files table (repo_id, path, content, size).

    ``binaryFile`` lists and reads in parallel; content is decoded lossily.
    Files over ``max_bytes`` are left out on the listing's ``length`` before any
    bytes are decoded; ``oversized_files`` lists them.
    """
    raw = _raw_files(spark, root).filter(F.col("length") <= max_bytes)
    rel = F.regexp_replace(F.col("path"), "^.*?\\Q" + root.rstrip("/") + "\\E/", "")  # root quoted literally
    parts = F.split(rel, "/")
    repo = F.array_join(F.slice(parts, 1, repo_depth), "/")
    path = F.array_join(F.slice(parts, repo_depth + 1, 1 << 16), "/")
    return raw.select(repo.alias("repo_id"), path.alias("path"),
                      read_text_lossy(F.col("content").cast("string")).alias("content"),
                      F.col("length").cast("long").alias("size"))


def scan_file_tree(files: DataFrame, max_bytes: int = S.TREE_MAX_BYTES) -> DataFrame:
    """Prune skipped directories, skipped suffixes, dot-files and oversize files.

    Returns (repo_id, path, language, lines, size); order by (repo_id, path)
    at the sink if a sorted listing is wanted.
    """
    kept = files.filter(~in_skipped_dir("path") & ~has_skipped_suffix("path") & ~is_hidden("path")
                        & (F.col("size") <= max_bytes))
    if "language" not in kept.columns:
        kept = detect_language(kept)
    if "lines" not in kept.columns:
        kept = kept.withColumn("lines", line_count("content"))
    return kept.select("repo_id", "path", "language", "lines", "size")


def skip_dirs(files: DataFrame, dirs=None) -> DataFrame:
    return files.filter(~in_skipped_dir("path", dirs))


def skip_extensions_hidden(files: DataFrame) -> DataFrame:
    return files.filter(~has_skipped_suffix("path") & ~is_hidden("path"))


def size_limit(files: DataFrame, max_bytes: int = S.TREE_MAX_BYTES, min_bytes: int = 0) -> DataFrame:
    return files.filter((F.col("size") >= min_bytes) & (F.col("size") <= max_bytes))


def detect_binary(files: DataFrame) -> DataFrame:
    return files.withColumn("is_binary", is_binary("content"))


def repo_storage_size(files: DataFrame) -> DataFrame:
    """Bytes and MB (2 dp) per repository."""
    return files.groupBy("repo_id").agg(F.sum("size").cast("long").alias("bytes")).withColumn(
        "mb", mb_2dp(F.col("bytes")))


def mb_2dp(nbytes) -> F.Column:
    """bytes / 2^20 rounded half-up to 2 dp on the exact ratio (integer arithmetic)."""
    return F.floor((nbytes * 200 + 1048576) / (2 * 1048576)) / 100.0
