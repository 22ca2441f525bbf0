"""Commit history: log parsing, timelines, evolution chains, issues per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.blame import iso_utc
from strata.operators.positions import null_safe_join

# A header line: 40 characters without '|', then at least three '|' in the line.
HEADER_RE = r"^[^|\n]{40}\|[^\n]*\|[^\n]*\|"
# Log lines numbered together by one task.
LOG_BLOCK = 100_000

REFACTOR_WORDS = ["refactor", "rename", "move"]


def parse_commit_log(logs: DataFrame, keep_diff_lines: int = 15) -> DataFrame:
    """Log lines ``(repo_id, file_path, line_no, line)`` -> one row per commit, last N diff lines kept.

    Every line belongs to the last header at or before it.  Headers are counted per block of lines and
    block offsets added, so a file's history is split over tasks however long it is; one window per block, from its
    end, counts the headers after a line and the diff lines up to the next header, and only a commit's last N
    diff lines leave the block.  What moves on is a row for each commit and block.  ``seq`` is the commit's
    position in the log (newest first, from 0).
    """
    file = ["repo_id", "file_path"]
    lines = logs.select(*file, "line_no", "line", F.floor(F.col("line_no") / LOG_BLOCK).alias("_block"),
                        F.coalesce(F.col("line").rlike(HEADER_RE), F.lit(False)).alias("_head"))
    per_block = lines.groupBy(*file, "_block").agg(F.count_if("_head").alias("_n"))
    before = Window.partitionBy(*file).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(*file, "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.col("_n")).alias("_upto"))
    from_end = Window.partitionBy(*file, "_block").orderBy(F.col("line_no").desc())
    after, upto = from_end.rowsBetween(Window.unboundedPreceding, -1), from_end.rowsBetween(Window.unboundedPreceding, 0)
    is_diff = ~F.col("_head") & F.substring("line", 1, 1).isin("+", "-", " ")
    counted = lines.withColumn("_is_diff", F.coalesce(is_diff, F.lit(False))).select(
        "*", F.coalesce(F.sum(F.col("_head").cast("int")).over(after), F.lit(0)).alias("_after"),
        F.sum(F.col("_is_diff").cast("int")).over(upto).alias("_d"))
    last = F.coalesce(F.max(F.when(F.col("_head"), F.col("_d"))).over(after), F.lit(0))
    kept = counted.withColumn("_k", F.col("_d") - last).filter(F.col("_head") | F.col("_is_diff") & (F.col("_k") <= keep_diff_lines))
    diff_line = F.when(F.col("_is_diff"), F.struct("line_no", "line"))
    in_block = kept.groupBy(*file, "_block", "_after").agg(
        F.max(F.when(F.col("_head"), F.col("line"))).alias("line"), F.collect_list(diff_line).alias("_d"))
    commits = (null_safe_join(in_block, offsets, [*file, "_block"])
               .withColumn("seq", (F.col("_upto") - F.col("_after") - 1).cast("int")).filter("seq >= 0")
               .groupBy(*file, "seq").agg(F.max("line").alias("line"), F.sort_array(F.flatten(F.collect_list("_d"))).alias("_d")))
    parts = F.split("line", r"\|", -1)
    email = F.element_at(parts, 2)
    diff = F.slice("_d", F.greatest(F.size("_d") - keep_diff_lines + 1, F.lit(1)), keep_diff_lines)
    return commits.select(
        *file, "seq", F.element_at(parts, 1).alias("full_hash"), F.substring(F.element_at(parts, 1), 1, 8).alias("commit_hash"),
        F.when(email.contains("@"), F.concat(email, F.lit(" <"), email, F.lit(">"))).otherwise(email).alias("author"),
        F.trim(F.element_at(parts, 3)).alias("date"),
        F.trim(F.array_join(F.slice(parts, 4, 1 << 30), "|")).alias("message"),
        F.array_join(F.transform(diff, lambda x: x["line"]), "\n").alias("diff"))


def _at_least_one(n: int) -> int:
    """A caller's N is honoured whatever its size; what is no count is an error."""
    if int(n) < 1:
        raise ValueError(f"expected a positive number, not {n}")
    return int(n)


def _newest(commits: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` commits per file.  ``row_number() <= n`` lets Spark apply a
    per-partition group limit before the shuffle, so a hot file sends at most
    ``n`` rows per map task."""
    w = Window.partitionBy("repo_id", "file_path").orderBy(F.col("ts").desc(), F.col("commit").desc())
    return commits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)


def commit_timeline(commits: DataFrame, max_commits: int = 50) -> DataFrame:
    """Newest N commits of each file, numbered oldest first."""
    kept = _newest(commits, _at_least_one(max_commits))
    w = Window.partitionBy("repo_id", "file_path")
    return kept.select(
        "repo_id", "file_path",
        (F.count(F.lit(1)).over(w) - F.col("_rn") + 1).cast("int").alias("position"),
        F.substring("commit", 1, 8).alias("commit_hash"), "author", iso_utc("ts").alias("date"),
        F.split(F.trim("message"), "\n").getItem(0).alias("message"),
        "insertions", "deletions", (F.col("insertions") + F.col("deletions")).alias("lines_changed"))


def commit_timeline_meta(commits: DataFrame, max_commits: int = 50) -> DataFrame:
    """Commits kept, distinct authors, first and last date over the kept rows."""
    kept = _newest(commits, _at_least_one(max_commits))
    return kept.groupBy("repo_id", "file_path").agg(
        F.count(F.lit(1)).alias("total_commits"), F.countDistinct("author").alias("total_authors"),
        iso_utc(F.min("ts")).alias("first_commit"), iso_utc(F.max("ts")).alias("last_commit"))


def change_type(is_last: F.Column) -> F.Column:
    """introduction for the oldest kept row, refactor by the commit's ``message``, else modification."""
    msg = F.lower(F.coalesce(F.col("message"), F.lit("")))
    is_refactor = F.lit(False)
    for word in REFACTOR_WORDS:
        is_refactor = is_refactor | msg.contains(word)
    return F.when(is_last, F.lit("introduction")).when(is_refactor, F.lit("refactor")).otherwise(F.lit("modification"))


def evolution_chain(commits: DataFrame, max_commits: int = 20) -> DataFrame:
    """History of a file newest first (at most 20): the oldest kept row is the introduction;
    a message containing refactor / rename / move (so also 'remove') is a refactor."""
    kept = _newest(commits, max_commits)
    w = Window.partitionBy("repo_id", "file_path")
    kind = change_type(F.col("_rn") == F.max("_rn").over(w))
    return kept.select("repo_id", "file_path", F.col("_rn").cast("int").alias("step"),
                       F.substring("commit", 1, 8).alias("commit_hash"), "author",
                       F.split(F.trim("message"), "\n").getItem(0).alias("message"), kind.alias("change_type"))


def issues_per_day(attributed: DataFrame) -> DataFrame:
    """Issues by UTC day of their origin date; issues without one are skipped."""
    return (attributed.filter(F.col("origin_ts").isNotNull())
            .groupBy("repo_id", F.to_date("origin_ts").alias("day")).agg(F.count(F.lit(1)).alias("issues")))
