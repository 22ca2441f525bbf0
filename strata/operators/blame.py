"""Blame: expansion to lines, issue attribution, origin tracing, author shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN_NAME = "Unknown"
UNKNOWN_EMAIL = "unknown@example.com"


def iso_utc(ts) -> F.Column:
    """UTC ISO-8601 to the second with an explicit ``+00:00`` offset."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def author_label(name, email) -> F.Column:
    """``Name <email>``, defaulting both halves."""
    n = F.coalesce(F.col(name), F.lit(UNKNOWN_NAME))
    e = F.coalesce(F.col(email), F.lit(UNKNOWN_EMAIL))
    return F.concat(n, F.lit(" <"), e, F.lit(">"))


def expand_blame(segments: DataFrame) -> DataFrame:
    """Per-file ordered segments -> one row per line with its running line number.

    The segment array is flattened inside the row (each line carries its
    segment's commit), so numbering needs neither a window nor a shuffle.
    """
    flat = F.flatten(F.transform("segments", lambda s: F.transform(
        s["lines"], lambda line: F.struct(
            s["commit"].alias("commit"), s["author_name"].alias("author_name"),
            s["author_email"].alias("author_email"), s["ts"].alias("ts"), line.alias("content")))))
    exploded = segments.select("repo_id", "file_path", F.posexplode(flat).alias("_pos", "_l"))
    return exploded.select(
        "repo_id", "file_path", (F.col("_pos") + 1).cast("int").alias("line_number"),
        F.coalesce(F.col("_l.author_name"), F.lit(UNKNOWN_NAME)).alias("author_name"),
        F.coalesce(F.col("_l.author_email"), F.lit(UNKNOWN_EMAIL)).alias("author_email"),
        F.col("_l.commit").alias("commit"), F.col("_l.ts").alias("ts"), F.col("_l.content").alias("content"))


def attribute_issues(issues: DataFrame, blame_lines: DataFrame) -> DataFrame:
    """issues LEFT JOIN blame on (repo, file, line); line <= 0 or unknown file -> nulls.

    Both sides are large and keyed by file, so this is a sort-merge join on
    (repo, file, line); AQE splits skewed files.
    """
    b = blame_lines.select(
        "repo_id", "file_path", "line_number",
        F.col("author_name").alias("origin_author_name"),
        F.col("author_email").alias("origin_author_email"),
        author_label("author_name", "author_email").alias("origin_author"),
        F.substring("commit", 1, 8).alias("origin_commit"),
        F.col("ts").alias("origin_ts"))
    keyed = issues.withColumn("_ln", F.when(F.col("line_number") > 0, F.col("line_number")))
    joined = keyed.join(b, (keyed.repo_id == b.repo_id) & (keyed.file_path == b.file_path)
                        & (keyed._ln == b.line_number), "left")
    return joined.select(*[keyed[c] for c in issues.columns],
                         "origin_author_name", "origin_author_email", "origin_author", "origin_commit",
                         iso_utc("origin_ts").alias("origin_date"), F.col("origin_ts"))


def trace_line_origin(requests: DataFrame, blame_lines: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, file, line) requests -> blamed commit -> commit detail and summary line."""
    b = blame_lines.select("repo_id", "file_path", "line_number", "commit", "author_name",
                           "author_email", F.col("ts").alias("blame_ts"))
    c = commits.select(F.col("commit"), F.col("author").alias("commit_author"), F.col("message"))
    out = requests.join(b, ["repo_id", "file_path", "line_number"]).join(c, "commit")
    return out.select(
        *requests.columns,
        F.substring("commit", 1, 8).alias("origin_commit"),
        author_label("author_name", "author_email").alias("origin_author"),
        iso_utc("blame_ts").alias("origin_date"),
        "commit_author",
        F.split(F.trim(F.col("message")), "\n").getItem(0).alias("summary"))


def pct_1dp(part, whole) -> F.Column:
    """round(part / whole * 100, 1) half-up on the exact ratio (integer arithmetic)."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.floor((part * 2000 + whole) / (whole * 2)) / 10.0


def blame_authors(blame_lines: DataFrame) -> DataFrame:
    """Per file and author: lines, distinct commits, share of the file (1 dp), rank.

    Rank is lines descending, ties by the author's first line (input order).
    """
    author = author_label("author_name", "author_email")
    per = blame_lines.groupBy("repo_id", "file_path", author.alias("author")).agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("commit").alias("commits"),
        F.min("line_number").alias("_first"))
    w = Window.partitionBy("repo_id", "file_path")
    per = per.withColumn("_total", F.sum("lines").over(w))
    return per.select(
        "repo_id", "file_path", "author", "lines", "commits",
        pct_1dp(F.col("lines"), F.greatest(F.col("_total"), F.lit(1))).alias("percentage"),
        F.row_number().over(w.orderBy(F.col("lines").desc(), F.col("_first"))).cast("long").alias("rank"))
