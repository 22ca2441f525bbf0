"""Ordering and top-k over issues: search, top issues, representative sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.positions import positions

# FIXED VALUES: display order (most severe first) used by report and prompts
DISPLAY_ORDER = ["blocker", "critical", "high", "medium", "low", "info", "trace"]


def display_rank(sev, unknown: int) -> F.Column:
    """blocker 0 .. trace 6; unknown names get ``unknown`` (4 in the UI and prompts, 99 in the report)."""
    s = F.col(sev) if isinstance(sev, str) else sev
    out = F.lit(unknown)
    for i, name in reversed(list(enumerate(DISPLAY_ORDER))):
        out = F.when(s == name, F.lit(i)).otherwise(out)
    return out


ISSUE_ORDER = ["file_path", "line_number", "rule_id"]


def search_issues(issues: DataFrame, query: str = "", severity: str = "all", unknown_rank: int = 4) -> DataFrame:
    """Severity filter plus case-insensitive substring over path, message, family, rule.

    ``position`` orders the result by display rank (unknown 4), then issue order.
    """
    out = issues
    if severity != "all":
        out = out.filter(F.col("severity") == severity)
    if query:
        q = query.lower()
        cond = None
        for c in ("file_path", "message", "defect_family", "rule_id"):
            hit = F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q)
            cond = hit if cond is None else cond | hit
        out = out.filter(cond)
    # numbered by range partitions: a repository holding most issues is numbered by many tasks
    rank = display_rank(F.coalesce("severity", F.lit("")), unknown_rank)  # 4 dashboard, 9 single-file panel
    return positions(out, ["repo_id"], [rank.asc(), *[F.col(c) for c in ISSUE_ORDER]])


def top_issues(issues: DataFrame, top: int = 100) -> DataFrame:
    """Report table: first ``top`` issues by severity (unknown 99, missing = info)
    and the count left over.  ``row_number() <= top`` becomes a per-partition
    group limit before the shuffle."""
    sev = F.coalesce(F.col("severity"), F.lit("info"))
    w = Window.partitionBy("repo_id")
    ranked = issues.withColumn("rank", F.row_number().over(w.orderBy(display_rank(sev, 99), *ISSUE_ORDER)).cast("long"))
    kept = ranked.filter(F.col("rank") <= top)
    totals = issues.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_n"))
    return kept.join(totals, "repo_id").withColumn(
        "remaining", F.greatest(F.col("_n") - top, F.lit(0))).drop("_n")


def representative_issues(issues: DataFrame, limit: int = 18, message_chars: int = 180) -> DataFrame:
    """Severity-sorted, de-duplicated sample for the summary prompt.

    Sort: display rank (unknown 4), family, file, line; one issue per
    (family, file, line, message); the first ``limit`` per repository.  An absent
    family sorts as blank and is emitted as ``unknown``.
    """
    fam = F.coalesce(F.col("defect_family"), F.lit(""))
    line = F.coalesce(F.col("line_number"), F.lit(0))
    msg = F.coalesce(F.col("message"), F.lit(""))
    keyed = issues.select(
        "repo_id", display_rank(F.coalesce("severity", F.lit("info")), 4).alias("_rank"),
        fam.alias("family"), F.coalesce("file_path", F.lit("")).alias("file"), line.alias("line"),
        F.coalesce("defect_family", F.lit("unknown")).alias("_shown"),
        msg.alias("_msg"), F.coalesce("severity", F.lit("low")).alias("severity"),
        F.coalesce("rule_id", F.lit("")).alias("rule_id"))
    order = [F.col("_rank"), F.col("family"), F.col("file"), F.col("line"), F.col("rule_id"), F.col("_msg")]
    first = keyed.withColumn("_k", F.row_number().over(
        Window.partitionBy("repo_id", "family", "file", "line", "_msg").orderBy(*order))).filter("_k = 1")
    w = Window.partitionBy("repo_id").orderBy(*order)
    return (first.withColumn("position", F.row_number().over(w).cast("long")).filter(F.col("position") <= limit)
            .select("repo_id", "position", "file", "line", "severity", F.col("_shown").alias("family"), "rule_id",
                    F.substring("_msg", 1, message_chars).alias("message")))
