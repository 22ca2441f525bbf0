"""Repository roll-ups: health, severity buckets, languages, contributors, directories.

All are keyed aggregations; Spark's partial (map-side) aggregation means a
repository holding a third of all findings still shuffles one row per map
task and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata import schemas as S
from strata.operators.blame import pct_1dp
from strata.functions.severity import health_grade, penalty, risk_label, severity_rank
from strata.operators.positions import null_safe_join, sequenced


def health_score(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """100 - sum(weight x 1.5 for high-impact families), truncated, clamped to 0..100.

    ``repos`` (one ``repo_id`` per row) brings in clean repositories at 100.
    """
    per_repo = findings.groupBy("repo_id").agg(
        F.sum(penalty("severity", "defect_family")).alias("_p"),
        F.count(F.lit(1)).alias("total_issues"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), (F.lit(100.0) - F.coalesce("_p", F.lit(0.0))).cast("int")))
    if repos is not None:
        per_repo = repos.select("repo_id").distinct().join(per_repo, "repo_id", "left")
    return per_repo.select("repo_id", score.alias("health_score"),
                           F.coalesce("total_issues", F.lit(0)).cast("long").alias("total_issues"))


def severity_summary(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Seven fixed buckets per repo; missing severity = medium; unknown names dropped.
    With ``repos``, repositories without findings get seven zero buckets."""
    sev = F.coalesce(F.col("severity"), F.lit("medium"))
    aggs = [F.count_if(sev == s).cast("long").alias(s) for s in reversed(S.SEVERITY_ORDER)]
    out = findings.groupBy("repo_id").agg(*aggs)
    if repos is None:
        return out
    j = repos.select("repo_id").distinct().join(out, "repo_id", "left")
    return j.select("repo_id", *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in reversed(S.SEVERITY_ORDER)])


def severity_breakdown_pct(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Per repository: all seven tiers (zero-filled) plus any unknown severity
    names as extra buckets; missing severity counts as ``info``.
    pct = int(count / max(total, 1) * 100) over all of the repository's issues.

    The seven-row domain is generated per repository with ``explode`` of a
    literal array (no cross join) and meets the counts in a keyed outer join.
    """
    sev = F.coalesce(F.col("severity"), F.lit("info"))
    counts = findings.groupBy("repo_id", sev.alias("severity")).agg(F.count(F.lit(1)).alias("count"))
    base = (repos.select("repo_id") if repos is not None else findings.select("repo_id")).distinct()
    domain = base.select("repo_id", F.explode(F.array(*[F.lit(x) for x in reversed(S.SEVERITY_ORDER)])).alias("severity"))
    full = domain.join(counts, ["repo_id", "severity"], "full_outer").withColumn(
        "count", F.coalesce("count", F.lit(0)).cast("long"))
    totals = counts.groupBy("repo_id").agg(F.sum("count").alias("_total"))
    j = full.join(totals, "repo_id", "left")
    total = F.greatest(F.coalesce(F.col("_total"), F.lit(0)), F.lit(1))
    return j.select("repo_id", "severity", "count", F.floor(F.col("count") / total * 100).cast("int").alias("pct"))


def language_stats(files: DataFrame) -> DataFrame:
    """Files per language, plaintext left out."""
    return (files.filter(F.col("language") != "plaintext")
            .groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("file_count")))


def total_lines(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(
        F.sum("lines").cast("long").alias("total_lines"), F.count(F.lit(1)).alias("file_count"))


def attach_issue_counts(files: DataFrame, issues: DataFrame) -> DataFrame:
    counts = issues.groupBy("repo_id", F.col("file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("issue_count"))
    return (files.join(counts, ["repo_id", "path"], "left")
            .withColumn("issue_count", F.coalesce("issue_count", F.lit(0)).cast("long")))


def contributor_stats(issues: DataFrame, order_cols=("file_path", "line_number", "rule_id")) -> DataFrame:
    """Issues per author e-mail; the name is the first seen in issue order."""
    email = F.coalesce(F.col("origin_author_email"), F.lit("unknown@example.com"))
    name = F.coalesce(F.col("origin_author_name"), F.lit("Unknown"))
    order = F.struct(*[F.col(c) for c in order_cols])
    return issues.groupBy("repo_id", email.alias("email")).agg(
        F.min_by(name, order).alias("name"), F.count(F.lit(1)).alias("count"))


def contributor_fallback(issues: DataFrame, top: int = 10) -> DataFrame:
    """Older records: email <- legacy author string, name <- text before '<'; top 10."""
    author = F.col("origin_author")
    given_email = F.when(F.coalesce(F.col("origin_author_email"), F.lit("")) != "", F.col("origin_author_email"))
    email = F.coalesce(given_email, author, F.lit("Unknown"))
    given_name = F.when(F.coalesce(F.col("origin_author_name"), F.lit("")) != "", F.col("origin_author_name"))
    # (name or text before '<') when the e-mail field holds a '<', else the e-mail itself
    name = F.when(email.contains("<"), F.coalesce(given_name, F.trim(F.substring_index(email, "<", 1)))).otherwise(email)
    order = F.struct("file_path", "line_number", "rule_id")
    agg = issues.groupBy("repo_id", email.alias("email")).agg(
        F.min_by(name, order).alias("name"), F.count(F.lit(1)).alias("count"),
        F.min(order).alias("_first"))
    w = Window.partitionBy("repo_id").orderBy(F.col("count").desc(), F.col("_first"))
    return agg.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top).drop("_first")


def _family(col="defect_family"):
    """Missing or empty family -> ``unknown`` (whitespace is kept, as in the source)."""
    return F.when(F.coalesce(F.col(col), F.lit("")) == "", F.lit("unknown")).otherwise(F.col(col))


def _first_seen():
    """Position of an issue in the report's severity-sorted list (ties: issue order)."""
    from strata.operators.ranking import display_rank
    return F.struct(display_rank(F.coalesce(F.col("severity"), F.lit("info")), 99).alias("_sr"),
                    F.col("file_path"), F.col("line_number"), F.col("rule_id"))


def family_hotspots(findings: DataFrame, top: int = 8) -> DataFrame:
    """Top families per repo with integer percentage of all issues; ties go to the
    family seen first in the severity-sorted issue list."""
    counts = findings.groupBy("repo_id", _family().alias("family")).agg(
        F.count(F.lit(1)).alias("count"), F.min(_first_seen()).alias("_first"))
    w = Window.partitionBy("repo_id")
    ranked = counts.withColumn("_total", F.sum("count").over(w)).withColumn(
        "rank", F.row_number().over(w.orderBy(F.col("count").desc(), F.col("_first"))).cast("long"))
    return ranked.filter(F.col("rank") <= top).select(
        "repo_id", "family", "count",
        F.floor(F.col("count") / F.greatest(F.col("_total"), F.lit(1)) * 100).cast("int").alias("pct"), "rank")


def top_counts(df: DataFrame, key: str, value: str, k: int, order_col: str) -> DataFrame:
    """Top-k values of a column per key; trimmed, blanks skipped, ties by first appearance."""
    v = F.trim(F.col(value).cast("string"))
    counts = (df.filter(v.isNotNull() & (v != "")).groupBy(key, v.alias("value"))
              .agg(F.count(F.lit(1)).alias("count"), F.min(order_col).alias("_first")))
    w = Window.partitionBy(key).orderBy(F.col("count").desc(), F.col("_first"))
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).drop("_first")


def issues_by_file(issues: DataFrame) -> DataFrame:
    """Per file: count, worst severity and the sorted list of issue lines."""
    return issues.groupBy("repo_id", "file_path").agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.max(severity_rank("severity", unknown=-1)).alias("max_rank"),
        F.sort_array(F.collect_list(F.struct("line_number", "rule_id"))).alias("issues"))


def issues_by_file_parts(issues: DataFrame, part_size: int = 1000) -> DataFrame:
    """The issues of each file in parts of ``part_size``, in the order of ``issues_by_file``'s list: a file with any
    number of issues is rows of bounded size, numbered by many tasks."""
    placed = sequenced(issues.select("repo_id", "file_path", "line_number", "rule_id"), ["repo_id", "file_path"],
                       [F.col("line_number"), F.col("rule_id")], "_at")
    part = F.floor((F.col("_at") - 1) / part_size).alias("part")
    return placed.groupBy("repo_id", "file_path", part).agg(
        F.min("_at").alias("first"), F.sort_array(F.collect_list(F.struct("_at", "line_number", "rule_id"))).alias("_l")).select(
        "repo_id", "file_path", "part", "first", F.transform("_l", lambda x: F.struct(x["line_number"], x["rule_id"])).alias("issues"))


def _common(a: F.Column, b: F.Column) -> F.Column:
    """How many leading elements two arrays share; 0 if one is missing."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(a.isNull() | b.isNull(), 0).when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


def directory_rollup(files_with_counts: DataFrame) -> DataFrame:
    """Every directory prefix -> issues in its subtree and file count.

    In the order of their path parts the files of a subtree stand together, so a directory is an interval: it begins at
    the file that does not share it with the file before, and ends at the one that does not share it with the
    next.  With running totals along the order (``sequenced``, no task holds a whole repository) its sums are
    differences of two totals.  A file writes a row only for directories that begin or end with it.
    """
    parts = F.split("path", "/")
    files = files_with_counts.filter("path IS NOT NULL").select(
        "repo_id", "path", F.coalesce("issue_count", F.lit(0)).cast("long").alias("issue_count"),
        F.slice(parts, 1, F.size(parts) - 1).alias("dirs"))
    placed = sequenced(files, ["repo_id"], [F.split("path", "/")], "_at", {"_issues": F.col("issue_count")}, ("dirs",))

    def edges(neighbour: str, **columns: F.Column) -> DataFrame:
        shared = _common(F.col("dirs"), F.col(neighbour))
        depth = F.explode(F.sequence(shared + 1, F.size("dirs")))
        own = placed.filter(shared < F.size("dirs")).withColumns(columns)
        return own.select("repo_id", "dirs", *columns, depth.alias("_k")).select(
            "repo_id", F.array_join(F.slice("dirs", 1, F.col("_k")), "/").alias("directory"), *columns)

    begins = edges("previous_dirs", _from=F.col("_at"), _before=F.col("_issues") - F.col("issue_count"))
    ends = edges("next_dirs", _to=F.col("_at"), _upto=F.col("_issues"))
    return null_safe_join(begins, ends, ["repo_id", "directory"]).select(
        "repo_id", "directory", (F.col("_upto") - F.col("_before")).cast("long").alias("issue_count"),
        (F.col("_to") - F.col("_from") + 1).cast("long").alias("file_count"))


def executive_summary(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Score, grade, totals, risk label, top family and top three languages per repo.

    One pass over each input: findings are pre-aggregated per (repo, family)
    and files per (repo, language); score, severity buckets, top family and top
    languages are then rolled up from those small tables, so neither input is
    scanned more than once however many figures the summary carries.
    """
    sev = F.coalesce(F.col("severity"), F.lit("medium"))
    per_fam = findings.groupBy("repo_id", _family().alias("family")).agg(
        F.sum(penalty("severity", "defect_family")).alias("_p"), F.count(F.lit(1)).alias("_n"),
        F.min(_first_seen()).alias("_first"),
        *[F.count_if(sev == s).alias(s) for s in S.SEVERITY_ORDER])
    # one window pass over the small per-family table gives repo totals and the top family
    wr = Window.partitionBy("repo_id")
    wf = wr.orderBy(F.col("_n").desc(), F.col("_first"))
    fam_side = (per_fam.select(
        "repo_id", F.col("family").alias("top_family"), F.sum("_p").over(wr).alias("_p"),
        F.sum("_n").over(wr).alias("total_issues"), *[F.sum(s).over(wr).alias(s) for s in S.SEVERITY_ORDER],
        F.row_number().over(wf).alias("_r")).filter("_r = 1").drop("_r"))
    # files: per (repo, language) counts, then one grouped pass for totals and the top three
    per_lang = files.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("_files"),
                                                       F.sum("lines").alias("_lines"))
    wl = Window.partitionBy("repo_id").orderBy(
        (F.col("language") == "plaintext").asc(), F.col("_files").desc(), F.col("language"))
    ranked = per_lang.withColumn("_r", F.row_number().over(wl))
    top = F.when((F.col("_r") <= 3) & (F.col("language") != "plaintext"), F.struct("_r", "language"))
    file_side = ranked.groupBy("repo_id").agg(  # the collect keeps at most three rows per repository
        F.sum("_files").alias("file_count"), F.sum("_lines").cast("long").alias("total_lines"),
        F.array_join(F.transform(F.sort_array(F.collect_list(top)), lambda x: x["language"]), ",").alias("top_languages"))
    out = file_side.join(fam_side, "repo_id", "left")
    score = F.greatest(F.lit(0), F.least(F.lit(100), (F.lit(100.0) - F.coalesce("_p", F.lit(0.0))).cast("int")))
    z = {s: F.coalesce(F.col(s), F.lit(0)) for s in S.SEVERITY_ORDER}
    return out.select(
        "repo_id", score.alias("health_score"), health_grade(score).alias("grade"),
        F.coalesce("total_issues", F.lit(0)).cast("long").alias("total_issues"),
        "file_count", "total_lines",
        risk_label(z["blocker"], z["critical"], z["high"], z["medium"]).alias("risk"),
        F.coalesce("top_family", F.lit("none")).alias("top_family"),
        F.coalesce("top_languages", F.lit("")).alias("top_languages"))
