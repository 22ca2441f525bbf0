"""JSON-text columns: lenient decode on read, report documents on write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import rollups as RU

# Logical types of the analysis record's JSON-text columns
JSON_COLUMNS = {
    "languages": "map<string,bigint>",
    "contributor_stats": "map<string,struct<name:string,email:string,count:bigint>>",
    "issues": "array<map<string,string>>",
    "file_tree": "array<map<string,string>>",
}


def decode_json_column(col, ddl: str):
    """``from_json`` in PERMISSIVE mode; NULL or malformed text -> empty collection."""
    parsed = F.from_json(F.col(col) if isinstance(col, str) else col, ddl, {"mode": "PERMISSIVE"})
    empty = F.create_map().cast(ddl) if ddl.startswith("map") else F.array().cast(ddl)
    return F.coalesce(parsed, empty)


def decode_analysis_json(analyses: DataFrame, columns: dict | None = None) -> DataFrame:
    cols = JSON_COLUMNS if columns is None else columns
    out = analyses
    for name, ddl in cols.items():
        if name in out.columns:
            out = out.withColumn(name, decode_json_column(name, ddl))
    return out


def encode_json_columns(df: DataFrame, columns) -> DataFrame:
    """Sink side: collections back to JSON text."""
    out = df
    for name in columns:
        out = out.withColumn(name, F.to_json(F.col(name)))
    return out


# FIXED VALUE: the severities that a report always lists, in its order
REPORT_SEVERITIES = ["blocker", "critical", "high", "medium", "low", "info", "trace"]


def completed_reports(analyses: DataFrame, issues: DataFrame, files: DataFrame) -> DataFrame:
    """One row per completed analysis: metadata and summary of its report.

    ``analyses(id, repo_id, repo_url, status, created_at, completed_at)``; an analysis that is not complete
    has no report.  ``severity_summary`` lists the seven known severities (zero if none) and every other
    name found; an issue without a severity counts as ``info``.  ``issues`` are read twice (pass a landed
    table), ``files`` once.
    """
    hs = RU.health_score(issues, analyses.select("repo_id"))
    named = issues.groupBy("repo_id", F.coalesce("severity", F.lit("info")).alias("_sev")).agg(F.count(F.lit(1)).alias("_n"))
    listed = F.array(*map(F.lit, REPORT_SEVERITIES))
    counts = named.groupBy("repo_id").agg(  # one entry per severity name
        F.map_from_entries(F.collect_list(F.struct("_sev", "_n"))).alias("_counts"))
    found = F.coalesce("_counts", F.create_map().cast("map<string,bigint>"))
    known = F.transform(listed, lambda s: F.struct(s.alias("severity"), F.coalesce(F.element_at(found, s), F.lit(0).cast("long")).alias("count")))
    others = F.array_sort(F.filter(F.transform(F.map_entries(found), lambda e: F.struct(
        e["key"].alias("severity"), e["value"].alias("count"))), lambda e: ~F.array_contains(listed, e["severity"])))
    totals = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_files"), F.sum("lines").cast("long").alias("total_lines"))
    done = analyses.filter(F.col("status") == "complete").select(
        F.col("id").alias("analysis_id"), "repo_id", F.col("repo_url").alias("repository"),
        F.coalesce("completed_at", "created_at").alias("analyzed_at"))
    return (done.join(hs, "repo_id", "left").join(counts, "repo_id", "left").join(totals, "repo_id", "left")
            .select("analysis_id", "repo_id", "repository", "analyzed_at",
                    F.coalesce("health_score", F.lit(0)).alias("health_score"),
                    F.coalesce("total_files", F.lit(0)).alias("total_files"), F.coalesce("total_lines", F.lit(0)).alias("total_lines"),
                    F.coalesce("total_issues", F.lit(0)).alias("total_issues"),
                    F.concat(known, others).alias("severity_summary")))


def report_contributors(analyses: DataFrame, issues: DataFrame) -> DataFrame:
    """Every contributor of each completed analysis, one row each: analysis_id, email, name, count."""
    done = analyses.filter(F.col("status") == "complete").select(F.col("id").alias("analysis_id"), "repo_id")
    return RU.contributor_stats(issues).join(done, "repo_id").select("analysis_id", "repo_id", "email", "name", "count")


def export_report_json(analyses: DataFrame, issues: DataFrame, files: DataFrame, path: str) -> None:
    """Reports of the completed analyses as JSON lines partitioned by repository: ``summary`` (one document
    per analysis: metadata and summary), ``contributors`` (all; the counts are the report's user statistics),
    ``issues`` and ``file_tree``.  The unbounded lists are rows, not one nested document."""
    doc = F.struct(F.struct("repository", "analysis_id", F.date_format("analyzed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("analyzed_at"))
                   .alias("metadata"),
                   F.struct("health_score", "total_files", "total_lines", "total_issues", F.map_from_entries("severity_summary")
                            .alias("severity_summary")).alias("summary"))
    done = analyses.filter(F.col("status") == "complete").select("repo_id").distinct()
    completed_reports(analyses, issues, files).select("repo_id", F.to_json(doc).alias("report")) \
        .write.mode("overwrite").partitionBy("repo_id").text(f"{path}/summary")
    report_contributors(analyses, issues).write.mode("overwrite").partitionBy("repo_id").json(f"{path}/contributors")
    issues.join(done, "repo_id", "left_semi").write.mode("overwrite").partitionBy("repo_id").json(f"{path}/issues")
    files.drop("content").join(done, "repo_id", "left_semi").write.mode("overwrite").partitionBy("repo_id").json(f"{path}/file_tree")
