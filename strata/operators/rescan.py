"""Incremental re-analysis: latest analysis, re-scan decision, changed files, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUNNING = ["queued", "cloning", "analyzing"]


def latest_analysis(analyses: DataFrame, statuses=None) -> DataFrame:
    """Newest analysis per (repo_url, project_id); a null project is its own group.
    ``row_number() = 1`` lets Spark cut each group to one row before the shuffle."""
    df = analyses if statuses is None else analyses.filter(F.col("status").isin(*statuses))
    w = Window.partitionBy("repo_url", "project_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def rescan_decision(requests: DataFrame, analyses: DataFrame) -> DataFrame:
    """Per request ``(request_id, repo_url, project_id, user_known, force, remote_head)``:
    ``running`` when one is in flight; ``reuse`` of the latest complete analysis
    for anonymous callers, or when the stored commit equals the remote head or
    the head is unknown; otherwise ``rescan``."""
    run = latest_analysis(analyses, RUNNING).select(
        "repo_url", "project_id", F.col("id").alias("running_id"))
    done = latest_analysis(analyses, ["complete"]).select(
        "repo_url", "project_id", F.col("id").alias("complete_id"), F.col("commit_sha").alias("stored_sha"))
    # null-safe keys: an anonymous request (null project) matches null-project analyses
    def nsjoin(left, right):
        r = right.withColumnRenamed("repo_url", "_ru").withColumnRenamed("project_id", "_pid")
        cond = (left["repo_url"] == r["_ru"]) & left["project_id"].eqNullSafe(r["_pid"])
        return left.join(r, cond, "left").drop("_ru", "_pid")
    j = nsjoin(nsjoin(requests, run), done)
    reuse_same = (F.col("stored_sha").isNotNull() & (F.col("remote_head").isNull()
                                                     | (F.col("remote_head") == F.col("stored_sha"))))
    decision = (F.when(F.col("running_id").isNotNull(), F.lit("running"))
                .when(~F.col("user_known") & F.col("complete_id").isNotNull(), F.lit("reuse"))
                .when(F.col("user_known") & F.col("complete_id").isNotNull() & ~F.col("force") & reuse_same, F.lit("reuse"))
                .otherwise(F.lit("rescan")))
    target = (F.when(decision == "running", F.col("running_id"))
              .when(decision == "reuse", F.col("complete_id")))
    return j.select(*requests.columns, decision.alias("decision"), target.alias("analysis_id"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths added, removed or modified between two snapshots (content hash compare).

    A full outer join on (repo, path) of two hashed projections; only the
    hashes cross the shuffle, not the content.
    """
    o = old.select("repo_id", "path", F.sha2(F.col("content"), 256).alias("_old"))
    n = new.select("repo_id", "path", F.sha2(F.col("content"), 256).alias("_new"))
    j = o.join(n, ["repo_id", "path"], "full_outer")
    status = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
              .when(F.col("_old") != F.col("_new"), "modified"))
    return j.select("repo_id", "path", status.alias("change")).filter(F.col("change").isNotNull())


def merge_rescan(old_issues: DataFrame, new_issues: DataFrame, changed: DataFrame) -> DataFrame:
    """Old issues of unchanged files plus the issues from re-scanning changed files."""
    touched = changed.select("repo_id", F.col("path").alias("file_path")).distinct()
    kept = old_issues.join(touched, ["repo_id", "file_path"], "left_anti")
    return kept.unionByName(new_issues, allowMissingColumns=True)
