"""Membership and administration tables over users, projects, memberships, analyses.

Every per-project or per-user figure is a keyed aggregate or a join; nested
collaborator lists are kept as the flat membership table rather than
collected into one row per project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.positions import positions
from strata.operators.rescan import latest_analysis  # noqa: F401  (re-exported)

HEALTHY_SCORE = 80


def _latest_per_project(analyses: DataFrame) -> DataFrame:
    w = Window.partitionBy("project_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return (analyses.filter(F.col("project_id").isNotNull()).withColumn("_rn", F.row_number().over(w))
            .filter("_rn = 1").drop("_rn"))


def project_listing(memberships: DataFrame, projects: DataFrame, analyses: DataFrame) -> DataFrame:
    """Each user's projects, newest membership first, with collaborator count and latest analysis."""
    members = memberships.groupBy("project_id").agg(F.count(F.lit(1)).alias("collaborators"))
    latest = _latest_per_project(analyses).select(
        "project_id", F.col("id").alias("latest_analysis_id"), F.col("status").alias("latest_status"),
        F.col("health_score").alias("latest_health_score"))
    p = projects.select(F.col("id").alias("project_id"), "repo_url", "repo_name")
    j = memberships.join(p, "project_id").join(members, "project_id").join(latest, "project_id", "left")
    # newest membership first (without a date: last); a user with a third of all memberships is
    # numbered by many tasks
    return positions(j, ["user_id"], [F.col("added_at").desc(), F.col("project_id")])


def audit_feed(audit: DataFrame, users: DataFrame, limit: int = 50) -> DataFrame:
    """Newest ``limit`` entries, admin name or ``system``, details decoded.

    ``orderBy(...).limit(n)`` plans as a distributed top-k (TakeOrderedAndProject).
    """
    if int(limit) < 1:
        raise ValueError(f"expected a positive number, not {limit}")
    n = int(limit)
    u = users.select(F.col("id").alias("admin_id"), F.col("username").alias("_admin"))
    top = audit.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)
    # the user table has no proven size bound, so it is not broadcast; AQE plans the join at run time
    j = top.join(u, "admin_id", "left")
    return j.select("id", F.coalesce("_admin", F.lit("system")).alias("admin"), "action", "target_type",
                    "target_id", F.from_json("details", "map<string,string>").alias("details"), "created_at")


def deletion_impact(memberships: DataFrame, analyses: DataFrame) -> DataFrame:
    """For every (user, project) membership: would deleting the user drop the
    project (no other member) with its analyses, or only unlink the user?"""
    sizes = memberships.groupBy("project_id").agg((F.count(F.lit(1)) - 1).alias("_others"))
    m = memberships.join(sizes, "project_id")
    per_project = analyses.filter(F.col("project_id").isNotNull()).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("_analyses"))
    j = m.join(per_project, "project_id", "left")
    action = F.when(F.col("_others") == 0, F.lit("delete_project")).otherwise(F.lit("unlink"))
    return j.select("user_id", "project_id", "role", F.col("_others").alias("other_members"), action.alias("action"),
                    F.when(action == "delete_project", F.coalesce("_analyses", F.lit(0))).otherwise(F.lit(0))
                    .alias("analyses_removed"))


SYSTEM_METRICS = ["users", "projects", "analyses", "completed", "storage_bytes"]


def system_stats(users: DataFrame, projects: DataFrame, analyses: DataFrame, files: DataFrame) -> DataFrame:
    """One row: users, projects, analyses, completed analyses, storage bytes / MB.

    Each figure is a global aggregate of its own table; the single-row results
    are unioned as (metric, value) and pivoted, so no join is needed.
    """
    def metric(df, name, expr):
        return df.agg(expr.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")

    parts = [metric(users, "users", F.count(F.lit(1))),
             metric(projects, "projects", F.count(F.lit(1))),
             metric(analyses, "analyses", F.count(F.lit(1))),
             metric(analyses, "completed", F.count_if(F.col("status") == "complete")),
             metric(files, "storage_bytes", F.coalesce(F.sum("size"), F.lit(0)))]
    longform = parts[0]
    for p in parts[1:]:
        longform = longform.unionByName(p)
    wide = longform.groupBy().pivot("metric", SYSTEM_METRICS).agg(F.first("value"))
    from strata.sources.files import mb_2dp
    return wide.withColumn("storage_mb", mb_2dp(F.col("storage_bytes")))


def user_usage(users: DataFrame, memberships: DataFrame, analyses: DataFrame) -> DataFrame:
    """Per user: projects, analyses and storage of those analyses, newest user first."""
    per_project = analyses.filter(F.col("project_id").isNotNull()).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("storage_bytes").alias("_bytes"))
    m = memberships.join(per_project, "project_id", "left").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("projects"), F.coalesce(F.sum("_n"), F.lit(0)).alias("analyses"),
        F.coalesce(F.sum("_bytes"), F.lit(0)).cast("long").alias("storage_bytes"))
    u = users.select(F.col("id").alias("user_id"), "username", "created_at")
    j = u.join(m, "user_id", "left")
    from strata.sources.files import mb_2dp
    storage = F.coalesce("storage_bytes", F.lit(0))
    return j.select("user_id", "username", F.coalesce("projects", F.lit(0)).alias("projects"),
                    F.coalesce("analyses", F.lit(0)).alias("analyses"), storage.alias("storage_bytes"),
                    mb_2dp(storage).alias("storage_mb"), "created_at").orderBy(F.col("created_at").desc(), "user_id")


def user_projects(memberships: DataFrame, projects: DataFrame) -> DataFrame:
    """The projects of every user with the user's role, one row each (``user_usage`` counts them)."""
    p = projects.select(F.col("id").alias("project_id"), "repo_name", "repo_url")
    return memberships.select("user_id", "project_id", "role", "added_at").join(p, "project_id")


def project_collaborators(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """The members of every project, one row each: beside ``project_listing`` these rows are the nested
    lists of the service, without a pair for every two members."""
    u = users.select(F.col("id").alias("user_id"), "username", "email")
    return memberships.select("project_id", "user_id", "role", "added_at").join(u, "user_id")


def repo_inventory(projects: DataFrame, memberships: DataFrame, analyses: DataFrame) -> DataFrame:
    """Per project: analyses, issues over all analyses, latest status and time, members."""
    agg = analyses.filter(F.col("project_id").isNotNull()).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("analysis_count"), F.sum("total_issues").cast("long").alias("total_issues"))
    latest = _latest_per_project(analyses).select(
        "project_id", F.col("status").alias("status"),
        F.coalesce("completed_at", "created_at").alias("last_analyzed"))
    mem = memberships.groupBy("project_id").agg(F.count(F.lit(1)).alias("members"))
    p = projects.select(F.col("id").alias("project_id"), "repo_name", "repo_url")
    j = p.join(agg, "project_id", "left").join(latest, "project_id", "left").join(mem, "project_id", "left")
    return j.select("project_id", "repo_name", F.coalesce("analysis_count", F.lit(0)).alias("analysis_count"),
                    F.coalesce("total_issues", F.lit(0)).alias("total_issues"),
                    F.coalesce("status", F.lit("none")).alias("status"), "last_analyzed",
                    F.coalesce("members", F.lit(0)).alias("members"))


def project_tiles(memberships: DataFrame, analyses: DataFrame) -> DataFrame:
    """Dashboard tiles per user: total, owned, shared, healthy (latest score >= 80, null = 0)."""
    latest = _latest_per_project(analyses).select("project_id", F.col("health_score").alias("_score"))
    j = memberships.join(latest, "project_id", "left")
    return j.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("role") == "owner").alias("owned"),
        F.count_if(F.col("role") != "owner").alias("shared"),
        F.count_if(F.coalesce("_score", F.lit(0)) >= HEALTHY_SCORE).alias("healthy"))


__all__ = ["project_listing", "audit_feed", "deletion_impact", "system_stats", "user_usage",
           "repo_inventory", "project_tiles", "latest_analysis"]
