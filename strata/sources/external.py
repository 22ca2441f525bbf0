"""Ingest external scanner JSON reports as findings, with rule metadata override."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata import schemas as S

from strata.functions.severity import classify_defect_family, map_external_severity

REPORT_SCHEMA = """results array<struct<
  check_id string, path string,
  start struct<line int, col int>, `end` struct<line int>,
  extra struct<severity string, message string, lines string,
               metadata struct<category string, cwe string, owasp string>>>>"""


def _first_meta(col: F.Column) -> F.Column:
    """A metadata value may be a string or a list: list -> first element (or NULL).

    A plain string may begin with a bracket too; only what parses as an array is a list.
    """
    is_list = F.trim(col).startswith("[") & F.coalesce(F.json_array_length(col) >= 0, F.lit(False))
    return F.when(is_list, F.get(F.from_json(col, "array<string>"), 0)).otherwise(col)


def ingest_external_findings(reports: DataFrame, rules: DataFrame | None = None,
                             repo_root_col: str | None = None, engine: str = "external") -> DataFrame:
    """``reports(repo_id, report)`` -> one finding per result.

    Paths under the repository root are made relative and ``\\`` becomes ``/``;
    line defaults to 0, end line to the line, column to 0.  A result whose
    check id names an active external-kind rule takes that rule's message,
    severity, family, hint, CWE and OWASP; otherwise severity is mapped from
    the scanner word and the family from the keyword cascade.  The rule table
    is a small dimension, broadcast to the (large) result side.
    """
    parsed = reports.select("*", F.explode(F.from_json("report", REPORT_SCHEMA)["results"]).alias("_r"))
    path = F.coalesce(F.col("_r.path"), F.lit(""))
    if repo_root_col:
        root = F.col(repo_root_col)
        path = F.when(path.startswith(root), F.regexp_replace(F.substring(path, F.length(root) + 1, 1 << 30), "^/+", "")).otherwise(path)
    path = F.regexp_replace(path, r"\\", "/")
    base = parsed.select(
        "repo_id", path.alias("file_path"),
        F.coalesce(F.col("_r.check_id"), F.lit("unknown")).alias("rule_id"),
        F.coalesce(F.col("_r.start.line"), F.lit(0)).alias("line_number"),
        F.col("_r.end.line").alias("_end"), F.coalesce(F.col("_r.start.col"), F.lit(0)).alias("column"),
        F.col("_r.extra.severity").alias("_sev"), F.col("_r.extra.message").alias("_msg"),
        F.coalesce(F.col("_r.extra.lines"), F.lit("")).alias("code_snippet"),
        F.col("_r.extra.metadata.category").alias("_cat"),
        _first_meta(F.col("_r.extra.metadata.cwe")).alias("_cwe"),
        _first_meta(F.col("_r.extra.metadata.owasp")).alias("_owasp"))
    if rules is not None:
        meta = (rules.filter(F.coalesce("is_active", F.lit(False)) & (F.col("match_type") == "ast_semgrep"))
                .select(F.col("rule_id").alias("_rid"), F.col("severity").alias("_rsev"),
                        F.col("defect_family").alias("_rfam"), F.col("message").alias("_rmsg"),
                        F.col("fix_hint").alias("_rhint"), F.col("cwe_id").alias("_rcwe"),
                        F.col("owasp_ref").alias("_rowasp"), F.lit(True).alias("_has_rule")))
        base = base.join(meta, base.rule_id == meta._rid, "left")
    else:
        for c in ("_rsev", "_rfam", "_rmsg", "_rhint", "_rcwe", "_rowasp"):
            base = base.withColumn(c, F.lit(None).cast("string"))
        base = base.withColumn("_has_rule", F.lit(None).cast("boolean"))
    has = F.coalesce(F.col("_has_rule"), F.lit(False))
    last = F.element_at(F.split("rule_id", r"\."), -1)
    return base.select(
        "repo_id", "rule_id", F.lit(engine).alias("engine_source"), "file_path",
        F.col("line_number").cast("int").alias("line_number"),
        map_external_severity(F.col("_sev"), F.col("_rsev")).alias("severity"),
        classify_defect_family(F.col("rule_id"), F.col("_cat"), F.col("_rfam")).alias("defect_family"),
        F.when(has, F.col("_rmsg")).otherwise(F.coalesce(F.col("_msg"), F.lit(S.DEFAULT_MESSAGE))).alias("message"),
        F.when(has, F.col("_rhint")).alias("fix_hint"),
        F.when(has, F.col("_rcwe")).otherwise(F.col("_cwe")).alias("cwe_id"),
        F.when(has, F.col("_rowasp")).otherwise(F.col("_owasp")).alias("owasp_ref"),
        "code_snippet", F.regexp_replace(last, "_", "-").alias("issue_type"),
        F.coalesce(F.when(F.col("_end") != 0, F.col("_end")), F.col("line_number")).cast("int").alias("end_line"),
        F.col("column").cast("int").alias("column"))
