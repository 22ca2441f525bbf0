"""Finding-level operators: de-duplication, stable ids, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata import schemas as S
from strata.functions.severity import severity_rank
from strata.operators.positions import positions

DEDUPE_KEY = ["repo_id", "file_path", "rule_id", "line_number"]


def _order_cols(df: DataFrame) -> list[str]:
    return [c for c in ("engine_order", "seq") if c in df.columns]


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding per (repo, file, rule, line): highest severity wins, first on a tie.

    "First" is engine registration order, then the finding's own order
    (``seq`` when present), then end line and snippet so the choice is total.
    Severity names outside the seven tiers rank as ``trace`` (0).
    Implemented as a keyed ``min_by``: partial aggregation before the shuffle
    keeps only one candidate per key and map task.
    """
    cols = [c for c in findings.columns]
    tiebreak = [F.col(c) for c in _order_cols(findings)]
    order = F.struct(
        (-severity_rank("severity", unknown=0)).alias("_neg_rank"),
        *[c.alias(f"_t{i}") for i, c in enumerate(tiebreak)],
        F.coalesce(F.col("end_line"), F.lit(0)).alias("_end"),
        F.coalesce(F.col("code_snippet"), F.lit("")).alias("_snip"),
    )
    payload = F.struct(*[F.col(c) for c in cols if c not in DEDUPE_KEY])
    # the kept finding takes the list position of the key's FIRST occurrence (a
    # replaced dictionary value keeps its slot), so engine_order is the minimum
    pos_cols = _order_cols(findings)
    firsts = [F.min(F.struct(*pos_cols)).alias("_first")] if pos_cols else []
    out = (findings.groupBy(*DEDUPE_KEY)
           .agg(F.min_by(payload, order).alias("_f"), *firsts))

    def pick(c):
        if c in DEDUPE_KEY:
            return F.col(c)
        if c in pos_cols:
            return F.col(f"_first.{c}").alias(c)
        return F.col(f"_f.{c}").alias(c)
    return out.select(*[pick(c) for c in cols])


def assign_issue_ids(issues: DataFrame) -> DataFrame:
    """``issue_{i}_{md5(path || line || rule)[:8]}``; an existing ``id`` is kept.

    ``i`` is the 0-based position in the repository's issue list: files in
    path order, inside a file severity descending then engine / rule / line.
    Positions come from range partitions (``positions``), so no single task has
    to rank a whole repository; null paths come first and keep their rows.
    """
    order = [F.col("file_path"), severity_rank("severity", unknown=0).desc(),
             *[F.col(c) for c in _order_cols(issues)], F.col("rule_id"), F.col("line_number"), F.col("end_line")]
    placed = positions(issues, ["repo_id"], order, "_position")
    digest = F.substring(F.md5(F.concat(F.coalesce("file_path", F.lit("")),
                                        F.coalesce(F.col("line_number").cast("string"), F.lit("0")),
                                        F.coalesce("rule_id", F.lit("")))), 1, 8)
    new_id = F.concat(F.lit("issue_"), (F.col("_position") - 1).cast("string"), F.lit("_"), digest)
    existing = F.col("id") if "id" in issues.columns else F.lit(None).cast("string")
    return placed.withColumn("id", F.coalesce(F.when(existing != "", existing), new_id)).drop("_position")


def normalize_issue(issues: DataFrame) -> DataFrame:
    """Fill absent fields the way stored issues are read back.

    family <- category <- issue_type <- ``unknown``; rule_id <- issue_type <-
    ``unknown``; severity ``medium``; message ``Issue detected``; line 0;
    engine ``unknown``; snippet ``''``.  Absent key and JSON null are treated
    alike after ``from_json``.
    """
    def col(name, typ="string"):
        return F.col(name) if name in issues.columns else F.lit(None).cast(typ)

    out = issues
    fills = {
        "defect_family": F.coalesce(col("defect_family"), F.when(col("category") != "", col("category")),
                                    F.when(col("issue_type") != "", col("issue_type")), F.lit("unknown")),
        "rule_id": F.coalesce(col("rule_id"), F.when(col("issue_type") != "", col("issue_type")), F.lit("unknown")),
        "severity": F.coalesce(col("severity"), F.lit("medium")),
        "message": F.coalesce(col("message"), F.lit(S.DEFAULT_MESSAGE)),
        "line_number": F.coalesce(col("line_number", "int"), F.lit(0)),
        "engine_source": F.coalesce(col("engine_source"), F.lit("unknown")),
        "code_snippet": F.coalesce(col("code_snippet"), F.lit("")),
        "fix_hint": col("fix_hint"), "cwe_id": col("cwe_id"), "owasp_ref": col("owasp_ref"),
        "origin_author_name": col("origin_author_name"), "origin_author_email": col("origin_author_email"),
        "origin_author": col("origin_author"), "origin_commit": col("origin_commit"),
        "origin_date": col("origin_date", "timestamp"),
    }
    for name, expr in fills.items():
        out = out.withColumn(name, expr)
    return out
