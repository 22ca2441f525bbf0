"""Rule catalogue upkeep: seeding, validated bulk import, listing, change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata import schemas as S

MAX_ERRORS_REPORTED = 20


def rule_name(rule_key) -> F.Column:
    """``sql-injection_v2`` -> ``Sql Injection V2``."""
    k = F.col(rule_key) if isinstance(rule_key, str) else rule_key
    parts = F.filter(F.split(F.regexp_replace(k, "_", "-"), "-"), lambda p: p != "")
    return F.initcap(F.array_join(parts, " "))


def seed_rules(specs: DataFrame, families: DataFrame, overrides: DataFrame | None = None,
               existing: DataFrame | None = None, collapse: bool = False) -> DataFrame:
    """Rule specs -> catalogue rows to insert.

    ``specs(id, languages array, pattern, severity, message, seq)``;
    ``families(id, defect_family)``; ``overrides(id, severity)``.
    Default: one row per (id, language), first spec wins, id ``REGEX-<id>`` for
    ``any`` else ``REGEX-<lang>-<id>``.  ``collapse``: one row per spec, more
    than one language becomes ``any`` and no language makes it inactive.
    Rows whose rule_id already exists in ``existing`` are left out
    (insert-if-absent).  An id without a family is an error, raised when the rows are read.
    """
    if collapse:
        n = F.size(F.coalesce("languages", F.array().cast("array<string>")))
        rows = specs.select("*", F.when(n == 1, F.element_at("languages", 1)).otherwise(F.lit("any")).alias("language"),
                            (n > 0).alias("is_active"),
                            F.concat(F.lit("REGEX-"), F.col("id")).alias("rule_id"))
    else:
        langs = F.when(F.size(F.coalesce("languages", F.array().cast("array<string>"))) > 0,
                       F.col("languages")).otherwise(F.array(F.lit("any")))
        exploded = specs.select("*", F.explode(langs).alias("language"))
        w = Window.partitionBy("id", "language").orderBy("seq")
        rows = (exploded.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
                .withColumn("is_active", F.lit(True))
                .withColumn("rule_id", F.when(F.col("language") == "any", F.concat(F.lit("REGEX-"), F.col("id")))
                            .otherwise(F.concat(F.lit("REGEX-"), F.col("language"), F.lit("-"), F.col("id")))))
    rows = rows.join(families.select("id", "defect_family"), "id", "left")
    if overrides is not None:
        rows = rows.join(overrides.select("id", F.col("severity").alias("_ovr")), "id", "left")
    else:
        rows = rows.withColumn("_ovr", F.lit(None).cast("string"))
    pattern = F.coalesce(F.col("pattern"), F.lit(""))
    out = rows.select(
        "rule_id", rule_name("id").alias("name"), F.coalesce("message", F.lit("")).alias("description"),
        "language", F.coalesce("defect_family", F.raise_error(
            F.concat(F.lit("No defect family for rule "), F.col("id"))).cast("string")).alias("defect_family"),
        F.coalesce("_ovr", "severity", F.lit("low")).alias("severity"), pattern.alias("pattern"),
        F.when(pattern.contains("\\n"), F.lit("regex_multiline")).otherwise(F.lit("regex_line")).alias("match_type"),
        F.coalesce("message", F.lit("")).alias("message"),
        F.lit(None).cast("string").alias("fix_hint"), F.lit(None).cast("string").alias("cwe_id"),
        F.lit(None).cast("string").alias("owasp_ref"), "is_active")
    if existing is not None:
        out = out.join(existing.select("rule_id"), "rule_id", "left_anti")
    return out


def _txt(df: DataFrame, name: str, default: str = "") -> F.Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(default))) if name in df.columns else F.lit(default)


def bulk_import_rules(rows: DataFrame, existing: DataFrame, order_col: str = "idx") -> DataFrame:
    """Validate an import batch in the source's check order.

    Per row: missing rule_id -> error; id already in the catalogue, or created
    by an earlier row of the batch -> skipped; missing name / pattern /
    message, bad severity, bad family, bad match type -> error; else created.
    One anti-join against the catalogue replaces the per-row lookups; the
    in-batch "earlier row" test is a window over the batch's rule ids.
    """
    rid = _txt(rows, "rule_id")
    sev = F.lower(_txt(rows, "severity"))
    fam = F.lower(_txt(rows, "defect_family"))
    mt = F.lower(_txt(rows, "match_type", "regex_line"))
    name, pattern, message = _txt(rows, "name"), _txt(rows, "pattern"), _txt(rows, "message")
    invalid = (F.when((name == "") | (pattern == "") | (message == ""), F.lit(S.IMPORT_ERRORS["missing_fields"]))
               .when(~sev.isin(*S.SEVERITY_ORDER), F.concat(F.lit(S.IMPORT_ERRORS["bad_severity"]), sev))
               .when(~fam.isin(*S.DEFECT_FAMILIES), F.concat(F.lit(S.IMPORT_ERRORS["bad_family"]), fam))
               .when(~mt.isin(*S.MATCH_TYPES), F.concat(F.lit(S.IMPORT_ERRORS["bad_match_type"]), mt)))
    base = rows.select("*", rid.alias("_rid"), invalid.alias("_invalid"), sev.alias("_sev"), fam.alias("_fam"),
                       mt.alias("_mt"), F.lower(_txt(rows, "language", "any")).alias("_lang"))
    # rows without an id are decided already; they meet in no join
    blank = base.filter(F.col("_rid") == "").select("*", F.lit("error").alias("status"),
                                                    F.lit(S.IMPORT_ERRORS["missing_id"]).alias("error"))
    base = base.filter(F.col("_rid") != "")
    known = existing.select(F.col("rule_id").alias("_rid")).distinct().withColumn("_exists", F.lit(True))
    base = base.join(known, "_rid", "left")
    firsts = base.groupBy("_rid").agg(F.min(F.when(F.col("_invalid").isNull(), F.col(order_col))).alias("_first_ok"))
    base = base.join(firsts, "_rid", "left")
    first_ok = F.col("_first_ok")
    status = (F.when(F.coalesce("_exists", F.lit(False)) | (first_ok < F.col(order_col)), F.lit("skipped"))
              .when(F.col("_invalid").isNotNull(), F.lit("error"))
              .otherwise(F.lit("created")))
    err = F.when(status == "error", F.col("_invalid"))
    return base.select("*", status.alias("status"), err.alias("error")).drop("_exists", "_first_ok").unionByName(blank)


def import_summary(validated: DataFrame) -> DataFrame:
    """created / skipped / error counts and the number of rows processed (one row)."""
    return validated.agg(
        F.count_if(F.col("status") == "created").alias("created"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors_count"),
        F.count(F.lit(1)).alias("total_processed"))


def first_errors(validated: DataFrame, order_col: str = "idx", n: int = MAX_ERRORS_REPORTED) -> DataFrame:
    """The first ``n`` errors by position (a distributed top-k, not a global sort)."""
    return (validated.filter(F.col("status") == "error")
            .select(order_col, F.col("_rid").alias("rule_id"), "error").orderBy(order_col).limit(n))


def created_rules(validated: DataFrame) -> DataFrame:
    """Catalogue rows for the created imports (is_active defaults to true)."""
    active = F.coalesce(F.col("is_active").cast("boolean"), F.lit(True)) if "is_active" in validated.columns else F.lit(True)
    return validated.filter(F.col("status") == "created").select(
        F.col("_rid").alias("rule_id"), _txt(validated, "name").alias("name"),
        _txt(validated, "description").alias("description"), F.col("_lang").alias("language"),
        F.col("_fam").alias("defect_family"), F.col("_sev").alias("severity"), _txt(validated, "pattern").alias("pattern"),
        F.col("_mt").alias("match_type"), _txt(validated, "message").alias("message"), active.alias("is_active"))


def read_rules_csv(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """CSV with a header; every column read as text; is_active = lower in (true, 1, yes).

    Quotes inside a field are doubled and fields may hold line breaks, as ordinary CSV writers
    have it.  ``position`` orders the rows: by file name, then by place in the file.
    """
    df = spark.read.options(header=True, inferSchema=False, quote='"', escape='"', multiLine=True).csv(path)
    if "is_active" in df.columns:
        df = df.withColumn("is_active", F.lower(F.trim("is_active")).isin("true", "1", "yes"))
    return _check_cap(_with_position(df), cap)


def _with_position(df: DataFrame) -> DataFrame:
    """Order of the rows of read files: a file's splits by their offset, rows within a split as read."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"),
                                   F.col("_metadata.file_block_start").alias("block"),
                                   F.monotonically_increasing_id().alias("row")).alias("position"))


def read_rules_json(spark: SparkSession, path: str, cap: int | None = None, multiline: bool = False) -> DataFrame:
    """JSON rules (one object per line, or one array document with ``multiline``); empty input is rejected."""
    df = spark.read.option("multiLine", multiline).json(path)
    if not df.columns or df.isEmpty():
        raise ValueError("No rules provided")
    return _check_cap(_with_position(df), cap)


def _check_cap(df: DataFrame, cap: int | None) -> DataFrame:
    if cap is not None and df.limit(cap + 1).count() > cap:
        raise ValueError(f"Maximum {cap} rules per import")
    return df


def list_rules(rules: DataFrame, language: str | None = None, defect_family: str | None = None,
               severity: str | None = None, is_active: bool | None = None, admin_order: bool = False) -> DataFrame:
    """Optional equality filters; rule_id order (admin view: newest first)."""
    out = rules
    for col, val in (("language", language), ("defect_family", defect_family), ("severity", severity),
                     ("is_active", is_active)):
        if val is not None:
            out = out.filter(F.col(col) == F.lit(val))
    return out.orderBy(F.col("created_at").desc(), "rule_id") if admin_order else out.orderBy("rule_id")


# Fields that an update may set, besides ``is_active``
UPDATE_FIELDS = ["name", "description", "language", "defect_family", "severity", "pattern", "match_type", "message",
                 "fix_hint", "cwe_id", "owasp_ref"]


def apply_rule_changes(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Fold a change feed ``(rule_id, seq, action, fields...)`` into the catalogue.

    update: last non-null value per field wins (``UPDATE_FIELDS`` and ``is_active``,
    those that the feed has); toggle flips ``is_active``; deactivate sets it false;
    delete removes the rule.  One keyed aggregate over the feed (partial
    aggregation), then one join to the catalogue.
    """
    act = F.col("action")
    fields = [f for f in UPDATE_FIELDS if f in changes.columns and f in rules.columns]
    has_flag = "is_active" in changes.columns
    flag = F.when(act == "deactivate", F.lit(False))
    if has_flag:
        flag = flag.when(act == "update", F.col("is_active"))
    changes = changes.withColumn("_flag", flag)
    last_set = F.max(F.when(F.col("_flag").isNotNull(), F.col("seq")))
    folded = changes.groupBy("rule_id").agg(
        *[F.max_by(f, F.when((act == "update") & F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}") for f in fields],
        F.max_by("_flag", F.when(F.col("_flag").isNotNull(), F.col("seq"))).alias("_set"),
        last_set.alias("_set_seq"),
        F.count_if(act == "delete").alias("_del"))
    toggles = changes.filter(act == "toggle").select("rule_id", F.col("seq").alias("_tseq"))
    # toggles after the last value set decide the flag; without one, parity flips the base value
    tcount = (toggles.join(folded.select("rule_id", "_set_seq"), "rule_id")
              .groupBy("rule_id").agg(
                  F.count_if(F.col("_set_seq").isNull() | (F.col("_tseq") > F.col("_set_seq"))).alias("_t_after")))
    j = rules.join(folded, "rule_id", "left").join(tcount, "rule_id", "left")
    base = F.coalesce(F.col("_set"), F.col("is_active"), F.lit(False))
    odd = F.coalesce(F.col("_t_after"), F.lit(0)) % 2 == 1
    out = j.filter(F.coalesce(F.col("_del"), F.lit(0)) == 0)
    return out.select(*[(base != odd).alias(c) if c == "is_active" else
                        F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rules.columns])
