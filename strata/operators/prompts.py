"""Text-model preparation in batch: payloads, prompts, request keys, responses.

No model is called; these build the rows a model service would consume and
decode the rows it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata import schemas as S
from strata.operators.rollups import top_counts
from strata.operators.ranking import representative_issues

MAX_TOP_TYPES = 8
MAX_SNIPPET_CHARS = 5000

# FIXED VALUES: defaults when a model response leaves a field out
RESPONSE_DEFAULTS = {
    "root_cause": "Unable to determine root cause",
    "fix_strategy": "No fix strategy available",
    "code_patch": "",
    "confidence": 0.5,
}


def summary_payload(issues: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Per repository JSON: total, seven severity counts, top families, top rules,
    representative issues.  Each part is a keyed aggregate; they meet on repo_id.
    A repository of ``repos`` without issues has zeros and empty collections.
    ``issues`` is read once per part: pass a landed table."""
    sev = F.lower(F.coalesce(F.col("severity"), F.lit("info")))
    counts = issues.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_issues"),
        F.struct(*[F.count_if(sev == s).alias(s) for s in reversed(S.SEVERITY_ORDER)]).alias("severity_counts"))
    ordered = issues.withColumn("_seq", F.struct("file_path", "line_number", "rule_id"))

    def as_map(df, name):
        # at most MAX_TOP_TYPES rows per repository reach this collect
        entries = F.sort_array(F.collect_list(F.struct("rank", "value", "count")))
        return df.groupBy("repo_id").agg(F.map_from_entries(F.transform(
            entries, lambda x: F.struct(x["value"], x["count"]))).alias(name))

    fams = as_map(top_counts(ordered, "repo_id", "defect_family", MAX_TOP_TYPES, "_seq"), "top_defect_families")
    rules = as_map(top_counts(ordered, "repo_id", "rule_id", MAX_TOP_TYPES, "_seq"), "top_rule_ids")
    rep_item = F.struct("file", "line", "severity", "family", "rule_id", "message")
    reps = representative_issues(issues).groupBy("repo_id").agg(  # at most 18 rows per repository
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("position").alias("p"), rep_item.alias("v")))),
                    lambda x: x["v"]).alias("representative_issues"))
    if repos is not None:
        zero = F.struct(*[F.lit(0).cast("long").alias(s) for s in reversed(S.SEVERITY_ORDER)])
        counts = repos.select("repo_id").distinct().join(counts, "repo_id", "left").select(
            "repo_id", F.coalesce("total_issues", F.lit(0)).alias("total_issues"),
            F.coalesce("severity_counts", zero).alias("severity_counts"))
    joined = counts.join(fams, "repo_id", "left").join(rules, "repo_id", "left").join(reps, "repo_id", "left")
    for c in ("top_defect_families", "top_rule_ids"):
        joined = joined.withColumn(c, F.coalesce(c, F.create_map().cast("map<string,bigint>")))
    joined = joined.withColumn("representative_issues", F.coalesce(
        "representative_issues", F.array().cast(joined.schema["representative_issues"].dataType)))
    payload = F.to_json(F.struct("total_issues", "severity_counts", "top_defect_families", "top_rule_ids",
                                 "representative_issues"))
    return joined.select("repo_id", "total_issues", payload.alias("payload"))


def fix_prompts(issues: DataFrame, language_col: str = "language") -> DataFrame:
    """One user prompt per issue.  A blank or over-long snippet has ``status`` rejected with a
    ``reason`` and no prompt, as the service answers with an error; no issue is lost."""
    lang = F.coalesce(F.col(language_col), F.lit("plaintext"))
    snippet = F.col("code_snippet")
    fence = F.concat(F.lit("```"), lang, F.lit("\n"))
    before = F.coalesce(F.col("context_before"), F.lit("")) if "context_before" in issues.columns else F.lit("")
    after = F.coalesce(F.col("context_after"), F.lit("")) if "context_after" in issues.columns else F.lit("")
    L = S.FIX_PROMPT_LABELS
    parts = [
        F.concat(F.lit(L["family"]), F.col("defect_family")),
        F.concat(F.lit(L["language"]), lang),
        F.when(F.coalesce(F.col("file_path"), F.lit("")) != "", F.concat(F.lit(L["file"]), F.col("file_path"))),
        F.when(before != "", F.concat(F.lit(L["before"]), fence, before, F.lit("\n```"))),
        F.concat(F.lit(L["flagged"]), fence, snippet, F.lit("\n```")),
        F.when(after != "", F.concat(F.lit(L["after"]), fence, after, F.lit("\n```"))),
        F.lit(S.FIX_PROMPT_CLOSING),
    ]
    reason = (F.when(F.trim(F.coalesce(snippet, F.lit(""))) == "", F.lit(S.FIX_PROMPT_REJECTIONS["empty"]))
              .when(F.length(snippet) > MAX_SNIPPET_CHARS, F.lit(S.FIX_PROMPT_REJECTIONS["too_long"])))
    return (issues.withColumn("reason", reason)
            .withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("rejected"))
            .withColumn("prompt", F.when(F.col("reason").isNull(), F.concat_ws("\n", *parts))))


def request_key(task: str, *parts) -> F.Column:
    """First 20 hex characters of sha256(``task|part1|part2...``)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", F.lit(task), *cols), 256), 1, 20)


def request_dedupe(requests: DataFrame, order_col: str) -> DataFrame:
    """Identical requests collapse to one key: count and the first request."""
    return requests.groupBy("request_key").agg(
        F.count(F.lit(1)).alias("requests"), F.min(order_col).alias("first_request"))


def request_hit_rate(requests: DataFrame) -> DataFrame:
    """Share of requests a result cache would answer, 3 dp (unbounded reuse)."""
    agg = requests.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("request_key").alias("distinct_keys"))
    return agg.select("total", "distinct_keys",
                      F.when(F.col("total") > 0, ratio_3dp(F.col("total") - F.col("distinct_keys"), F.col("total")))
                      .otherwise(F.lit(0.0)).alias("hit_rate"))


def ratio_3dp(part, whole):
    """round(part / whole, 3), half-up on the exact ratio."""
    return F.floor((part * 2000 + whole) / (whole * 2)) / 1000.0


RESPONSE_SCHEMA = "root_cause string, fix_strategy string, code_patch string, confidence double, reasoning array<string>"


def parse_fix_responses(responses: DataFrame, text_col: str = "response") -> DataFrame:
    """Response JSON -> typed row with defaults; confidence clamped to 0..1.

    Text that is not a JSON object sets ``parse_error`` and yields default
    fields; ``reusable`` marks rows worth keeping (confidence > 0, parsed).
    """
    txt = F.col(text_col)
    valid = F.get_json_object(txt, "$").isNotNull() & F.trim(txt).startswith("{")
    parsed = F.from_json(txt, RESPONSE_SCHEMA)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parsed["confidence"],
                                                                   F.lit(RESPONSE_DEFAULTS["confidence"]))))
    out = responses.select(
        *[c for c in responses.columns if c != text_col],
        F.when(valid, F.coalesce(parsed["root_cause"], F.lit(RESPONSE_DEFAULTS["root_cause"]))).alias("root_cause"),
        F.when(valid, F.coalesce(parsed["fix_strategy"], F.lit(RESPONSE_DEFAULTS["fix_strategy"]))).alias("fix_strategy"),
        F.when(valid, F.coalesce(parsed["code_patch"], F.lit(RESPONSE_DEFAULTS["code_patch"]))).alias("code_patch"),
        F.when(valid, conf).alias("confidence"),
        F.when(valid, F.coalesce(parsed["reasoning"], F.array().cast("array<string>"))).alias("reasoning"),
        (~valid).alias("parse_error"))
    return out.withColumn("reusable", F.coalesce(~F.col("parse_error") & (F.col("confidence") > 0), F.lit(False)))
