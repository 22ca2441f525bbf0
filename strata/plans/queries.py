"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables through ``strata.fixtures`` and runs a
library operator over the whole tables.  Output columns are scalar and
aliased to the same names as the oracle SQL in ``strata.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import fixtures as FX
from strata import schemas as S
from strata.operators import findings as FD
from strata.operators import rollups as RU
from strata.operators import scan as SC
from strata.functions.languages import scannable_filter
from strata.session import land

QUERIES: dict = {}


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


FINDING_OUT = ["repo_id", "rule_id", "engine_source", "file_path", "line_number", "severity",
               "defect_family", "message", "code_snippet", "issue_type", "end_line", "column"]


@register("scan_line_rules")
def q_scan_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = scannable_filter(FX.files(spark, sf_dir))
    return SC.scan_line_rules(files, FX.rules(spark)).select(*FINDING_OUT)


@register("dedupe_findings")
def q_dedupe_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.findings(spark, sf_dir).select(*FINDING_OUT)


@register("health_score")
def q_health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RU.health_score(FX.findings(spark, sf_dir), FX.repos(spark, sf_dir))


# ---------------------------------------------------------------------------
# 2.1 / 2.2  file tree, paths, languages
from strata.sources import files as SF  # noqa: E402
from strata.functions import paths as P  # noqa: E402
from strata.functions import text as TX  # noqa: E402
from strata.functions.languages import is_binary  # noqa: E402


@register("scan_file_tree")
def q_scan_file_tree(spark, sf_dir):
    return SF.scan_file_tree(FX.files(spark, sf_dir))


@register("skip_dirs")
def q_skip_dirs(spark, sf_dir):
    return SF.skip_dirs(FX.files(spark, sf_dir)).select("repo_id", "path")


@register("skip_extensions_hidden")
def q_skip_extensions_hidden(spark, sf_dir):
    return SF.skip_extensions_hidden(FX.files(spark, sf_dir)).select("repo_id", "path")


@register("size_limit")
def q_size_limit(spark, sf_dir):
    return SF.size_limit(FX.files(spark, sf_dir), S.AUTHORED_MAX_BYTES, 1).select("repo_id", "path", "size")


@register("detect_language")
def q_detect_language(spark, sf_dir):
    return FX.files(spark, sf_dir).select("repo_id", "path", "language")


@register("scannable_filter")
def q_scannable_filter(spark, sf_dir):
    return scannable_filter(FX.files(spark, sf_dir)).select("repo_id", "path", "language")


@register("detect_binary")
def q_detect_binary(spark, sf_dir):
    return FX.files(spark, sf_dir).select("repo_id", "path", is_binary("content").alias("is_binary"))


@register("read_text_lossy")
def q_read_text_lossy(spark, sf_dir):
    t = TX.read_text_lossy("content")
    return FX.files(spark, sf_dir).select("repo_id", "path", F.length(t).alias("n_chars"), F.md5(t).alias("digest"))


@register("explode_lines")
def q_explode_lines(spark, sf_dir):
    return SC.explode_lines(FX.files(spark, sf_dir))


@register("repo_storage_size")
def q_repo_storage_size(spark, sf_dir):
    return SF.repo_storage_size(FX.files(spark, sf_dir))


@register("language_stats")
def q_language_stats(spark, sf_dir):
    return RU.language_stats(FX.files(spark, sf_dir))


@register("total_lines")
def q_total_lines(spark, sf_dir):
    return RU.total_lines(FX.files(spark, sf_dir))


@register("attach_issue_counts")
def q_attach_issue_counts(spark, sf_dir):
    return RU.attach_issue_counts(FX.files(spark, sf_dir), FX.findings(spark, sf_dir)).select(
        "repo_id", "path", "issue_count")


@register("directory_rollup")
def q_directory_rollup(spark, sf_dir):
    return RU.directory_rollup(RU.attach_issue_counts(FX.files(spark, sf_dir), FX.findings(spark, sf_dir)))


@register("code_snippet")
def q_code_snippet(spark, sf_dir):
    # the lines around the first, the middle and the last line of every file, and around a span to its end
    files = TX.with_lines(FX.files(spark, sf_dir), keep=["repo_id", "path"]).filter(F.size("_lines") > 0)
    n = F.size("_lines")
    at = F.explode(F.array(*[F.struct(a.cast("int").alias("line"), b.cast("int").alias("end")) for a, b in (
        (F.lit(1), F.lit(1)), (F.floor((n + 1) / 2), F.floor((n + 1) / 2)), (n, n), (F.floor((n + 1) / 2), n))]))
    return files.select("repo_id", "path", "_lines", at.alias("s")).select(
        "repo_id", "path", F.col("s.line").alias("line"), F.col("s.end").alias("end"),
        F.md5(TX.snippet_from_lines("_lines", F.col("s.line"), F.col("s.end"))).alias("snippet_md5"))


@register("clip_diff")
def q_clip_diff(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(TX.clip_lines("text", 30)).alias("clip30"),
                    F.md5(F.substring("text", 1, 500)).alias("clip500"),
                    F.md5(F.array_join(TX.last_lines(F.split("text", "\n", -1), 15), "\n")).alias("last15"))


@register("normalize_repo_url")
def q_normalize_repo_url(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", P.normalize_repo_url("url").alias("url"),
                    P.is_valid_repo_url("url").alias("is_valid"), P.repo_name_from_url("url").alias("repo_name"))


# ---------------------------------------------------------------------------
# 2.4 / 2.5 / 2.6  blame and history
from strata.operators import blame as BL  # noqa: E402
from strata.operators import history as HI  # noqa: E402


def _attributed(spark, sf_dir):
    # findings are few beside blame lines: blame is reduced to their files before its window runs
    findings = _landed_findings(spark, sf_dir)
    hit = findings.select("repo_id", F.col("file_path").alias("path"))
    return BL.attribute_issues(findings, FX.blame_lines(spark, sf_dir, only_files=hit))


@register("expand_blame")
def q_expand_blame(spark, sf_dir):
    return BL.expand_blame(FX.blame_segments(spark, sf_dir)).select(
        "repo_id", "file_path", "line_number", "author_name", "author_email", "commit",
        BL.iso_utc("ts").alias("date"), "content")


@register("attribute_issues")
def q_attribute_issues(spark, sf_dir):
    return _attributed(spark, sf_dir).select(
        "repo_id", "file_path", "line_number", "rule_id", "severity", "origin_author_name",
        "origin_author_email", "origin_author", "origin_commit", "origin_date")


@register("trace_line_origin")
def q_trace_line_origin(spark, sf_dir):
    req = _landed_findings(spark, sf_dir).select("repo_id", "file_path", "line_number", "rule_id")
    hit = req.select("repo_id", F.col("file_path").alias("path"))
    return BL.trace_line_origin(req, FX.blame_lines(spark, sf_dir, only_files=hit), FX.part_commits(spark, sf_dir))


@register("blame_authors")
def q_blame_authors(spark, sf_dir):
    return BL.blame_authors(FX.blame_lines(spark, sf_dir))


@register("contributor_stats")
def q_contributor_stats(spark, sf_dir):
    return RU.contributor_stats(_attributed(spark, sf_dir))


@register("contributor_fallback")
def q_contributor_fallback(spark, sf_dir):
    a = _attributed(spark, sf_dir).withColumn("origin_author_email", F.lit(None).cast("string")) \
        .withColumn("origin_author_name", F.lit(None).cast("string"))
    return RU.contributor_fallback(a)


@register("issues_per_day")
def q_issues_per_day(spark, sf_dir):
    return HI.issues_per_day(_attributed(spark, sf_dir))


@register("parse_commit_log")
def q_parse_commit_log(spark, sf_dir):
    return HI.parse_commit_log(FX.commit_logs(spark, sf_dir))


@register("commit_timeline")
def q_commit_timeline(spark, sf_dir):
    return HI.commit_timeline(FX.commits(spark, sf_dir), 50)


@register("commit_timeline_meta")
def q_commit_timeline_meta(spark, sf_dir):
    return HI.commit_timeline_meta(FX.commits(spark, sf_dir), 50)


@register("evolution_chain")
def q_evolution_chain(spark, sf_dir):
    return HI.evolution_chain(FX.commits(spark, sf_dir), 20)


@register("line_history")
def q_line_history(spark, sf_dir):
    from strata.operators.line_history import line_history
    return line_history(FX.line_requests(spark, sf_dir), FX.file_diffs(spark, sf_dir), FX.commits(spark, sf_dir), 20)


# ---------------------------------------------------------------------------
# findings roll-ups, ranking, ids, grades, external ingest
from strata.operators import ranking as RK  # noqa: E402
from strata.operators import prompts as PR  # noqa: E402
from strata.sources import external as EX  # noqa: E402
from strata.functions import severity as SV  # noqa: E402


def _landed_findings(spark, sf_dir):
    """Findings scanned once and written, for operators that read them several times."""
    return land(FX.findings(spark, sf_dir), "findings")


@register("severity_summary")
def q_severity_summary(spark, sf_dir):
    return RU.severity_summary(FX.findings(spark, sf_dir), FX.repos(spark, sf_dir))


@register("severity_breakdown_pct")
def q_severity_breakdown_pct(spark, sf_dir):
    return RU.severity_breakdown_pct(_landed_findings(spark, sf_dir), FX.repos(spark, sf_dir))


@register("family_hotspots")
def q_family_hotspots(spark, sf_dir):
    return RU.family_hotspots(FX.findings(spark, sf_dir))


@register("top_counts")
def q_top_counts(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return RU.top_counts(ev, "user_id", "event_type", 3, "event_id")


@register("issues_by_file")
def q_issues_by_file(spark, sf_dir):
    out = RU.issues_by_file(FX.findings(spark, sf_dir))
    return out.select("repo_id", "file_path", "issue_count", "max_rank",
                      F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["line_number"].cast("string"),
                                                                                  x["rule_id"])), ",").alias("issues"))


@register("issues_by_file_parts")
def q_issues_by_file_parts(spark, sf_dir):
    out = RU.issues_by_file_parts(FX.findings(spark, sf_dir), 2)
    return out.select("repo_id", "file_path", "part", "first", F.array_join(F.transform(
        "issues", lambda x: F.concat_ws(":", x["line_number"].cast("string"), x["rule_id"])), ",").alias("issues"))


@register("issue_identity")
def q_issue_identity(spark, sf_dir):
    return FD.assign_issue_ids(_landed_findings(spark, sf_dir)).select("repo_id", "file_path", "line_number", "rule_id", "id")


@register("health_grade_risk")
def q_health_grade_risk(spark, sf_dir):
    findings = _landed_findings(spark, sf_dir)
    hs = RU.health_score(findings, FX.repos(spark, sf_dir))
    ss = RU.severity_summary(findings)
    j = hs.join(ss, "repo_id", "left")
    z = {s: F.coalesce(F.col(s), F.lit(0)) for s in S.SEVERITY_ORDER}
    return j.select("repo_id", "health_score", SV.health_grade("health_score").alias("grade"),
                    SV.risk_label(z["blocker"], z["critical"], z["high"], z["medium"]).alias("risk"),
                    SV.report_colour_band("health_score").alias("report_band"),
                    SV.ui_colour_band("health_score").alias("ui_band"))


@register("executive_summary")
def q_executive_summary(spark, sf_dir):
    files = FX.files(spark, sf_dir)
    return RU.executive_summary(FX.findings(spark, sf_dir, files), files)


@register("search_issues")
def q_search_issues(spark, sf_dir):
    return RK.search_issues(FX.findings(spark, sf_dir), "token").select(
        "repo_id", "position", "file_path", "line_number", "rule_id", "severity")


@register("search_issues_index")
def q_search_issues_index(spark, sf_dir):
    # every document's number and language are looked for, as are parts of rule names
    from strata.operators import issue_index as IX
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = F.col("doc_id").cast("string")
    asked = d.select(F.explode(F.array(number, F.concat(F.lit("/"), number, F.lit(".P")), F.concat(F.col("lang"), F.lit("/")),
                                       F.concat(F.lit("L-"), F.substring("lang", 1, 1)), F.substring("source", 1, 4))).alias("query"))
    return IX.search_index(IX.build_issue_index(_landed_findings(spark, sf_dir)), asked).select(
        "query", "repo_id", "file_path", "line_number", "rule_id")


@register("top_issues")
def q_top_issues(spark, sf_dir):
    return RK.top_issues(_landed_findings(spark, sf_dir), 2).select(
        "repo_id", "rank", "file_path", "line_number", "rule_id", "severity", "remaining")


@register("representative_issues")
def q_representative_issues(spark, sf_dir):
    return RK.representative_issues(FX.findings(spark, sf_dir), 3)


@register("ingest_external_findings")
def q_ingest_external_findings(spark, sf_dir):
    return EX.ingest_external_findings(FX.external_reports(spark, sf_dir), FX.rules(spark))


@register("map_external_severity")
def q_map_external_severity(spark, sf_dir):
    e = FX.scanner_words(spark, sf_dir)
    return e.select("event_id", SV.map_external_severity("word", "rule_severity").alias("severity"))


@register("classify_defect_family")
def q_classify_defect_family(spark, sf_dir):
    e = FX.scanner_words(spark, sf_dir)
    return e.select("event_id", SV.classify_defect_family("check_id", "category", "rule_family").alias("defect_family"))


@register("rule_metadata_override")
def q_rule_metadata_override(spark, sf_dir):
    return q_ingest_external_findings(spark, sf_dir).select(
        "repo_id", "rule_id", "line_number", "message", "cwe_id", "owasp_ref", "fix_hint")


@register("fix_prompts")
def q_fix_prompts(spark, sf_dir):
    f = FX.findings(spark, sf_dir)
    files = FX.files(spark, sf_dir).select("repo_id", F.col("path").alias("file_path"), "language")
    return PR.fix_prompts(f.join(files, ["repo_id", "file_path"])).select(
        "repo_id", "file_path", "line_number", "rule_id", "status", "reason", F.md5("prompt").alias("prompt_md5"),
        F.length("prompt").alias("prompt_chars"))


def _requests(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = SC.explode_lines(d.select("doc_id", "lang", F.col("text").alias("content")), keep=("doc_id", "lang"))
    return lines.select(PR.request_key("fix", F.col("line"), F.lit("secrets"), F.col("lang")).alias("request_key"),
                        F.struct("doc_id", "line_number").alias("request_seq"))


@register("request_dedupe")
def q_request_dedupe(spark, sf_dir):
    return PR.request_dedupe(_requests(spark, sf_dir), "request_seq").select(
        "request_key", "requests", F.col("first_request.doc_id").alias("first_doc"),
        F.col("first_request.line_number").alias("first_line"))


@register("request_hit_rate")
def q_request_hit_rate(spark, sf_dir):
    return PR.request_hit_rate(_requests(spark, sf_dir))


@register("request_cache_hits")
def q_request_cache_hits(spark, sf_dir):
    from strata.operators.request_cache import cache_hit_rates, reuse_distances
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        PR.request_key("fix", F.col("user_id").cast("string"), "event_type").alias("request_key"), "ts", "event_id")
    return cache_hit_rates(reuse_distances(asked, [F.col("ts"), F.col("event_id")]), [1, 10, 100, 500])


@register("parse_fix_responses")
def q_parse_fix_responses(spark, sf_dir):
    out = PR.parse_fix_responses(FX.fix_responses(spark, sf_dir))
    return out.select("event_id", "root_cause", "fix_strategy", "code_patch", "confidence",
                      F.when(F.col("reasoning").isNotNull(), F.size("reasoning")).alias("n_reasons"),
                      "parse_error", "reusable")


PAYLOAD_SCHEMA = ("total_issues bigint, severity_counts struct<"
                  + ", ".join(f"{s}: bigint" for s in reversed(S.SEVERITY_ORDER))
                  + ">, top_defect_families map<string,bigint>, top_rule_ids map<string,bigint>, "
                  "representative_issues array<struct<file: string, line: bigint, severity: string, family: string, "
                  "rule_id: string, message: string>>")


@register("summary_payload")
def q_summary_payload(spark, sf_dir):
    out = PR.summary_payload(_landed_findings(spark, sf_dir), FX.repos(spark, sf_dir))
    doc = F.from_json("payload", PAYLOAD_SCHEMA)

    def pairs(name):
        return F.array_join(F.transform(F.map_entries(F.col(f"d.{name}")),
                                        lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias(name)

    reps = F.array_join(F.transform("d.representative_issues", lambda r: F.concat_ws(
        ":", r["file"], r["line"].cast("string"), r["severity"], r["family"], r["rule_id"], r["message"])), "|")
    return out.select("repo_id", doc.alias("d")).select(
        "repo_id", "d.total_issues", "d.severity_counts.*", pairs("top_defect_families"), pairs("top_rule_ids"),
        reps.alias("representative_issues"))


# ---------------------------------------------------------------------------
# 2.9 streaming operators (batch forms; stream twins are unit-tested equal)
from strata.streaming import rate_limit as RL  # noqa: E402
from strata.streaming import progress as PG  # noqa: E402

RATE_LIMIT_N = 2  # at most 3 events per user per clock hour in the data, so N = 2 exercises rejection


@register("rate_limit")
def q_rate_limit(spark, sf_dir):
    return RL.rate_limit(FX.requests(spark, sf_dir), RATE_LIMIT_N).select("key", "request_id", "admitted")


@register("progress_state")
def q_progress_state(spark, sf_dir):
    return PG.progress_state(FX.progress_events(spark, sf_dir)).select(
        "analysis_id", "status", "progress", "message", "current_step", "steps", "is_complete")


@register("progress_steps")
def q_progress_steps(spark, sf_dir):
    return PG.progress_steps(FX.progress_events(spark, sf_dir)).select(
        "analysis_id", "seq", "step", "message", "progress", BL.iso_utc("timestamp").alias("timestamp"))


@register("assemble_segments")
def q_assemble_segments(spark, sf_dir):
    from strata.streaming.rope import text_segments
    return text_segments(FX.summary_chunks(spark, sf_dir), 100).select(
        "analysis_id", "segment", "offset", "length", F.md5("text").alias("text_md5"))


@register("assemble_chunks")
def q_assemble_chunks(spark, sf_dir):
    out = PG.assemble_chunks(FX.summary_chunks(spark, sf_dir))
    return out.select("analysis_id", F.md5("summary").alias("summary_md5"),
                      F.length("summary").alias("summary_chars"), "chunks", "status", "progress")


# ---------------------------------------------------------------------------
# 2.7 rule catalogue
import uuid  # noqa: E402

from strata.operators import catalogue as CT  # noqa: E402
from strata.session import checkpoint_dir  # noqa: E402


def _scratch(spark, name):
    """A fresh folder under the shared checkpoint directory (never a machine-local temp dir)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("bulk_import_rules")
def q_bulk_import_rules(spark, sf_dir):
    v = CT.bulk_import_rules(FX.rule_imports(spark, sf_dir), FX.existing_rule_ids(spark, sf_dir))
    return v.select("idx", F.col("_rid").alias("rule_id"), "status", "error")


@register("import_rules_csv")
def q_import_rules_csv(spark, sf_dir):
    # several files, in the batch's order; fields with quotes doubled as ordinary writers have them
    path = _scratch(spark, "rules-csv")
    batch = FX.rule_imports(spark, sf_dir).withColumn("is_active", F.col("is_active").cast("string"))
    batch.repartitionByRange(4, "idx").sortWithinPartitions("idx").write.options(header=True, escape='"').csv(path)
    v = CT.bulk_import_rules(CT.read_rules_csv(spark, path), FX.existing_rule_ids(spark, sf_dir), "position")
    return v.select(F.col("idx").cast("bigint").alias("idx"), F.col("_rid").alias("rule_id"), "status", "error")


@register("import_rules_json")
def q_import_rules_json(spark, sf_dir):
    # several files of array documents (a thousand rules each at most), in the batch's order
    path = _scratch(spark, "rules-json")
    batch = FX.rule_imports(spark, sf_dir)
    (batch.groupBy(F.floor(F.col("idx") / 1000).alias("document"))
     .agg(F.to_json(F.sort_array(F.collect_list(F.struct(*batch.columns)))).alias("value"))
     .repartitionByRange(4, "document").sortWithinPartitions("document").select("value").write.text(path))
    v = CT.bulk_import_rules(CT.read_rules_json(spark, path), FX.existing_rule_ids(spark, sf_dir),
                             "position")
    return v.select(F.col("idx").cast("bigint").alias("idx"), F.col("_rid").alias("rule_id"), "status", "error")


@register("list_rules")
def q_list_rules(spark, sf_dir):
    v = CT.bulk_import_rules(FX.rule_imports(spark, sf_dir), FX.existing_rule_ids(spark, sf_dir))
    created = CT.created_rules(v).withColumn("created_at", F.lit(FX.FIXTURE_CREATED).cast("timestamp"))
    return CT.list_rules(created, severity="high", is_active=True).select(
        "rule_id", "name", "language", "defect_family", "severity", "match_type")


def _seeded(spark, sf_dir, existing=None):
    return CT.seed_rules(FX.seed_specs(spark, sf_dir), FX.seed_families(spark, sf_dir),
                         FX.seed_overrides(spark, sf_dir), existing)


@register("seed_rules")
def q_seed_rules(spark, sf_dir):
    return _seeded(spark, sf_dir, FX.seed_existing(spark, sf_dir)).select(
        "rule_id", "name", "language", "defect_family", "severity", "match_type", "message", "is_active")


@register("apply_rule_changes")
def q_apply_rule_changes(spark, sf_dir):
    out = CT.apply_rule_changes(_seeded(spark, sf_dir), FX.rule_changes(spark, sf_dir))
    return out.select("rule_id", *CT.UPDATE_FIELDS, "is_active")


# ---------------------------------------------------------------------------
# incremental re-analysis
from strata.operators import rescan as RS  # noqa: E402


@register("latest_analysis")
def q_latest_analysis(spark, sf_dir):
    return RS.latest_analysis(FX.analyses(spark, sf_dir)).select(
        "repo_url", "project_id", "id", "status", BL.iso_utc("created_at").alias("created_at"))


@register("rescan_decision")
def q_rescan_decision(spark, sf_dir):
    return RS.rescan_decision(FX.rescan_requests(spark, sf_dir), FX.analyses(spark, sf_dir)).select(
        "request_id", "decision", "analysis_id")


@register("snapshot_changes")
def q_snapshot_changes(spark, sf_dir):
    from strata.operators import snapshots as SN
    return SN.changed_files(SN.snapshot(FX.files(spark, sf_dir)), SN.snapshot(FX.files_snapshot_b(spark, sf_dir)))


@register("changed_files")
def q_changed_files(spark, sf_dir):
    return RS.changed_files(FX.files(spark, sf_dir), FX.files_snapshot_b(spark, sf_dir))


def _scan_findings(spark, files):
    from strata.operators.scan import scan_line_engines
    raw = scan_line_engines(scannable_filter(files), {"regex": FX.rules(spark), "external": FX.external_rules(spark)})
    return FD.dedupe_findings(raw)


@register("merge_rescan")
def q_merge_rescan(spark, sf_dir):
    old, new = FX.files(spark, sf_dir), FX.files_snapshot_b(spark, sf_dir)
    changed = land(RS.changed_files(old, new), "changed")  # a few columns, used three times
    rescan_paths = changed.filter(F.col("change") != "removed")
    to_scan = new.join(rescan_paths.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    merged = RS.merge_rescan(FX.findings(spark, sf_dir), _scan_findings(spark, to_scan), changed)
    return merged.select(*FINDING_OUT)


# ---------------------------------------------------------------------------
# membership and administration
from strata.operators import admin as AD  # noqa: E402


@register("project_listing")
def q_project_listing(spark, sf_dir):
    out = AD.project_listing(FX.memberships(spark, sf_dir), FX.projects(spark, sf_dir), FX.analyses(spark, sf_dir))
    return out.select("user_id", "project_id", "role", "position", "collaborators", "latest_analysis_id", "latest_status")


@register("audit_feed")
def q_audit_feed(spark, sf_dir):
    out = AD.audit_feed(FX.audit_logs(spark, sf_dir), FX.users(spark, sf_dir), 200)
    return out.select("id", "admin", "action", "target_id", F.col("details")["k"].alias("detail_k"),
                      BL.iso_utc("created_at").alias("created_at"))


@register("deletion_impact")
def q_deletion_impact(spark, sf_dir):
    return AD.deletion_impact(FX.memberships(spark, sf_dir), FX.analyses(spark, sf_dir))


@register("system_stats")
def q_system_stats(spark, sf_dir):
    return AD.system_stats(FX.users(spark, sf_dir), FX.projects(spark, sf_dir), FX.analyses(spark, sf_dir),
                           FX.files(spark, sf_dir))


@register("user_usage")
def q_user_usage(spark, sf_dir):
    out = AD.user_usage(FX.users(spark, sf_dir), FX.memberships(spark, sf_dir), FX.analyses(spark, sf_dir))
    return out.select("user_id", "username", "projects", "analyses", "storage_bytes",
                      BL.iso_utc("created_at").alias("created_at"))


@register("user_projects")
def q_user_projects(spark, sf_dir):
    return AD.user_projects(FX.memberships(spark, sf_dir), FX.projects(spark, sf_dir)).select(
        "user_id", "project_id", "repo_name", "role")


@register("project_collaborators")
def q_project_collaborators(spark, sf_dir):
    return AD.project_collaborators(FX.memberships(spark, sf_dir), FX.users(spark, sf_dir)).select(
        "project_id", "user_id", "username", "role", BL.iso_utc("added_at").alias("added_at"))


@register("repo_inventory")
def q_repo_inventory(spark, sf_dir):
    out = AD.repo_inventory(FX.projects(spark, sf_dir), FX.memberships(spark, sf_dir), FX.analyses(spark, sf_dir))
    return out.select("project_id", "repo_name", "analysis_count", "total_issues", "status",
                      BL.iso_utc("last_analyzed").alias("last_analyzed"), "members")


@register("project_tiles")
def q_project_tiles(spark, sf_dir):
    return AD.project_tiles(FX.memberships(spark, sf_dir), FX.analyses(spark, sf_dir))


# ---------------------------------------------------------------------------
# stack detection and authored files
from strata.operators import stack as ST  # noqa: E402


def _joined(col):
    return F.array_join(F.col(col), ",").alias(col)


@register("detect_stack")
def q_detect_stack(spark, sf_dir):
    out = ST.detect_stack(FX.files_with_manifests(spark, sf_dir))
    return out.select("repo_id", "language", "manifest", _joined("extensions"), _joined("src_dirs"), _joined("frameworks"))


@register("detect_frameworks")
def q_detect_frameworks(spark, sf_dir):
    out = ST.detect_frameworks(ST.manifest_stack(FX.files_with_manifests(spark, sf_dir)))
    return out.select("repo_id", "manifest", _joined("frameworks"))


@register("fallback_stack")
def q_fallback_stack(spark, sf_dir):
    f = FX.files_with_manifests(spark, sf_dir)
    out = ST._restrict_dirs(ST.fallback_stack(f), ST.existing_dirs(f))
    return out.select("repo_id", "language", _joined("extensions"), _joined("src_dirs"))


@register("authored_files")
def q_authored_files(spark, sf_dir):
    f = FX.files_with_manifests(spark, sf_dir)
    return ST.authored_files(f, ST.detect_stack(f), 80)


# ---------------------------------------------------------------------------
# JSON columns, normalisation, multiline scan, engine registry, incremental stream
from strata.sources import json_columns as JC  # noqa: E402


@register("decode_analysis_json")
def q_decode_analysis_json(spark, sf_dir):
    out = JC.decode_analysis_json(FX.props_json(spark, sf_dir), {"languages": "map<string,bigint>"})
    return out.select("event_id", F.size("languages").alias("n_keys"), F.col("languages")["k"].alias("k"))


ISSUE_JSON_SCHEMA = ("rule_id string, severity string, defect_family string, category string, message string, "
                     "file_path string, line_number int, engine_source string, issue_type string")


@register("normalize_issue")
def q_normalize_issue(spark, sf_dir):
    s = FX.stored_issues(spark, sf_dir)
    dec = s.select("repo_id", "_path", "_line", "_rule", F.from_json("issue_json", ISSUE_JSON_SCHEMA).alias("i")).select(
        "repo_id", "_path", "_line", "_rule", "i.*")
    out = FD.normalize_issue(dec)
    return out.select("repo_id", "_path", "_line", "_rule", "rule_id", "defect_family", "severity", "message",
                      "line_number", "engine_source", "code_snippet")


@register("export_report_json")
def q_export_report_json(spark, sf_dir):
    analyses = FX.repo_analyses(spark, sf_dir)
    issues = land(_attributed(spark, sf_dir), "attributed")
    reports = JC.completed_reports(analyses, issues, FX.files(spark, sf_dir))
    people = JC.report_contributors(analyses, issues).groupBy("analysis_id").agg(
        F.count(F.lit(1)).alias("contributors"), F.sum("count").cast("long").alias("attributed_issues"))
    severities = F.array_join(F.transform("severity_summary", lambda x: F.concat_ws(":", x["severity"], x["count"].cast("string"))), ",")
    return reports.join(people, "analysis_id", "left").select(
        "analysis_id", "repository", BL.iso_utc("analyzed_at").alias("analyzed_at"), "health_score", "total_files",
        "total_lines", "total_issues", severities.alias("severity_summary"),
        F.coalesce("contributors", F.lit(0)).alias("contributors"),
        F.coalesce("attributed_issues", F.lit(0)).alias("attributed_issues"))


@register("scan_multiline_rules")
def q_scan_multiline_rules(spark, sf_dir):
    files = scannable_filter(FX.files(spark, sf_dir))
    return SC.scan_multiline_rules(files, FX.multiline_rules(spark)).select(*FINDING_OUT)


@register("run_engines")
def q_run_engines(spark, sf_dir):
    files = scannable_filter(FX.files(spark, sf_dir))
    rules = FX.rules(spark, FX.FIXTURE_RULES + FX.FIXTURE_MULTILINE_RULES)
    return SC.run_engines(files, rules).select(*FINDING_OUT, "engine_order")


@register("incremental_scan")
def q_incremental_scan(spark, sf_dir):
    from strata.streaming.incremental import IncrementalScan
    old, new = FX.files(spark, sf_dir), FX.files_snapshot_b(spark, sf_dir)
    findings = FX.findings(spark, sf_dir).select(*FINDING_OUT)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in findings.schema)
    job = IncrementalScan(spark, lambda fl: _scan_findings(spark, fl).select(*FINDING_OUT), schema)
    job.seed(old, findings)
    # the feed: the later snapshot's files, and a deletion for each file it no longer has
    gone = old.join(new.select("repo_id", "path"), ["repo_id", "path"], "left_anti").select(
        "repo_id", "path", *[F.lit(None).cast(new.schema[c].dataType).alias(c) for c in ("content", "size", "language", "lines")])
    feed = new.withColumn("deleted", F.lit(False)).unionByName(gone.withColumn("deleted", F.lit(True)))
    src = f"{job.root}/incoming"
    feed.write.parquet(src)
    return job.run(spark.readStream.schema(feed.schema).parquet(src)).select(*FINDING_OUT)


@register("import_first_errors")
def q_import_first_errors(spark, sf_dir):
    v = CT.bulk_import_rules(FX.rule_imports(spark, sf_dir), FX.existing_rule_ids(spark, sf_dir))
    return CT.first_errors(v)
