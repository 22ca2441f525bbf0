"""Adapters from the driver's parquet tables to the logical tables (FIXTURES.md C).

The operators only know the logical schemas; these projections are
deterministic, every chosen row has a total order, and each one has the same
expression in the oracle SQL (``strata.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata import schemas as S
from strata.functions.languages import detect_language
from strata.functions.text import line_count
from strata.session import table

# FIXED VALUES (fixture): suffix cycle and top directory cycle for document-backed files
FIXTURE_EXTS = [".py", ".js", ".ts", ".java", ".go", ".rb", ".php", ".c", ".cpp", ".cs",
                ".rs", ".kt", ".swift", ".sh", ".md", ".txt", ".dart", ".json", ".min.js", ".lock",
                ".rake", ".zsh", ".hpp", ".es6", ".php5", ".wsgi", ".csx", ".jsx", ".unknown"]
FIXTURE_DIRS = ["src", "app", "lib", "src/core", "tests", "node_modules", "build", "vendor", ""]

# FIXED VALUES (fixture): regex-engine rules that hit the generated documents.
# (rule_id, language, defect_family, severity, pattern, match_type, is_active)
FIXTURE_RULES = [
    ("SEC-TOKEN-LITERAL", "any", "secrets", "critical", r'(api_key|secret|password|token)\s*=\s*"[0-9a-f]{8,}"', "regex_line", True),
    ("NET-IPV4-LITERAL", "any", "best_practice", "low", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "regex_line", True),
    ("REGEX-LICENSE-HEADER", "python", "maintainability", "info", r"Licen[sc]e", "regex_line", True),
    ("PII-EMAIL", "any", "secrets", "medium", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "regex_line", True),
    ("PII-PHONE", "javascript", "injection", "high", r"\+1 \([0-9]{3}\) 555-[0-9]{4}", "regex_line", True),
    ("STYLE-ANY-E", "any", "maintainability", "trace", r"e", "regex_line", False),
    ("EXT-ERROR-EVENT", "any", "injection", "critical", "", "ast_semgrep", True),
]
# FIXED VALUES (fixture): second engine, overlapping two rule ids at other severities
FIXTURE_EXTERNAL_RULES = [
    ("SEC-TOKEN-LITERAL", "any", "secrets", "blocker", r'token = "', "regex_line", True),
    ("NET-IPV4-LITERAL", "any", "best_practice", "info", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "regex_line", True),
    ("EXT-MAIL-HOST", "any", "ssrf", "high", r"mail[0-9]+\.example\.com", "regex_line", True),
]
# FIXED VALUES (fixture): a multiline rule (unit-tested; no SQL oracle)
FIXTURE_MULTILINE_RULES = [
    ("ML-TOKEN-NEXT-LINE", "any", "secrets", "high", r'token = "[0-9a-f]+"[^\n]*\n[^\n]*[A-Z]', "regex_multiline", True),
]

FIXTURE_CREATED = "2026-01-01 00:00:00"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> files: repo = source, synthetic path, content = text."""
    return files_from_documents(table(spark, sf_dir, "documents"))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id of every repository: one narrow column, pre-aggregated, without the texts."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id")).distinct()


def repo_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis per repository, some (by name) still running or without an end time."""
    r = repos(spark, sf_dir)
    return r.select(F.concat(F.lit("analysis-"), "repo_id").alias("id"), "repo_id",
                    F.concat(F.lit("https://github.com/org/"), "repo_id").alias("repo_url"),
                    F.when(F.col("repo_id").endswith("5"), "analyzing").otherwise("complete").alias("status"),
                    F.lit(FIXTURE_CREATED).cast("timestamp").alias("created_at"),
                    F.when(~F.col("repo_id").endswith("7"), (F.lit(FIXTURE_CREATED).cast("timestamp")
                                                             + F.expr("INTERVAL 1 HOUR"))).alias("completed_at"))


def files_snapshot_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later snapshot: every 7th document edited, every 11th removed, every 13th copied to a new path."""
    d = table(spark, sf_dir, "documents")
    kept = d.filter(F.col("doc_id") % 11 != 0).withColumn(
        "text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("text"), F.lit(" edited"))).otherwise(F.col("text")))
    b = files_from_documents(kept)
    extra = files_from_documents(d.filter(F.col("doc_id") % 13 == 0)).withColumn(
        "path", F.concat(F.col("path"), F.lit(".bak")))
    return b.unionByName(extra)


def files_from_documents(d: DataFrame) -> DataFrame:
    n_ext, n_dir = len(FIXTURE_EXTS), len(FIXTURE_DIRS)
    ext = F.element_at(F.array(*[F.lit(x) for x in FIXTURE_EXTS]), (F.col("doc_id") % n_ext + 1).cast("int"))
    top = F.element_at(F.array(*[F.lit(x) for x in FIXTURE_DIRS]),
                       (F.floor(F.col("doc_id") / n_ext) % n_dir + 1).cast("int"))
    name = F.concat(F.col("doc_id").cast("string"), ext)
    path = F.when(top == "", name).otherwise(F.concat_ws("/", top, F.col("lang"), name))
    base = d.select(F.col("source").alias("repo_id"), path.alias("path"), F.col("text").alias("content"),
                    F.octet_length("text").cast("long").alias("size"))
    # The landing job: each driver table is one file of one row group, so its rows are dealt by file once,
    # unconditionally; text work runs in parallel and consumers share the exchange.
    base = base.repartition("repo_id", "path")
    out = detect_language(base)
    return out.select("repo_id", "path", "content", "size", "language",
                      line_count("content").alias("lines"))


def rule_rows(spec) -> list[tuple]:
    rows = []
    for rid, lang, fam, sev, pat, mt, active in spec:
        rows.append((rid, rid.replace("-", " ").title(), None, lang, fam, sev, pat, mt,
                     f"{rid} matched", None, None, None, active, None, None))
    return rows


def rules(spark: SparkSession, spec=None) -> DataFrame:
    spec = FIXTURE_RULES if spec is None else spec
    created = F.lit(FIXTURE_CREATED).cast("timestamp")
    return (spark.createDataFrame(rule_rows(spec), S.RULES)
            .withColumn("created_at", created).withColumn("updated_at", created))


def external_rules(spark: SparkSession) -> DataFrame:
    return rules(spark, FIXTURE_EXTERNAL_RULES)


def multiline_rules(spark: SparkSession) -> DataFrame:
    return rules(spark, FIXTURE_MULTILINE_RULES)


def raw_findings(spark: SparkSession, sf_dir: str, file_table: DataFrame | None = None) -> DataFrame:
    """Both fixture engines over the scannable files, before de-duplication."""
    from strata.functions.languages import scannable_filter
    from strata.operators.scan import scan_line_engines

    f = scannable_filter(files(spark, sf_dir) if file_table is None else file_table)
    return scan_line_engines(f, {"regex": rules(spark), "external": external_rules(spark)})


def findings(spark: SparkSession, sf_dir: str, file_table: DataFrame | None = None) -> DataFrame:
    """De-duplicated findings (the ``issues`` list before enrichment).

    Pass the query's own ``file_table`` when it also reads the files, so both
    branches share one scan (and one exchange) of the documents."""
    from strata.operators.findings import dedupe_findings
    return dedupe_findings(raw_findings(spark, sf_dir, file_table))


def blame_lines(spark: SparkSession, sf_dir: str, file_table: DataFrame | None = None,
                only_files: DataFrame | None = None) -> DataFrame:
    """lineitem -> one blamed line per row.

    file = l_orderkey: the document file of that id where there is one (so issues
    and blame meet), else a file of its own; line = position among the order's
    distinct line numbers, author = supplier, commit = part key, ts = ship date.
    ``only_files`` (repo_id, path) restricts the work to those files before any
    window runs.
    """
    li = table(spark, sf_dir, "lineitem")
    paths = (files(spark, sf_dir) if file_table is None else file_table).select(
        "repo_id", "path", F.regexp_extract("path", r"([0-9]+)[^/]*$", 1).cast("long").alias("_doc"))
    if only_files is not None:
        paths = paths.join(only_files.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
        li = li.join(paths.select("_doc"), li.l_orderkey == F.col("_doc"), "left_semi")
    # One window spec does both jobs: keep the first row of each (order, line number)
    # under a total order, and number the kept rows by dense rank of the line number.
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", *[F.col(c) for c in li.columns if c != "l_orderkey"])
    marked = li.select("*", F.lag("l_linenumber").over(w).alias("_prev"),
                       F.dense_rank().over(w.orderBy("l_linenumber")).alias("_dr"))
    numbered = (marked.filter(F.col("_prev").isNull() | (F.col("_prev") != F.col("l_linenumber")))
                .withColumn("line_number", F.col("_dr").cast("int")))
    own = F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string"), F.lit(".sql"))
    return numbered.join(paths, numbered.l_orderkey == paths._doc, "left").select(
        F.coalesce("repo_id", F.lit("orders")).alias("repo_id"), F.coalesce("path", own).alias("file_path"), "line_number",
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("author_name"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("@example.com")).alias("author_email"),
        F.lpad(F.hex(F.col("l_partkey")), 40, "0").alias("commit"),
        F.col("l_shipdate").alias("ts"),
        F.concat_ws(" ", F.col("l_returnflag"), F.col("l_linestatus")).alias("content"))


def blame_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blamed lines regrouped into per-file ordered segments (one line each)."""
    bl = blame_lines(spark, sf_dir)
    seg = F.struct("line_number", F.struct(
        "commit", "author_name", "author_email", "ts", F.array("content").alias("lines")).alias("s"))
    return (bl.groupBy("repo_id", "file_path").agg(F.sort_array(F.collect_list(seg)).alias("_s"))
            .select("repo_id", "file_path", F.transform("_s", lambda x: x["s"]).alias("segments")))


# FIXED VALUES (fixture): event type -> commit verb, so history classification sees every case
COMMIT_VERBS = [("click", "refactor"), ("view", "fix"), ("signup", "rename"), ("error", "remove"), ("purchase", "add")]


def _verb(col):
    out = F.lit("update")
    for et, verb in reversed(COMMIT_VERBS):
        out = F.when(col == et, F.lit(verb)).otherwise(out)
    return out


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> commits: file = props.k, author = user, message = event type."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.lit("events").alias("repo_id"),
        F.concat(F.lit("src/file_"), k, F.lit(".py")).alias("file_path"),
        F.lpad(F.hex(F.col("event_id")), 40, "0").alias("commit"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"),
        F.col("ts"),
        F.concat(_verb(F.col("event_type")), F.lit(" "), F.col("event_type"), F.lit(" #"),
                 F.col("event_id").cast("string")).alias("message"),
        F.floor("value").cast("int").alias("insertions"),
        (F.col("event_id") % 7).cast("int").alias("deletions"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), "ts",
                    F.col("event_id").alias("request_id"), F.col("event_type").alias("action"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_n"))
    status = (F.when(F.col("o_orderstatus") == "P", "analyzing")
              .when(F.col("o_orderstatus") == "O", "complete").otherwise("failed"))
    j = o.join(li, o.o_orderkey == li.l_orderkey, "left")
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("o_custkey")).alias("project_id"),
        F.concat(F.lit("https://github.com/org"), F.col("o_custkey").cast("string"), F.lit("/repo")).alias("repo_url"),
        status.alias("status"),
        F.when(status == "complete", F.floor(F.col("o_totalprice") % 101).cast("int")).alias("health_score"),
        F.floor(F.col("o_totalprice") * 100).cast("long").alias("storage_bytes"),
        F.coalesce(F.col("_n"), F.lit(0)).cast("int").alias("total_issues"),
        F.col("o_orderdate").alias("created_at"),
        F.when(status != "analyzing", F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("completed_at"),
        F.when(F.col("o_orderkey") % 6 == 0, F.lit(None).cast("string"))
         .otherwise(F.substring(F.sha2(F.col("o_custkey").cast("string"), 256), 1, 40)).alias("commit_sha"))


def part_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> commit details for the blame fixture's commits (commit = part key)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.lpad(F.hex("p_partkey"), 40, "0").alias("commit"), F.col("p_brand").alias("author"),
                    F.concat_ws("\n", "p_name", "p_type").alias("message"))


def commit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commits -> log lines (repo_id, file_path, line_no, line), newest commit first: per commit a header, a
    hunk marker, a context line and N added lines.

    Commits are numbered, not their lines: a line's number is the running total of lines before its commit and its
    place there.  Lines of commits that share time and hash come by their places, so these few are numbered one by one.
    """
    from strata.operators.positions import null_safe_join, positions, sequenced
    from strata.session import land
    c = commits(spark, sf_dir)
    subject = F.when(F.col("deletions") == 0, F.concat(F.col("message"), F.lit(" | extra"))).otherwise(F.col("message"))
    header = F.concat_ws("|", F.col("commit"), F.concat(F.col("author"), F.lit("@example.com")),
                         F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), subject)
    file, newest = ["repo_id", "file_path"], [F.col("ts").desc(), F.col("commit").desc()]
    short = c.select(*file, "ts", "commit", header.alias("_header"), (F.abs(F.col("insertions")) % 20 + 1).cast("int").alias("_adds"),
                     F.struct("ts", "commit").alias("_key"))
    # a commit without a number of lines has none
    size = F.coalesce(F.col("_adds") + 3, F.lit(0))
    placed = land(sequenced(short, file, newest, "_nth", {"_end": size}, neighbours=("_key",)).select(
        *file, "ts", "commit", "_header", "_adds", (F.col("_end") - size).alias("_before"),
        (F.col("_key").eqNullSafe(F.col("previous__key")) | F.col("_key").eqNullSafe(F.col("next__key"))).alias("_shared")), "commits")
    adds = F.transform(F.sequence(F.lit(1), F.col("_adds")), lambda i: F.concat(F.lit("+add "), i.cast("string")))
    lines = F.posexplode(F.concat(F.array(F.col("_header"), F.lit("@@ -1 +1 @@"), F.lit(" context")), adds)).alias("_i", "line")
    out = placed.filter("NOT _shared").select(*file, "_before", lines).select(
        *file, (F.col("_before") + F.col("_i") + 1).alias("line_no"), "line")
    shared = placed.filter("_shared")
    if shared.isEmpty():
        return out
    group = [*file, "ts", "commit"]
    numbered = positions(shared.select(*group, lines), group, [F.col("_i")], "_nth")
    begins = shared.groupBy(*group).agg(F.min("_before").alias("_before"))
    return out.union(null_safe_join(numbered, begins, group).select(*file, (F.col("_before") + F.col("_nth")).alias("line_no"), "line"))


def file_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commits -> diffs of two change stretches, the second after a context line; files whose number ends in 7 have
    none (binary)."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    old1, new1, old2, new2 = i % 3, F.floor(i / 3) % 3 + F.when(i % 9 == 0, 1).otherwise(0), F.floor(i / 9) % 2, F.floor(i / 18) % 4
    begin1 = 1 + (i * 7) % 40
    begin2 = begin1 + old1 + 3 + i % 11  # the context line

    def text(*parts):
        return F.concat(*[p.cast("string") if isinstance(p, F.Column) else F.lit(p) for p in parts])

    def lines(sign, n):
        return F.transform(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>")),
                           lambda x: F.concat(F.lit(sign + "line "), x.cast("string")))

    def at(begin, n):  # an empty side names the line before it
        return begin - F.when(n == 0, 1).otherwise(0)

    head1 = text("@@ -", at(begin1, old1), ",", old1, " +", at(begin1, new1), ",", new1, " @@ def f():")
    head2 = text("@@ -", begin2, ",", old2 + 1, " +", begin2 + new1 - old1, ",", new2 + 1, " @@")
    body = F.concat(F.array(F.lit("--- a/file"), F.lit("+++ b/file"), head1), lines("-", old1), lines("+", new1),
                    F.array(head2, F.lit(" context")), lines("-", old2), lines("+", new2))
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.lit("events").alias("repo_id"), F.concat(F.lit("src/file_"), k, F.lit(".py")).alias("file_path"),
        F.lpad(F.hex("event_id"), 40, "0").alias("commit"), "ts",
        F.when(~k.endswith("7"), F.array_join(body, "\n")).alias("diff"))


def line_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> lines to trace (1 to 60 of the event's file)."""
    return commits(spark, sf_dir).select("repo_id", "file_path", (F.conv(F.col("commit"), 16, 10).cast("long") % 60 + 1)
                                         .alias("line_number"))


# FIXED VALUES (fixture): event type -> scanner category, one per cascade branch family
EXTERNAL_CATEGORIES = [("click", "xss"), ("view", "path-traversal"), ("signup", "jwt"),
                       ("purchase", "dependency"), ("error", "sql")]


def external_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> one scanner report per event (JSON text), exercising every branch:
    list and string metadata, missing severity, backslash paths, a check id that
    names a catalogue rule (error events)."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    check = F.when(F.col("event_type") == "error", F.lit("EXT-ERROR-EVENT")).otherwise(
        F.concat(F.lit("lang.security."), F.col("event_type"), F.lit(".check_"), k))
    sep = F.when(F.col("event_id") % 2 == 1, F.lit("\\\\")).otherwise(F.lit("/"))
    path = F.concat(F.lit("src"), sep, F.lit("file_"), k, F.lit(".py"))
    sev_word = F.element_at(F.array(F.lit("ERROR"), F.lit("WARNING"), F.lit("INFO"), F.lit("")),
                            (F.col("event_id") % 4 + 1).cast("int"))
    cwe = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["CWE-'), k, F.lit('"]'))).otherwise(
        F.concat(F.lit('"CWE-'), k, F.lit('"')))
    line = (F.col("event_id") % 50).cast("string")
    category = F.lit("none")
    for et, cat in reversed(EXTERNAL_CATEGORIES):
        category = F.when(F.col("event_type") == et, F.lit(cat)).otherwise(category)
    report = F.concat(
        F.lit('{"results":[{"check_id":"'), check, F.lit('","path":"'), path,
        F.lit('","start":{"line":'), line, F.lit(',"col":3},"end":{"line":'), line,
        F.lit('},"extra":{"severity":"'), sev_word, F.lit('","message":"'), F.col("event_type"),
        F.lit(' seen","lines":"x = '), k, F.lit('","metadata":{"category":"'), category,
        F.lit('","cwe":'), cwe, F.lit('}}}]}'))
    return e.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("repo_id"),
                    F.col("event_id"), report.alias("report"))


# FIXED VALUES (fixture): scanner words and check names, one per branch of the mappings and some that fit none
SCANNER_WORDS = ["ERROR", "warning", "Info", "", "NOTE", None]
SCANNER_CHECKS = ["java.xss.echo", "ssrf-request", "path.traversal", "traverse.only", "pickle.loads", "LDAP.query",
                  "hardcoded-token", "weak.hash", "csrf.missing", "old.package", "style.tabs", "best.effort", "misc"]
SCANNER_CATEGORIES = ["", "security", "SQL", "session handling", None]


def scanner_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> severity words, checks and categories, with and without a rule's own severity and family."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        "event_id", _cycle(SCANNER_WORDS, i).alias("word"), _cycle(SCANNER_CHECKS, i).alias("check_id"),
        _cycle(SCANNER_CATEGORIES, F.floor(i / 13)).alias("category"),
        F.when(i % 7 == 0, "blocker").when(i % 7 == 1, "").alias("rule_severity"),
        F.when(i % 17 == 0, "auth").when(i % 17 == 1, "").alias("rule_family"))


def fix_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> model responses: mostly JSON objects, every tenth one cut short."""
    e = table(spark, sf_dir, "events")
    good = F.concat(F.lit('{"root_cause": "'), F.col("event_type"), F.lit('", "code_patch": "p'),
                    F.col("event_id").cast("string"), F.lit('", "confidence": '),
                    F.format_string("%.4f", F.col("value") / 50), F.lit(', "reasoning": ["a", "'),
                    F.col("event_type"), F.lit('"]}'))
    bad = F.concat(F.lit('{"root_cause": "'), F.col("event_type"))
    return e.select("event_id", F.when(F.col("event_id") % 10 == 0, bad).otherwise(good).alias("response"))


# FIXED VALUES (fixture): event type -> analysis status for progress events
PROGRESS_STATUS = [("view", "cloning"), ("click", "analyzing"), ("signup", "scanning"),
                   ("purchase", "complete"), ("error", "failed")]


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.lit("queued")
    for et, st in reversed(PROGRESS_STATUS):
        status = F.when(F.col("event_type") == et, F.lit(st)).otherwise(status)
    return e.select(
        F.col("user_id").cast("string").alias("analysis_id"), F.col("event_id").alias("seq"),
        F.col("event_type"), status.alias("status"),
        F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("value")))).cast("int").alias("progress"),
        F.concat(F.col("event_type"), F.lit(" #"), F.col("event_id").cast("string")).alias("message"),
        F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.col("event_type")).alias("step"),
        F.col("ts"))


def summary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> summary chunk events: system turns mark the summary unavailable; some later turns
    replace the whole text (every ninth of those failed), complete the analysis, or report a failure."""
    c = table(spark, sf_dir, "conversations")
    mark = F.col("conv_id") * 3 + F.col("turn")
    kind = (F.when(F.col("role") == "system", "unavailable").when(mark % 11 == 5, "summary")
            .when(mark % 7 == 3, "complete").when(mark % 29 == 8, "failed").otherwise("chunk"))
    return c.select(F.col("conv_id").alias("analysis_id"), F.col("turn").alias("seq"), kind.alias("kind"), "text",
                    F.when(mark % 9 == 0, "failed").otherwise("complete").alias("outcome"))


# ---------------------------------------------------------------------------
# rule catalogue fixtures (derived from part and events)
# FIXED VALUES (fixture): value cycles that put every validation branch in the import batch
IMPORT_SEVERITIES = ["low", "HIGH", "critical", "urgent", "medium", "info", "trace", "blocker", "high"]
IMPORT_MATCH_TYPES = ["regex_line", "regex_multiline", "ast_semgrep", "glob"]
SEED_LANGUAGES = ["python", "javascript", "go", "java"]
SEED_SEVERITIES = ["low", "medium", "high", "critical"]


def _cycle(values, idx):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values) + 1).cast("int"))


def rule_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> an import batch with missing ids, duplicates, blanks and bad values."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    fam = F.element_at(F.array(*[F.lit(v) for v in S.DEFECT_FAMILIES + ["perf"]]), (k % 13 + 1).cast("int"))
    return p.select(
        k.alias("idx"),
        F.when(k % 97 == 0, F.lit("")).otherwise(F.concat(F.lit("P-"), (k % 1500).cast("string"))).alias("rule_id"),
        F.col("p_name").alias("name"),
        F.when(k % 41 == 0, F.lit("  ")).otherwise(F.col("p_brand")).alias("pattern"),
        F.col("p_type").alias("message"),
        _cycle(IMPORT_SEVERITIES, F.col("p_size")).alias("severity"),
        fam.alias("defect_family"),
        _cycle(IMPORT_MATCH_TYPES, F.col("p_size")).alias("match_type"),
        F.lit("any").alias("language"),
        (F.col("p_size") % 2 == 0).alias("is_active"))


def existing_rule_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue an import runs against: the fixture rules plus ids derived from part."""
    p = table(spark, sf_dir, "part")
    derived = p.filter(F.col("p_partkey") % 100 == 3).select(
        F.concat(F.lit("P-"), (F.col("p_partkey") % 1500).cast("string")).alias("rule_id"))
    fixed = spark.createDataFrame([(r[0],) for r in FIXTURE_RULES], "rule_id string")
    return derived.unionByName(fixed)


def seed_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    langs = F.slice(F.array(*[F.lit(v) for v in SEED_LANGUAGES]), 1, (F.col("p_size") % 4).cast("int"))
    return p.select(
        F.concat(F.lit("part-"), (k % 400).cast("string")).alias("id"), k.alias("seq"), langs.alias("languages"),
        F.concat(F.col("p_name"), F.when(k % 10 == 0, F.lit("\\n")).otherwise(F.lit(""))).alias("pattern"),
        _cycle(SEED_SEVERITIES, k).alias("severity"), F.col("p_type").alias("message"))


def seed_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 400).alias("n")).distinct()
    return p.select(F.concat(F.lit("part-"), F.col("n").cast("string")).alias("id"),
                    _cycle(S.DEFECT_FAMILIES, F.col("n")).alias("defect_family"))


def seed_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 400).alias("n")).distinct()
    return p.filter(F.col("n") % 50 == 0).select(F.concat(F.lit("part-"), F.col("n").cast("string")).alias("id"),
                                                F.lit("trace").alias("severity"))


def seed_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 400).alias("n")).distinct()
    return p.filter(F.col("n") % 30 == 0).select(F.concat(F.lit("REGEX-part-"), F.col("n").cast("string")).alias("rule_id"))


def rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> a rule change feed over the seeded catalogue."""
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    action = (F.when(et == "click", "toggle").when(et == "view", "update").when(et == "signup", "update")
              .when(et == "purchase", "deactivate")
              .otherwise(F.when(F.col("event_id") % 7 == 0, F.lit("delete")).otherwise(F.lit("toggle"))))
    i = F.col("event_id")

    def some(event: str, every: int, at: int, value) -> F.Column:
        return F.when((et == event) & (i % every == at), value)

    def said(text: str, number=None) -> F.Column:
        return F.concat(F.lit(text), (i if number is None else number).cast("string"))

    return e.select(
        F.concat(F.lit("REGEX-part-"), (F.col("user_id") % 60).cast("string")).alias("rule_id"),
        F.col("event_id").alias("seq"), action.alias("action"),
        F.when(et == "view", _cycle(["low", "medium", "high"], F.col("event_id"))).alias("severity"),
        F.when(et == "signup", said("msg ")).alias("message"),
        some("view", 5, 1, said("name ")).alias("name"), some("signup", 3, 0, said("text ")).alias("description"),
        some("view", 4, 1, _cycle(SEED_LANGUAGES, i)).alias("language"),
        some("signup", 6, 1, _cycle(["secrets", "injection"], i)).alias("defect_family"),
        some("view", 7, 2, said("p")).alias("pattern"), some("signup", 8, 3, F.lit("regex_multiline")).alias("match_type"),
        some("view", 3, 2, said("hint ")).alias("fix_hint"), some("signup", 2, 0, said("CWE-", i % 900)).alias("cwe_id"),
        some("view", 11, 4, said("A0", i % 10)).alias("owasp_ref"),
        F.coalesce(some("view", 9, 0, F.lit(False)), some("signup", 9, 0, F.lit(True))).alias("is_active"))


def rescan_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> analysis requests covering every decision branch."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    same = F.substring(F.sha2(k.cast("string"), 256), 1, 40)
    head = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, F.lit("f" * 40)).otherwise(same)
    return c.select(k.alias("request_id"),
                    F.concat(F.lit("https://github.com/org"), k.cast("string"), F.lit("/repo")).alias("repo_url"),
                    F.when(k % 10 == 0, F.lit(None)).otherwise(k).alias("project_id"),
                    (k % 3 != 0).alias("user_known"), (k % 5 == 0).alias("force"), head.alias("remote_head"))


# ---------------------------------------------------------------------------
# membership fixtures (customer = project, supplier = user)
# FIXED VALUES (fixture): membership role by (supplier + customer) mod 3
ROLES = ["owner", "editor", "viewer"]


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("username"),
                    F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@example.com")).alias("email"),
                    (F.col("s_suppkey") % 25 == 0).alias("is_admin"),
                    (F.lit("2024-01-01 00:00:00").cast("timestamp")
                     + F.make_interval(days=F.col("s_suppkey").cast("int"))).alias("created_at"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("id"), F.concat(F.lit("https://github.com/org"), k.cast("string"), F.lit("/repo")).alias("repo_url"),
                    F.concat(F.lit("org"), k.cast("string"), F.lit("/repo")).alias("repo_name"),
                    (F.lit("2023-01-01 00:00:00").cast("timestamp") + F.make_interval(hours=k.cast("int"))).alias("created_at"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (supplier, customer) pairs that share an order line."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("l_suppkey", "o_custkey").agg(
        F.min("l_shipdate").alias("added_at"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), ((F.col("l_suppkey") + F.col("o_custkey")) % 3 + 1).cast("int"))
    return pairs.select(F.col("l_suppkey").alias("user_id"), F.col("o_custkey").alias("project_id"),
                        role.alias("role"), "added_at")


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"),
                    F.when(F.col("event_id") % 4 != 0, F.col("user_id") % 100).alias("admin_id"),
                    F.col("event_type").alias("action"), F.lit("rule").alias("target_type"),
                    F.get_json_object("props", "$.k").alias("target_id"), F.col("props").alias("details"),
                    F.col("ts").alias("created_at"))


# FIXED VALUES (fixture): dependency names written into manifests (hit JS keys, python,
# Cargo and go.mod substrings)
MANIFEST_DEPS = ["react", "fastapi", "express", "django", "tokio", "gin-gonic", "vue", "flask"]


def files_with_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files plus one root-level manifest per selected document (first document wins a name)."""
    d = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 97 == 5)
    names = F.array(*[F.lit(m[0]) for m in S.MANIFESTS])
    n = len(S.MANIFESTS)
    dep1 = _cycle(MANIFEST_DEPS, F.col("doc_id"))
    dep2 = _cycle(MANIFEST_DEPS, F.floor(F.col("doc_id") / 8))
    content = F.concat(F.lit('{"dependencies": {"'), dep1, F.lit('": "1"}, "devDependencies": {"'), dep2, F.lit('": "2"}}'))
    m = d.select(F.col("source").alias("repo_id"),
                 F.element_at(names, (F.floor(F.col("doc_id") / 97) % n + 1).cast("int")).alias("path"),
                 content.alias("content"), "doc_id")
    w = Window.partitionBy("repo_id", "path").orderBy("doc_id")
    m = m.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "doc_id")
    m = m.select("repo_id", "path", "content", F.octet_length("content").cast("long").alias("size"))
    m = detect_language(m).select("repo_id", "path", "content", "size", "language", line_count("content").alias("lines"))
    return files(spark, sf_dir).unionByName(m)


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.props as stored JSON text; every ninth row is cut short (corrupt)."""
    e = table(spark, sf_dir, "events")
    txt = F.when(F.col("event_id") % 9 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    return e.select("event_id", txt.alias("languages"))


def stored_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """findings written back as JSON objects with fields dropped by a rule (line mod 4)."""
    f = findings(spark, sf_dir)
    m = F.col("line_number") % 4
    full = F.to_json(F.struct("rule_id", "severity", "defect_family", "message", "file_path", "line_number",
                              "engine_source", "issue_type"))
    no_family = F.to_json(F.struct("rule_id", "severity", "message", "file_path", "line_number", "issue_type",
                                   F.col("defect_family").alias("category")))
    bare = F.to_json(F.struct("file_path", "issue_type"))
    no_rule = F.to_json(F.struct("severity", "file_path", "line_number", "issue_type"))
    txt = F.when(m == 0, full).when(m == 1, no_family).when(m == 2, bare).otherwise(no_rule)
    return f.select("repo_id", F.col("file_path").alias("_path"), F.col("line_number").alias("_line"),
                    F.col("rule_id").alias("_rule"), txt.alias("issue_json"))
