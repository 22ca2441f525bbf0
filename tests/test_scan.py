import pytest
from pyspark.sql import functions as F

from strata import fixtures as FX
from strata import schemas as S
from strata.operators import findings as FD
from strata.operators import rollups as RU
from strata.operators import scan as SC


def _files(spark, rows):
    return spark.createDataFrame(rows, "repo_id string, path string, content string, language string")


def _rules(spark, spec):
    return FX.rules(spark, spec)


def test_line_scan_language_and_snippet(spark):
    files = _files(spark, [("r", "a.py", "x = 1\ntoken = \"abcdef0123\"\ny = 2", "python"),
                           ("r", "b.js", "token = \"abcdef0123\"", "javascript")])
    spec = [("T1", "python", "secrets", "high", r'token = "[0-9a-f]+"', "regex_line", True),
            ("T2", "any", "secrets", "low", r"y = 2", "regex_line", True),
            ("OFF", "any", "secrets", "low", r"x", "regex_line", False)]
    out = SC.scan_line_rules(files, _rules(spark, spec)).collect()
    got = sorted((r.file_path, r.rule_id, r.line_number, r.code_snippet) for r in out)
    assert got == [("a.py", "T1", 2, 'x = 1\ntoken = "abcdef0123"\ny = 2'),
                   ("a.py", "T2", 3, 'token = "abcdef0123"\ny = 2')]


FIELDS = ["rule_id", "engine_source", "file_path", "line_number", "severity", "defect_family", "message", "code_snippet",
          "issue_type", "end_line"]


def _plain_scan(files, spec):
    """Every rule over every line or text with Python's re; a pattern that does not compile is left out."""
    import re
    out = []
    for _, path, text, lang in files:
        lines = text.splitlines()
        for rid, rlang, fam, sev, pat, kind, active in spec:
            try:
                rx = re.compile(pat)
            except re.error:
                continue
            if not active or rlang not in ("", "any", lang):
                continue
            if kind == "regex_line":
                spans = [(n, n) for n, line in enumerate(lines, 1) if rx.search(line)]
            else:
                spans = [(text.count("\n", 0, m.start()) + 1, text.count("\n", 0, m.end()) + 1) for m in rx.finditer(text)]
            for a, b in spans:
                out.append((rid, "regex", path, a, sev or "low", fam or "best_practice", f"{rid} matched",
                            "\n".join(lines[max(0, a - 2):b + 1]), rid.removeprefix("REGEX-"), b))
    return sorted(out)


@pytest.mark.parametrize("n_rules", [404, 3000])
def test_any_number_of_rules_scans_alike(spark, n_rules):
    languages = ["any", "python", "javascript", "go", "java", ""]
    spec = [(f"REGEX-R{i}", languages[i % 6], "secrets" if i % 5 else None, ["high", None, "low"][i % 3],
             f"tok{i % 97}x['\"]?[0-9]" if i % 2 else f"(?:k{i}|w{i % 13}\\b)", "regex_line", i % 11 != 0) for i in range(n_rules)]
    spec += [("BAD", "any", "x", "low", "(unclosed", "regex_line", True),
             ("PY-ONLY", "any", "x", None, r"(?P<q>['\"])tok\d+x(?P=q)", "regex_line", True),
             ("ML", "python", "x", "high", r"w3\n\s*k", "regex_multiline", True),
             ("ML-PY-ONLY", "any", "x", None, r"(?P<a>w\d+)\n(?P=a)", "regex_multiline", True),
             ("ML-BAD", "any", "x", "low", "[", "regex_multiline", True)]
    text = "\n".join(f"w{i % 17} k{i * 7} 'tok{i}x' tok{i % 97}x{i % 10}" for i in range(60)) + "\nw3\n  k\x01\nw5\nw5\n"
    rows = [("r", f"f{i}.{lang}", text if i % 2 else text[: 40 * i], lang)
            for i, lang in enumerate(["python", "javascript", "go", "java", "rust", "plaintext"])]
    files, rules = _files(spark, rows), _rules(spark, spec)
    got = SC.scan_line_rules(files, rules).unionByName(SC.scan_multiline_rules(files, rules)).select(*FIELDS).collect()
    assert sorted(map(tuple, got)) == _plain_scan(rows, spec)


def test_building_a_scan_reads_no_text(spark):
    files, rules = FX.files(spark, "/root/testdata/sf0.001"), FX.rules(spark)
    tracker, before = spark.sparkContext.statusTracker(), set()
    spark.sparkContext.setJobGroup("build", "build")
    try:
        SC.scan_line_rules(files, rules)
        jobs = tracker.getJobIdsForGroup("build")
        stages = [s for j in jobs for s in tracker.getJobInfo(j).stageIds]
        tasks = sum(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks <= 4 * len(jobs) and len(jobs) <= 2  # the rule table alone


def test_text_functions_keep_what_is_in_the_text(spark):
    from strata.functions.languages import is_binary
    from strata.functions.text import read_text_lossy
    raw = "a\ufffdb\x00c\r\nd".encode() + b"\xff\xfee"
    df = spark.createDataFrame([(bytearray(raw),)], "b binary")
    assert df.select(read_text_lossy(F.col("b").cast("string")).alias("t")).first().t == "a\ufffdb\x00c\nde"
    rows = [("x" * 511 + "\x00",), ("x" * 512 + "\x00",), ("é" * 256 + "\x00",), ("é" * 255 + "\x00",), ("plain",)]
    out = spark.createDataFrame(rows, "t string").select(is_binary("t").alias("b")).collect()
    assert [r.b for r in out] == [True, False, False, True, False]


def test_multiline_positions(spark):
    text = "a\nexcept X:\n    pass\nb\nexcept Y:\n    pass"
    files = _files(spark, [("r", "m.py", text, "python")])
    spec = [("ML", "python", "reliability", "medium", r"except [A-Z]:\n\s+pass", "regex_multiline", True)]
    got = sorted((r.line_number, r.end_line) for r in SC.scan_multiline_rules(files, _rules(spark, spec)).collect())
    assert got == [(2, 3), (5, 6)]


def _schema():
    from pyspark.sql import types as T
    return T.StructType(list(S.FINDINGS.fields) + [T.StructField("engine_order", T.IntegerType())])


def _finding(repo, rule, line, sev, fam="secrets", engine_order=0, snippet="s"):
    return (repo, rule, "regex", "f.py", line, sev, fam, "m", None, None, None, snippet, rule, line, 1, engine_order)


def test_dedupe_highest_severity_then_first(spark):
    schema = _schema()
    rows = [_finding("r", "A", 1, "medium"), _finding("r", "A", 1, "critical", engine_order=1),
            _finding("r", "B", 2, "low", snippet="first"), _finding("r", "B", 2, "low", engine_order=1, snippet="second")]
    out = {(r.rule_id, r.line_number): r for r in FD.dedupe_findings(spark.createDataFrame(rows, schema)).collect()}
    assert out[("A", 1)].severity == "critical"
    assert out[("B", 2)].code_snippet == "first"
    # idempotent
    once = FD.dedupe_findings(spark.createDataFrame(rows, schema))
    assert once.count() == FD.dedupe_findings(once).count()


@pytest.mark.parametrize("sevs,fams,expected", [
    (["blocker"], ["injection"], 62),
    (["weird"], ["secrets"], 95),
    ([], [], 100),
    (["blocker"] * 5, ["secrets"] * 5, 0),
])
def test_health_score(spark, sevs, fams, expected):
    schema = _schema()
    rows = [_finding("r", f"R{i}", i, s, f) for i, (s, f) in enumerate(zip(sevs, fams))]
    findings = spark.createDataFrame(rows, schema)
    repos = spark.createDataFrame([("r",)], "repo_id string")
    assert RU.health_score(findings, repos).first().health_score == expected


def test_health_score_bounds_and_buckets_on_data(spark):
    sf = "/root/testdata/sf0.001"
    f = FX.findings(spark, sf)
    hs = RU.health_score(f, FX.files(spark, sf).select("repo_id"))
    assert hs.filter((F.col("health_score") < 0) | (F.col("health_score") > 100)).count() == 0
    ss = RU.severity_summary(f).select(sum(F.col(s) for s in S.SEVERITY_ORDER).alias("n")).agg(F.sum("n")).first()[0]
    assert ss == f.count()


def test_issue_ids_match_global_ranking(spark):
    sf = "/root/testdata/sf0.001"
    ids = FD.assign_issue_ids(FX.findings(spark, sf)).collect()
    by_repo = {}
    for r in ids:
        by_repo.setdefault(r.repo_id, []).append(int(r.id.split("_")[1]))
    for vals in by_repo.values():
        assert sorted(vals) == list(range(len(vals)))


def test_python_fallback_engine(spark):
    files = _files(spark, [("r", "a.py", "foo\nbar", "python")])
    rules = [dict(rule_id="LB", pattern=r"(?<=f)oo", language="any", severity="low", defect_family="x",
                  message="m", fix_hint=None, cwe_id=None, owasp_ref=None, java_ok=False)]
    out = SC.scan_line_rules(files, rules).collect()
    assert [(r.rule_id, r.line_number) for r in out] == [("LB", 1)]


def test_unicode_classes_option(spark):
    files = _files(spark, [("r", "a.py", "café bar", "python")])
    spec = [("W", "any", "x", "low", r"caf\w\b", "regex_line", True)]
    assert SC.scan_line_rules(files, _rules(spark, spec)).count() == 0          # ASCII \w (default)
    assert SC.scan_line_rules(files, _rules(spark, spec), unicode_classes=True).count() == 1


def test_python_engine_helper_and_registry_guard(spark):
    from strata.operators.python_engine import python_engine

    def analyze(path, language, content):
        if "boom" in content:
            raise RuntimeError("engine bug")
        return [{"rule_id": "PY-TODO", "line_number": i + 1, "severity": "info"}
                for i, line in enumerate(content.splitlines()) if "TODO" in line]

    files = _files(spark, [("r", "a.py", "x\n# TODO fix", "python"), ("r", "b.py", "boom", "python")])

    def broken(fl, rl):
        raise ValueError("cannot plan")

    engines = {"py": python_engine(analyze, "py"), "broken": broken}
    out = SC.run_engines(files, _rules(spark, []), engines).collect()
    assert [(r.file_path, r.rule_id, r.line_number, r.engine_source) for r in out] == [("a.py", "PY-TODO", 2, "py")]


def test_multiline_scan_equals_brute_force_on_data(spark):
    import re as _re
    from strata.functions.languages import scannable_filter
    sf = "/root/testdata/sf0.001"
    files = scannable_filter(FX.files(spark, sf))
    spec = [("ML-A", "any", "secrets", "high", r'token = "[0-9a-f]+"[^\n]*\n[^\n]*[A-Z]', "regex_multiline", True),
            ("ML-B", "any", "reliability", "low", r"\.\n[A-Z]", "regex_multiline", True)]
    got = sorted((r.file_path, r.rule_id, r.line_number, r.end_line, r.code_snippet)
                 for r in SC.scan_multiline_rules(files, _rules(spark, spec)).collect())
    expect = []
    for row in files.select("path", "content").collect():
        text, lines = row.content, row.content.splitlines()
        for rid, *_rest in spec:
            pat = _rest[3]
            for m in _re.finditer(pat, text):
                line = text.count("\n", 0, m.start()) + 1
                end = line + m.group(0).count("\n")
                expect.append((row.path, rid, line, end, "\n".join(lines[max(0, line - 2):min(len(lines), end + 1)])))
    assert got == sorted(expect) and len(got) > 0


def test_severity_breakdown_zero_fills_and_keeps_unknown(spark):
    schema = _schema()
    rows = [_finding("r", "A", 1, "high"), _finding("r", "B", 2, "weird"), _finding("r", "C", 3, None)]
    repos = spark.createDataFrame([("r",), ("clean",)], "repo_id string")
    out = {(x.repo_id, x.severity): (x["count"], x.pct)
           for x in RU.severity_breakdown_pct(spark.createDataFrame(rows, schema), repos).collect()}
    assert out[("r", "high")] == (1, 33) and out[("r", "info")] == (1, 33) and out[("r", "weird")] == (1, 33)
    assert out[("r", "blocker")] == (0, 0) and out[("clean", "trace")] == (0, 0)
    assert len([k for k in out if k[0] == "r"]) == 8 and len([k for k in out if k[0] == "clean"]) == 7


def test_search_issues_unknown_rank(spark):
    from strata.operators.ranking import search_issues
    rows = [_finding("r", "A", 5, "weird"), _finding("r", "B", 1, "info"), _finding("r", "C", 9, "medium")]
    df = spark.createDataFrame(rows, _schema())
    dash = [r.rule_id for r in search_issues(df).orderBy("position").collect()]
    panel = [r.rule_id for r in search_issues(df, unknown_rank=9).orderBy("position").collect()]
    assert dash == ["C", "A", "B"]   # unknown ranks 4, ahead of info (5)
    assert panel == ["C", "B", "A"]  # unknown ranks 9, last


def test_dedupe_keeps_first_occurrence_position(spark):
    rows = [_finding("r", "A", 1, "medium", engine_order=0), _finding("r", "A", 1, "critical", engine_order=1)]
    out = FD.dedupe_findings(spark.createDataFrame(rows, _schema())).first()
    assert out.severity == "critical" and out.engine_order == 0


def test_rules_without_literals_compile_to_generated_code(spark):
    """404 of them: no pass is interpreted because its code grew too long."""
    languages = ["any", "python", "javascript", "go"]
    spec = [(f"N{i}", languages[i % 4], "x", "low", rf"[a-z]{{{i % 5 + 1},}}[0-9]{{{i % 3 + 1}}}|[0-9]+[x-z]{{{i % 7 + 1}}}", "regex_line", True)
            for i in range(404)]
    rows = [("r", f"f.{lang}", "abc12 9xyz\n--\nzz9\n77yy", lang) for lang in ("python", "javascript", "go", "java")]
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        got = SC.scan_line_rules(_files(spark, rows), _rules(spark, spec)).select(*FIELDS).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert sorted(map(tuple, got)) == _plain_scan(rows, spec)


def test_engines_read_the_texts_once(spark):
    files = FX.files(spark, "/root/testdata/sf0.001")
    rules = FX.rules(spark, [*FX.FIXTURE_RULES, *FX.FIXTURE_MULTILINE_RULES])
    plan = SC.run_engines(files, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("parquet") == 1


def test_ascii_and_unicode_classes(spark):
    files = _files(spark, [("r", "a", "caf\u00e9x tok\ncafe\u0301 tok\nTOK \u212a", "plaintext")])
    spec = [("W", "any", "x", "low", r"caf\w+x", "regex_line", True), ("I", "any", "x", "low", r"(?i)tok k", "regex_line", True),
            ("U", "any", "x", "low", r"(?u)caf\w+x", "regex_line", True)]
    ascii_, wide = (sorted((r.rule_id, r.line_number) for r in SC.scan_line_rules(files, _rules(spark, spec), unicode_classes=u).collect())
                    for u in (False, True))
    assert ascii_ == [("U", 1)] and wide == [("I", 3), ("U", 1), ("W", 1)]


def test_line_reach():
    from strata.functions.regex_literal import line_reach
    assert line_reach(r"except\s+\w+:\n\s*pass") is None  # white space may be any number of lines
    assert line_reach(r"except[ ]+\w+:\n[ \t]*pass") == (1, 0) and line_reach(r"(?<=ab)c\n(?=d\n)") == (2, 2)
    assert line_reach(r"a[^\n]*b(?:\nc|\n\nd){2}") == (4, 0) and line_reach(r"a[^x]*b") is None and line_reach(r"(?s)a.b") == (1, 0)
    assert line_reach(r"^a") is None and line_reach(r"(?m)^a$") == (0, 1) and line_reach("a*") is None and line_reach(r"(a)\1") is None


@pytest.mark.parametrize("chunk", [1, 40, 100_000])
def test_large_texts_in_chunks_scan_as_a_whole(spark, monkeypatch, chunk):
    import random
    from strata.operators import python_engine as PE
    monkeypatch.setattr(PE, "CHUNK_CHARS", chunk)
    rng = random.Random(chunk)
    text = lambda n: "".join(rng.choices(["a", "b", "\n", "\n", "tok ", "key=1", " ", "\u00e9"], k=n))
    rows = [("r", f"f{i}.{lang}", text(rng.randint(0, 400)), lang) for i, lang in enumerate(["python", "go", "java", "plaintext"] * 3)]
    rows += [("r", "breaks", "tok\r\nkey=1\x0btok\n" * 9, "python"), ("r", "one", "a" * 300, "go"), ("r", "nl", "\n" * 200, "go")]
    multi = ["a\na", "b\n\n?tok", r"(?m)^tok $", r"tok [^\n]*\n[^\n]*key", r"\n\n", r"(?<=b)\n(?!a)", r"\ba+\b", "a.*?b", r"(?s)a.*b", r"^a|b\Z", r"\s+k", "(?:a|\nb){2,3}"]
    spec = [(f"M{i}", ["any", "python", "go"][i % 3], "x", "low", p, "regex_multiline", True) for i, p in enumerate(multi)]
    spec += [("L1", "any", "x", "low", "key=", "regex_line", True), ("L2", "go", "x", "low", "a$", "regex_line", True)]
    files, rules = _files(spark, rows).repartition(2), _rules(spark, spec)
    for large in (None, 20):
        got = SC.scan_line_rules(files, rules, large_chars=large).unionByName(SC.scan_multiline_rules(files, rules, large_chars=large))
        assert sorted(map(tuple, got.select(*FIELDS).collect())) == _plain_scan(rows, spec)


def test_one_large_text_is_scanned_by_many_tasks(spark):
    """Fifteen million characters in one row: chunks of a megabyte, far from any other, and the same findings."""
    rows = [("r", "big.py", "".join(f"line {i}\n" + ("tok\nkey\n" if i % 50_000 == 7 else "") for i in range(1_200_000)), "python")]
    files, rules = _files(spark, rows), _rules(spark, [("M", "python", "x", "low", r"tok\nkey", "regex_multiline", True),
                                                       ("L", "any", "x", "low", r"99999\b", "regex_line", True)])
    out = SC.scan_multiline_rules(files, rules, large_chars=1_000_000).unionByName(SC.scan_line_rules(files, rules, large_chars=1_000_000))
    assert sorted(map(tuple, out.select(*FIELDS).collect())) == _plain_scan(rows, [("M", "python", "x", "low", r"tok\nkey", "regex_multiline", True),
                                                                                    ("L", "any", "x", "low", r"99999\b", "regex_line", True)])


def test_a_worker_holds_bounded_batches(spark):
    from strata.operators import python_engine as PE
    from strata.session import BATCH_BYTES, BATCH_ROWS
    records, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(records), spark.conf.get(size)
    try:
        spark.conf.set(records, 10_000)
        spark.conf.set(size, 1 << 30)
        files = spark.createDataFrame([("r", "p", "python", "a = 1\nb = 2")], "repo_id string, path string, language string, content string")
        rules = [{"language": "any", "pattern": "=", "flags": 0, "literals": frozenset("="), "match_type": "regex_line"}]
        assert PE.scan_texts(files, rules).count() == 2
        assert int(spark.conf.get(records)) == BATCH_ROWS and int(spark.conf.get(size)) == BATCH_BYTES
    finally:
        spark.conf.set(records, before[0])
        spark.conf.set(size, before[1].rstrip("b"))
    frames = list(PE._in_parts((("r", "p", k, k, "x" * 3000, 1) for k in range(3000)), PE._NAMES))
    assert sum(map(len, frames)) == 3000 and max(map(len, frames)) < 1024 and list(frames[-1].columns) == PE._NAMES
