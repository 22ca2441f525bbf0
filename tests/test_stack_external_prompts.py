import datetime as dt
import json

from pyspark.sql import functions as F

from strata import fixtures as FX
from strata.operators import catalogue as CT
from strata.operators import prompts as PR
from strata.operators import stack as ST
from strata.sources import external as EX


def _files(spark, rows):
    df = spark.createDataFrame(rows, "repo_id string, path string, content string")
    return df.withColumn("size", F.octet_length("content").cast("long"))


def test_manifest_priority_dirs_and_frameworks(spark):
    files = _files(spark, [
        ("r1", "requirements.txt", "FastAPI==0.1\nflask"), ("r1", "package.json", '{"dependencies": {"react": "1"}}'),
        ("r1", "src/app.js", "x"), ("r1", "lib/util.js", "y"),
        ("r2", "pyproject.toml", "django"), ("r2", "main.py", "print(1)"),
        ("r3", "a/b.go", "package a"), ("r3", "a/c.go", "package a"), ("r3", "d.rs", "fn"),
        ("r4", "README", "no suffix")])
    st = {r.repo_id: r for r in ST.detect_stack(files).collect()}
    assert st["r1"].manifest == "package.json" and st["r1"].frameworks == ["react"]
    assert st["r1"].src_dirs == ["src", "lib"]            # only the existing ones, manifest order
    assert st["r2"].language == "python" and st["r2"].frameworks == ["django"]
    assert st["r2"].src_dirs[0] == "src"                  # none exist -> all of them
    assert st["r3"].manifest is None and st["r3"].language == "go" and st["r3"].extensions == [".go"]
    assert st["r4"].language == "unknown" and ".py" in st["r4"].extensions


def test_authored_files_root_walk_reaches_one_level(spark):
    files = _files(spark, [("r", "package.json", "{}"), ("r", "src/a/b/deep.js", "1"), ("r", "top.js", "22"),
                           ("r", "one/two.js", "333"), ("r", "one/two/three.js", "4444"),
                           ("r", "src/node_modules/x.js", "5"), ("r", "src/.hidden.js", "6"), ("r", "src/empty.js", "")])
    got = [r.path for r in ST.authored_files(files, ST.detect_stack(files)).orderBy("rank").collect()]
    assert got == ["src/a/b/deep.js", "top.js", "one/two.js"]


def test_external_ingest_branches(spark):
    results = [
        {"check_id": "a.b.sql_injection_rule", "path": "src\\x.py", "start": {"line": 3, "col": 2}, "end": {"line": 0},
         "extra": {"severity": "ERROR", "message": "m1", "lines": "code", "metadata": {"category": "security", "cwe": ["CWE-89", "x"]}}},
        {"check_id": "OURS", "path": "y.py", "extra": {"severity": "INFO", "metadata": {"cwe": "CWE-1"}}},
        {"path": "z.py", "start": {"line": 1}, "extra": {"metadata": {"category": "maintainability"}}},
    ]
    reports = spark.createDataFrame([("r", json.dumps({"results": results}))], "repo_id string, report string")
    rules = FX.rules(spark, [("OURS", "any", "crypto", "low", "", "ast_semgrep", True)])
    out = {r.rule_id: r for r in EX.ingest_external_findings(reports, rules).collect()}
    a = out["a.b.sql_injection_rule"]
    assert (a.file_path, a.severity, a.defect_family, a.cwe_id, a.issue_type, a.end_line, a.column) == \
        ("src/x.py", "high", "injection", "CWE-89", "sql-injection-rule", 3, 2)
    o = out["OURS"]
    assert (o.severity, o.defect_family, o.message, o.line_number, o.cwe_id) == ("low", "crypto", "OURS matched", 0, None)
    u = out["unknown"]
    assert (u.severity, u.defect_family, u.message) == ("medium", "maintainability", "Issue detected")


def test_parse_fix_responses(spark):
    rows = [(1, '{"root_cause": "x", "confidence": 7, "reasoning": ["a"]}'), (2, '{"confidence": -1}'), (3, "not json"),
            (4, '{"fix_strategy": "s"}')]
    df = spark.createDataFrame(rows, "id long, response string")
    out = {r.id: r for r in PR.parse_fix_responses(df).collect()}
    assert out[1].confidence == 1.0 and out[1].reusable
    assert out[2].confidence == 0.0 and not out[2].reusable and out[2].root_cause == "Unable to determine root cause"
    assert out[3].parse_error and not out[3].reusable
    assert out[4].confidence == 0.5 and out[4].fix_strategy == "s" and out[4].code_patch == ""


def test_fix_prompts_reject_blank_and_long(spark):
    rows = [("r", "f.py", "python", "secrets", "x = 1"), ("r", "g.py", "python", "secrets", "   "),
            ("r", "h.py", "python", "secrets", "y" * 5001)]
    df = spark.createDataFrame(rows, "repo_id string, file_path string, language string, defect_family string, code_snippet string")
    out = sorted(PR.fix_prompts(df).collect(), key=lambda r: r.file_path)
    assert [(r.file_path, r.status, r.reason) for r in out] == [
        ("f.py", "ok", None), ("g.py", "rejected", "code_snippet cannot be empty"),
        ("h.py", "rejected", "code_snippet too long (max 5000 chars).")]
    assert out[1].prompt is None and out[2].prompt is None
    assert out[0].prompt.startswith("**Defect Family:** secrets\n**Language:** python\n**File:** f.py")
    assert "```python\nx = 1\n```" in out[0].prompt


def test_request_key_and_hit_rate(spark):
    import hashlib
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "d")], "s string, f string")
    keyed = df.select(PR.request_key("fix", "s", "f").alias("request_key"))
    assert keyed.first().request_key == hashlib.sha256(b"fix|a|b").hexdigest()[:20]
    assert PR.request_hit_rate(keyed).first().hit_rate == 0.333


def test_seed_rules_collapse_mode(spark):
    specs = spark.createDataFrame([("x-one", ["python", "go"], "p", "high", "m", 1), ("y", [], "p\\\\n", None, "m", 2),
                                   ("z", ["go"], "p", "low", "m", 3)],
                                  "id string, languages array<string>, pattern string, severity string, message string, seq long")
    fams = spark.createDataFrame([("x-one", "crypto"), ("y", "auth"), ("z", "xss")], "id string, defect_family string")
    out = {r.rule_id: r for r in CT.seed_rules(specs, fams, collapse=True).collect()}
    assert out["REGEX-x-one"].language == "any" and out["REGEX-x-one"].is_active and out["REGEX-x-one"].name == "X One"
    assert not out["REGEX-y"].is_active and out["REGEX-y"].severity == "low"
    assert out["REGEX-z"].language == "go"


def test_apply_rule_changes(spark):
    rules = spark.createDataFrame([("A", "low", "m", True), ("B", "low", "m", True), ("C", "low", "m", False)],
                                  "rule_id string, severity string, message string, is_active boolean")
    ch = spark.createDataFrame([
        ("A", 1, "update", "high", None), ("A", 2, "toggle", None, None), ("A", 3, "update", None, "new"),
        ("B", 1, "toggle", None, None), ("B", 2, "deactivate", None, None), ("B", 3, "toggle", None, None),
        ("C", 1, "delete", None, None)], "rule_id string, seq long, action string, severity string, message string")
    out = {r.rule_id: r for r in CT.apply_rule_changes(rules, ch).collect()}
    assert set(out) == {"A", "B"}
    assert (out["A"].severity, out["A"].message, out["A"].is_active) == ("high", "new", False)
    assert out["B"].is_active is True
