import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from strata import fixtures as FX
from strata.operators import catalogue as CT
from strata.session import checkpoint_dir
from strata.sources import files as SF
from strata.sources import json_columns as JC

SF_DIR = "/root/testdata/sf0.001"


def test_read_repo_files_and_tree_filters(spark):
    root = os.path.join(checkpoint_dir(spark), f"repos-{uuid.uuid4().hex}")
    tree = {
        "r1/src/app.py": b"import os\r\nprint(1)\n",
        "r1/node_modules/x.js": b"skip",
        "r1/.env": b"SECRET=1",
        "r1/logo.png": b"\x89PNG",
        "r1/lib/min.min.js": b"var a",
        "r2/main.go": b"package main\n\xff\xfebad bytes\n",
    }
    for rel, data in tree.items():
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as fh:
            fh.write(data)
    files = SF.read_repo_files(spark, root)
    got = {(r.repo_id, r.path): r for r in SF.scan_file_tree(files).collect()}
    assert set(got) == {("r1", "src/app.py"), ("r2", "main.go")}
    assert got[("r1", "src/app.py")].language == "python" and got[("r1", "src/app.py")].lines == 2
    content = {r.path: r.content for r in files.collect()}
    assert content["src/app.py"] == "import os\nprint(1)\n"
    assert content["main.go"] == "package main\nbad bytes\n"


def test_export_report_json_of_completed_analyses(spark):
    out = os.path.join(checkpoint_dir(spark), f"report-{uuid.uuid4().hex}")
    files = spark.createDataFrame([("r", "a.py", "x", 1, "python", 3), ("q", "b.py", "y", 1, "python", 4)],
                                  "repo_id string, path string, content string, size long, language string, lines int")
    analyses = spark.createDataFrame([("A", "r", "u/r", "complete", dt.datetime(2024, 1, 1), None),
                                      ("B", "q", "u/q", "analyzing", dt.datetime(2024, 1, 1), None)],
                                     "id string, repo_id string, repo_url string, status string, created_at timestamp, completed_at timestamp")
    rows = [("r", f"R{i}", "a.py", i, sev, "secrets", f"p{i}@x", f"P{i}") for i, sev in
            enumerate(["high", None, "odd", "high"] + ["low"] * 12)]
    issues = spark.createDataFrame(rows, "repo_id string, rule_id string, file_path string, line_number int, severity string, "
                                         "defect_family string, origin_author_email string, origin_author_name string") \
        .withColumn("origin_author", F.col("origin_author_name"))
    report, = JC.completed_reports(analyses, issues, files).collect()
    assert (report.analysis_id, report.total_files, report.total_lines, report.total_issues) == ("A", 1, 3, 16)
    assert [(s.severity, s["count"]) for s in report.severity_summary] == [
        ("blocker", 0), ("critical", 0), ("high", 2), ("medium", 0), ("low", 12), ("info", 1), ("trace", 0), ("odd", 1)]
    JC.export_report_json(analyses, issues, files, out)
    doc = spark.read.option("basePath", f"{out}/summary").json(f"{out}/summary").collect()
    assert len(doc) == 1 and doc[0].metadata.analysis_id == "A" and doc[0].summary.severity_summary.odd == 1
    assert spark.read.json(f"{out}/contributors").count() == 16  # all of them
    assert spark.read.json(f"{out}/issues").count() == 16 and spark.read.json(f"{out}/file_tree").count() == 1


def test_rules_csv_of_an_ordinary_writer(spark):
    import csv
    out = os.path.join(checkpoint_dir(spark), f"csv-{uuid.uuid4().hex}")
    os.makedirs(out)
    pattern = '(token)\\s*=\\s*"[0-9]+"'
    head = ["rule_id", "name", "pattern", "message", "severity", "defect_family", "match_type", "is_active"]
    rows = [["A", "n", pattern, "two\nlines, one field", "high", "secrets", "regex_line", "Yes"],
            ["B", "n", "p", "m", "nope", "secrets", "regex_line", "0"], ["B", "n", "p2", "m", "low", "secrets", "regex_line", "1"],
            ["B", "n", "p3", "m", "low", "secrets", "regex_line", "1"], ["", "n", "p", "m", "low", "secrets", "regex_line", ""]]
    big = [["A", "later " * 400, "p", "m", "low", "secrets", "regex_line", "true"]]  # a larger file that Spark reads first
    for name, part in (("rules-1.csv", rows), ("rules-2.csv", big)):
        with open(os.path.join(out, name), "w", newline="") as f:
            csv.writer(f).writerows([head, *part])
    none = spark.createDataFrame([], "rule_id string")
    got = CT.bulk_import_rules(CT.read_rules_csv(spark, out), none, "position").orderBy("position").collect()
    assert [(r["_rid"], r["status"]) for r in got] == [
        ("A", "created"), ("B", "error"), ("B", "created"), ("B", "skipped"), ("", "error"), ("A", "skipped")]
    assert got[0]["pattern"] == pattern and got[0]["message"] == "two\nlines, one field" and got[0]["is_active"]


def test_rules_json_array_document(spark):
    import json
    out = os.path.join(checkpoint_dir(spark), f"json-{uuid.uuid4().hex}")
    os.makedirs(out)
    rule = dict(name="n", pattern="p", message="m", severity="low", defect_family="secrets")
    with open(os.path.join(out, "rules.json"), "w") as f:
        json.dump([rule | {"rule_id": "A"}, rule | {"rule_id": "A"}, rule | {"rule_id": "C", "severity": "x"}], f, indent=1)
    none = spark.createDataFrame([], "rule_id string")
    got = CT.bulk_import_rules(CT.read_rules_json(spark, out, multiline=True), none, "position").orderBy("position").collect()
    assert [(r["_rid"], r["status"]) for r in got] == [("A", "created"), ("A", "skipped"), ("C", "error")]


def test_seed_without_a_family_is_an_error(spark):
    import pytest
    specs = spark.createDataFrame([("x", ["python"], "p", "low", "m", 1)],
                                  "id string, languages array<string>, pattern string, severity string, message string, seq long")
    families = spark.createDataFrame([("y", "secrets")], "id string, defect_family string")
    with pytest.raises(Exception, match="No defect family for rule x"):
        CT.seed_rules(specs, families).collect()


def test_metadata_that_begins_with_a_bracket(spark):
    from strata.sources.external import _first_meta
    rows = [("[CWE-79] XSS",), ('["CWE-1", "CWE-2"]',), ("[]",), ("CWE-5",), (None,)]
    got = spark.createDataFrame(rows, "c string").select(_first_meta(F.col("c")).alias("m")).collect()
    assert [r.m for r in got] == ["[CWE-79] XSS", "CWE-1", None, "CWE-5", None]


def test_decode_json_columns_lenient(spark):
    df = spark.createDataFrame([('{"python": 3}',), ("not json",), (None,)], "languages string")
    got = [r.languages for r in JC.decode_analysis_json(df).collect()]
    assert got == [{"python": 3}, {}, {}]


def test_list_rules_filters_and_admin_order(spark):
    rules = FX.rules(spark)
    out = [r.rule_id for r in CT.list_rules(rules, language="any", is_active=True).collect()]
    assert out == sorted(out) and "STYLE-ANY-E" not in out and "REGEX-LICENSE-HEADER" not in out
    assert CT.list_rules(rules, admin_order=True).count() == rules.count()
