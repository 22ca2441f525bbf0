from strata.operators import catalogue as CT
from strata.operators import rescan as RS


def test_bulk_import_statuses(spark):
    rows = [(0, "", "n", "p", "m", "low", "secrets", "regex_line"),
            (1, "EXISTS", "n", "p", "m", "low", "secrets", "regex_line"),
            (2, "B", "", "p", "m", "low", "secrets", "regex_line"),
            (3, "C", "n", "p", "m", "urgent", "secrets", "regex_line"),
            (4, "D", "n", "p", "m", "low", "perf", "regex_line"),
            (5, "E", "n", "p", "m", "low", "secrets", "glob"),
            (6, "F", "n", "p", "m", "HIGH", "secrets", "regex_line"),
            (7, "F", "n", "p", "m", "low", "secrets", "regex_line")]
    df = spark.createDataFrame(rows, "idx long, rule_id string, name string, pattern string, message string, "
                                     "severity string, defect_family string, match_type string")
    existing = spark.createDataFrame([("EXISTS",)], "rule_id string")
    got = [r.status for r in CT.bulk_import_rules(df, existing).orderBy("idx").collect()]
    assert got == ["error", "skipped", "error", "error", "error", "error", "created", "skipped"]


def test_rescan_decisions(spark):
    an = spark.createDataFrame([
        (1, 10, "u1", "analyzing", "2024-01-02", "s1"),
        (2, None, "u2", "complete", "2024-01-01", "s2"),
        (3, 30, "u3", "complete", "2024-01-01", "s3"),
        (4, 40, "u4", "complete", "2024-01-01", "s4"),
        (5, 50, "u5", "complete", "2024-01-01", "s5"),
        (6, 60, "u6", "complete", "2024-01-01", None)],
        "id long, project_id long, repo_url string, status string, created_at string, commit_sha string") \
        .selectExpr("id", "project_id", "repo_url", "status", "cast(created_at as timestamp) created_at", "commit_sha")
    req = spark.createDataFrame([
        (1, "u1", 10, True, False, "x"), (2, "u2", None, False, False, None), (3, "u3", 30, True, False, "s3"),
        (4, "u4", 40, True, False, None), (5, "u5", 50, True, True, "s5"), (6, "u6", 60, True, False, "z")],
        "request_id long, repo_url string, project_id long, user_known boolean, force boolean, remote_head string")
    got = [r.decision for r in RS.rescan_decision(req, an).orderBy("request_id").collect()]
    assert got == ["running", "reuse", "reuse", "reuse", "rescan", "rescan"]


def test_merge_rescan_without_changes_keeps_old(spark):
    old = spark.createDataFrame([("r", "a.py", "R", 1)], "repo_id string, file_path string, rule_id string, line_number int")
    changed = spark.createDataFrame([], "repo_id string, path string, change string")
    assert RS.merge_rescan(old, old.limit(0), changed).count() == 1


def test_changed_files_statuses(spark):
    old = spark.createDataFrame([("r", "a.py", "x"), ("r", "b.py", "y"), ("r", "c.py", "z")],
                                "repo_id string, path string, content string")
    new = spark.createDataFrame([("r", "a.py", "x"), ("r", "b.py", "y2"), ("r", "d.py", "w")],
                                "repo_id string, path string, content string")
    got = {r.path: r.change for r in RS.changed_files(old, new).collect()}
    assert got == {"b.py": "modified", "c.py": "removed", "d.py": "added"}
