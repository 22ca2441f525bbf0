import datetime as dt

from strata.operators import blame as BL
from strata.operators import history as HI


def test_evolution_chain_classification(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("r", "f.py", "c3" * 20, "a", base + dt.timedelta(days=3), "remove x", 1, 0),
            ("r", "f.py", "c2" * 20, "a", base + dt.timedelta(days=2), "fix", 1, 0),
            ("r", "f.py", "c1" * 20, "a", base + dt.timedelta(days=1), "rename y", 1, 0)]
    commits = spark.createDataFrame(rows, "repo_id string, file_path string, commit string, author string, "
                                          "ts timestamp, message string, insertions int, deletions int")
    got = [r.change_type for r in HI.evolution_chain(commits).orderBy("step").collect()]
    assert got == ["refactor", "modification", "introduction"]


def test_parse_commit_log_keeps_pipes_and_last_15(spark):
    header = "a" * 40 + "|dev@example.com|2024-01-01 00:00:00|subject | with pipe"
    diff = "\n".join(f"+line {i}" for i in range(1, 21))
    log = "noise before\n" + header + "\n@@ hunk @@\n" + diff
    df = spark.createDataFrame([("r", "f.py", i, x) for i, x in enumerate(log.split("\n"))],
                               "repo_id string, file_path string, line_no long, line string")
    r, = HI.parse_commit_log(df).collect()
    assert r.message == "subject | with pipe"
    assert r.author == "dev@example.com <dev@example.com>"
    assert r.diff.split("\n") == [f"+line {i}" for i in range(6, 21)]


def test_expand_blame_numbers_lines(spark):
    seg = [("c1", "A", "a@x", dt.datetime(2024, 1, 1), ["l1", "l2"]), ("c2", None, None, dt.datetime(2024, 1, 2), ["l3"])]
    df = spark.createDataFrame([("r", "f.py", seg)], "repo_id string, file_path string, segments "
                               "array<struct<commit:string,author_name:string,author_email:string,ts:timestamp,lines:array<string>>>")
    out = BL.expand_blame(df).orderBy("line_number").collect()
    assert [r.line_number for r in out] == [1, 2, 3]
    assert [r.commit for r in out] == ["c1", "c1", "c2"]
    assert out[2].author_name == "Unknown" and out[2].author_email == "unknown@example.com"


def test_pct_half_up(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (2, 3)], "p long, w long")
    got = [r[0] for r in df.select(BL.pct_1dp("p", "w")).collect()]
    assert got == [12.5, 33.3, 66.7]


def test_positions_equal_global_row_number(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from strata.operators.positions import positions
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = positions(ev, ["user_id"], [F.col("event_type"), F.col("ts"), F.col("event_id")])
    w = Window.partitionBy("user_id").orderBy("event_type", "ts", "event_id")
    want = ev.withColumn("position", F.row_number().over(w).cast("long"))
    a = sorted((r.event_id, r.position) for r in got.select("event_id", "position").collect())
    b = sorted((r.event_id, r.position) for r in want.select("event_id", "position").collect())
    assert a == b


def test_parse_commit_log_is_the_same_over_many_blocks(spark, monkeypatch):
    log = ["noise"]
    for c in range(40):
        log += [f"{c:040d}|dev|d|subject {c}", "@@"] + [f"{'+- '[k % 3]}line {c} {k}" for k in range(c % 23)]
    df = spark.createDataFrame([("r", "f", i, x) for i, x in enumerate(log)], "repo_id string, file_path string, line_no long, line string")
    whole = sorted(map(tuple, HI.parse_commit_log(df).collect()))
    monkeypatch.setattr(HI, "LOG_BLOCK", 7)
    assert sorted(map(tuple, HI.parse_commit_log(df).collect())) == whole
    assert [r[2] for r in whole] == list(range(40))
    assert whole[22][-1].split("\n") == [f"{'+- '[k % 3]}line 22 {k}" for k in range(7, 22)]


def test_commit_logs_number_commits_not_lines(spark, tmp_path, monkeypatch):
    import json
    from pyspark.sql import functions as F
    from strata import fixtures as FX
    from strata.operators import positions as module
    land, landed = module.land, []
    monkeypatch.setattr(module, "land", lambda *a: landed.append(land(*a)) or landed[-1])
    at = lambda i: None if i == 3 else dt.datetime(2024, 1, 1, 0, 0, i // 4)
    rows = [(i if i % 9 else 9, at(i), i % 5, "view", float(i), json.dumps({"k": i % 2})) for i in range(60)]
    rows += rows[:8]  # commits that come twice
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    got = FX.commit_logs(spark, str(tmp_path))
    lines = sum(r["n"] for r in FX.commits(spark, str(tmp_path)).select((F.abs("insertions") % 20 + 4).alias("n")).collect())
    out = got.collect()
    assert len(out) == lines
    for path in {r["file_path"] for r in out}:
        mine = sorted((r["line_no"], r["line"]) for r in out if r["file_path"] == path)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1))
        # lines of commits that share time and hash come by their places, others commit by commit
        assert mine[1][1] == "@@ -1 +1 @@" or mine[0][1] == mine[1][1]
    assert landed[0].count() == len(rows)  # commits were dealt, not their lines


def test_one_group_of_equal_rows_is_numbered_by_many_windows(spark, monkeypatch):
    from pyspark.sql import functions as F
    from strata.operators import positions as module
    positions, land, landed = module.positions, module.land, []
    monkeypatch.setattr(module, "land", lambda *a: landed.append(land(*a)) or landed[0])
    rows = [(None, i % 5 if i % 7 else None) for i in range(3000)] + [("b", None)] * 4 + [("b", 1)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(5)
    out = positions(df, ["g"], [F.col("k").desc()])
    got = [(r.g, r.position, r.k) for r in out.collect()]
    assert len(got) == len(rows)
    for g, n in ((None, 3000), ("b", 5)):
        mine = sorted(x[1:] for x in got if x[0] == g)
        assert [p for p, _ in mine] == list(range(1, n + 1))
        keys = [-1 if k is None else k for _, k in mine]
        assert keys == sorted(keys, reverse=True)
    # no window partition holds the group: the plan numbers inside (partition, group), and the group spans partitions
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_part" in plan
    assert landed[0].filter("g IS NULL").select("_part").distinct().count() > 4


def test_null_keys_keep_their_rows(spark):
    from strata import schemas as S
    from strata.operators.findings import assign_issue_ids
    from strata.operators.ranking import search_issues
    issues = spark.createDataFrame([("r", None, "x", 3, "low", 3), ("r", "f", "x", 3, "high", 3), (None, None, None, None, None, None)],
                                   "repo_id string, file_path string, rule_id string, line_number int, severity string, end_line int")
    ids = {(r.repo_id, r.file_path): r.id for r in assign_issue_ids(issues).collect()}
    assert len(ids) == 3 and ids["r", None].startswith("issue_0_") and ids["r", "f"].startswith("issue_1_")
    wide = issues.selectExpr("*", "rule_id AS message", "severity AS defect_family")
    assert sorted((r.repo_id or "", r.position) for r in search_issues(wide).collect()) == [("", 1), ("r", 1), ("r", 2)]
    log = [(None, "f", 0, "a" * 40 + "|d|t|s"), (None, "f", 1, "+x"), ("r", None, 0, "b" * 40 + "|d|t|s"), ("r", None, 1, "-y")]
    out = HI.parse_commit_log(spark.createDataFrame(log, "repo_id string, file_path string, line_no long, line string"))
    assert sorted((r.repo_id or "", r.file_path or "", r.diff) for r in out.collect()) == [("", "f", "+x"), ("r", "", "-y")]
    assert S.SEVERITY_ORDER


def test_memberships_without_a_date_are_listed_last(spark):
    from strata.operators.admin import project_listing
    day = dt.datetime(2024, 1, 1)
    members = spark.createDataFrame([(1, 10, "owner", None), (1, 11, "owner", day), (None, 11, "viewer", day)],
                                    "user_id long, project_id long, role string, added_at timestamp")
    projects = spark.createDataFrame([(10, "u", "n"), (11, "u", "n")], "id long, repo_url string, repo_name string")
    analyses = spark.createDataFrame([], "id long, project_id long, status string, health_score int, created_at timestamp")
    got = sorted((r.user_id or 0, r.position, r.project_id) for r in project_listing(members, projects, analyses).collect())
    assert got == [(0, 1, 11), (1, 1, 11), (1, 2, 10)]
