"""Searching the gram index equals a substring scan."""

import random

import pytest

from strata.operators import issue_index as IX

SCHEMA = "repo_id string, file_path string, line_number int, rule_id string, message string, defect_family string"


@pytest.mark.parametrize("block,rarest", [(1 << 16, 3), (7, 1)])
def test_index_equals_a_scan(spark, monkeypatch, block, rarest):
    monkeypatch.setattr(IX, "BLOCK", block)
    monkeypatch.setattr(IX, "RAREST", rarest)
    rng = random.Random(block)
    word = lambda n: "".join(rng.choices("abAB./-é ", k=rng.randint(0, n)))
    rows = [(rng.choice(["r", "s", None]), rng.choice([None, word(12)]), i % 50, word(6), word(20), rng.choice([None, "secrets"])) for i in range(200)]
    asked = ["", "a", "É", "ab", "aB.", "abab", "SECRETS", "zz", "crets", "cretsx", " /", None, *[word(7) for _ in range(40)]]
    index = IX.build_issue_index(spark.createDataFrame(rows, SCHEMA).repartition(3))
    queries = spark.createDataFrame([(q,) for q in asked + asked], "query string")
    got = sorted((r.query, *map(str, (r.repo_id, r.file_path, r.line_number, r.rule_id, r.message, r.defect_family)))
                 for r in IX.search_index(index, queries).collect())
    want = sorted((q, *map(str, row)) for q in {q for q in asked if q is not None} for row in rows
                  if any(q.lower() in (row[i] or "").lower() for i in (1, 3, 4, 5)))
    assert got == want
    assert IX.search_index(index, queries.filter("query = 'nowhere'")).collect() == []


def test_queries_are_answered_by_their_own_postings(spark):
    # every number of four digits shares its grams of three with many others: candidates must not outgrow the answers
    rows = [("r", f"{n}.py", 1, "X", "m", "f") for n in range(1000, 1400)]
    index = IX.build_issue_index(spark.createDataFrame(rows, SCHEMA))
    found = IX.search_index(index, spark.createDataFrame([(f"{n}",) for n in range(1000, 1400)] + [("1399.py",), ("/1399.py ",)], "query string"))
    assert sorted((r.query, r.file_path) for r in found.collect()) == sorted([(f"{n}", f"{n}.py") for n in range(1000, 1400)] + [("1399.py", "1399.py")])
    middle = index.long_postings.filter("length(gram) = 4 AND gram RLIKE '^[0-9]+$'")
    assert middle.count() == 400 and {r.issues for r in middle.collect()} == {1}


def test_short_queries_do_not_compare_issues(spark):
    index = IX.build_issue_index(spark.createDataFrame([("r", "a.py", 1, "X", "m", "f")], SCHEMA))
    assert index.postings.filter("gram = 'a.p'").count() == 1 and index.postings.filter("length(gram) > 3").isEmpty()
    plan = IX.search_index(index, spark.createDataFrame([("a.p",)], "query string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan
    empty = IX.build_issue_index(spark.createDataFrame([], SCHEMA))
    assert IX.search_index(empty, spark.createDataFrame([("a",), ("",)], "query string")).collect() == []
