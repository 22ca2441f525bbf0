"""Positions with running sums, directory intervals, reuse distances and digest trees against plain Python."""

import random
from collections import Counter, OrderedDict

import pytest
from pyspark.sql import functions as F

from strata.operators import request_cache as RC
from strata.operators import snapshots as SN
from strata.operators.positions import sequenced
from strata.operators.rollups import directory_rollup


def test_sequenced_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c"]), i * 37 % 1000, rng.randint(-3, 9), f"v{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, k int, n int, v string").repartition(6)
    out = sequenced(df, ["g"], [F.col("k").desc()], "at", {"total": F.col("n"), "twice": F.col("n") * 2}, ("v", "k")).collect()
    assert len(out) == 1000
    for g in (None, "a", "b", "c"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])
        got = sorted((r for r in out if r["g"] == g), key=lambda r: r["at"])
        total = 0
        for i, (want, r) in enumerate(zip(mine, got, strict=True)):
            total += want[2]
            before, after = mine[i - 1] if i else (None,) * 4, mine[i + 1] if i + 1 < len(mine) else (None,) * 4
            assert (r["at"], r["k"], r["total"], r["twice"], r["previous_v"], r["next_v"], r["previous_k"], r["next_k"]) == (
                i + 1, want[1], total, 2 * total, before[3], after[3], before[1], after[1])
    assert sequenced(df.filter("k > 9999"), [], [F.col("k")], "at", {"s": F.col("n")}, ("v",)).collect() == []


def test_directories_are_intervals(spark):
    rng = random.Random(2)
    paths = ["/".join(rng.choices(["a", "b", "a-b", "a.b", "A", "é", ""], k=rng.randint(1, 5))) for _ in range(400)] + ["top", "a/b", "a/b/c", "", "/x", None]
    rows = [(rng.choice(["r", "s", None]), p, rng.choice([None, 0, 1, 5])) for p in paths]
    df = spark.createDataFrame(rows, "repo_id string, path string, issue_count long").repartition(5)
    want = {}
    for repo, path, n in rows:
        parts = (path or "").split("/")
        for k in range(1, len(parts)):
            one = want.setdefault((repo, "/".join(parts[:k])), [0, 0])
            one[0] += n or 0
            one[1] += 1
    out = directory_rollup(df).collect()
    assert {(r.repo_id, r.directory): [r.issue_count, r.file_count] for r in out} == want and len(out) == len(want)


@pytest.mark.parametrize("n_keys,n", [(1, 50), (7, 400), (60, 900), (500, 700)])
def test_reuse_distances_replay_the_cache(spark, n_keys, n):
    rng = random.Random(n)
    keys = [None if k == 3 else f"k{k}" for k in (min(int(rng.expovariate(4 / n_keys)), n_keys) for _ in range(n))]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, request_key string").repartition(4)
    sizes = [1, 2, 10, 100]
    got = {r["size"]: (r["requests"], r["hits"]) for r in RC.cache_hit_rates(RC.reuse_distances(df, [F.col("i")]), sizes).collect()}
    for size in [*sizes, None]:
        cache, hits = OrderedDict(), 0
        for k in keys:
            if k in cache:
                cache.move_to_end(k)
                hits += 1
            else:
                if size is not None and len(cache) >= size:
                    cache.popitem(last=False)
                cache[k] = 1
        assert got[size] == (n, hits)


@pytest.mark.parametrize("bits", [1, 4])
def test_reuse_distances_over_many_stretches(spark, monkeypatch, bits):
    monkeypatch.setattr(RC, "STRETCH_BITS", bits)
    rng = random.Random(bits)
    keys = [None if k == 3 else f"k{k}" for k in (int(rng.expovariate(1 / 20)) for _ in range(700))]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, request_key string").repartition(4)
    found = RC.reuse_distances(df, [F.col("i")])
    last, want = {}, {}
    for i, k in enumerate(keys):
        want[i + 1] = len(set(keys[last[k] + 1:i])) if k in last else None
        last[k] = i
    assert {r["t"]: r["distance"] for r in found.collect()} == want
    # a request moves a fixed number of times, not once for every bit of its number
    assert "explode(sequence(0" not in found._jdf.queryExecution().analyzed().toString()


def test_no_requests(spark):
    df = spark.createDataFrame([], "i int, request_key string")
    assert RC.reuse_distances(df, [F.col("i")]).collect() == []


def changes(a, b):
    a, b = Counter(a), Counter(b)
    texts = lambda rows, key: sorted(("" if t is None else t, n) for (r, p, t), n in rows.items() if (r, p) == key)
    out = set()
    for key in {x[:2] for x in [*a, *b] if x[1] is not None}:
        old, new = texts(a, key), texts(b, key)
        if old != new:
            out.add((*key, "added" if not old else "removed" if not new else "modified"))
    return out


def test_snapshots_differ_where_texts_differ(spark):
    rng = random.Random(5)
    old = [(rng.choice(["r", None]), "/".join(rng.choices("abcd", k=rng.randint(1, 6))), f"text {i % 40}") for i in range(300)]
    new = [x for x in old if rng.random() > 0.05] + [("r", f"new/{i}/f", "t") for i in range(3)] + [("r", None, "no path"), ("q", "only/new", None)]
    new = [(r, p, "edited" if rng.random() < 0.05 else t) for r, p, t in new]
    schema = "repo_id string, path string, content string"
    a, b = (SN.snapshot(spark.createDataFrame(rows, schema).repartition(4)) for rows in (old, new))
    out = SN.changed_files(a, b).collect()
    assert {tuple(r) for r in out} == changes(old, new) and len(out) == len(set(out))
    assert SN.changed_files(a, a).collect() == []
    empty = SN.snapshot(spark.createDataFrame([], schema))
    assert {tuple(r) for r in SN.changed_files(empty, b).collect()} == changes([], new)


def test_a_file_becomes_a_directory(spark):
    schema = "repo_id string, path string, content string"
    a, b = (SN.snapshot(spark.createDataFrame(rows, schema)) for rows in ([("r", "a/b", "x"), ("r", "c", "y")], [("r", "a/b/c", "x"), ("r", "c", "y")]))
    assert {tuple(r)[1:] for r in SN.changed_files(a, b).collect()} == {("a/b", "removed"), ("a/b/c", "added")}


def test_only_differing_directories_are_opened(spark, monkeypatch):
    """One edit in a wide tree: the tables of differences hold the path from the root to it and nothing else."""
    schema = "repo_id string, path string, content string"
    rows = [("r", f"d{i}/e{j}/f{k}", "t") for i in range(6) for j in range(6) for k in range(6)]
    edited = [(r, p, "new" if p == "d3/e4/f5" else t) for r, p, t in rows]
    a, b = SN.snapshot(spark.createDataFrame(rows, schema)), SN.snapshot(spark.createDataFrame(edited, schema))
    seen, land = [], SN.land
    monkeypatch.setattr(SN, "land", lambda d, name: seen.append(land(d, name)) or seen[-1])
    assert [tuple(r) for r in SN.changed_files(a, b).collect()] == [("r", "d3/e4/f5", "modified")]
    assert [sorted(r.path for r in d.collect()) for d in seen] == [[""], ["d3"], ["d3/e4"], ["d3/e4/f5"]]
    plan = SN.changed_files(a, b)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan
