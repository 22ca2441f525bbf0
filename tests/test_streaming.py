import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from strata import fixtures as FX
from strata.session import checkpoint_dir
from strata.streaming import progress as PG
from strata.streaming import rate_limit as RL

SF = "/root/testdata/sf0.001"


def test_rate_limit_sequence(spark):
    base = dt.datetime(2024, 1, 1)
    secs = [0, 10, 20, 3599, 3600, 3605, 3611]
    rows = [("u", i, base + dt.timedelta(seconds=s)) for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "key string, request_id long, ts timestamp")
    got = [r.admitted for r in RL.rate_limit(df, 2).orderBy("request_id").collect()]
    assert got == [True, True, False, False, True, False, True]


def test_rate_limit_rejects_something_on_data(spark):
    out = RL.rate_limit(FX.requests(spark, SF), 2)
    assert out.filter(~F.col("admitted")).count() > 0
    assert out.count() == FX.requests(spark, SF).count()


def test_rate_limit_keeps_events_without_key_or_time(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(k, 10 * n + i, base + dt.timedelta(seconds=s))
            for n, k in enumerate([None, "u"]) for i, s in enumerate([0, 10, 20, 3600, 9000])]
    rows += [(k, 100 + 10 * n + i, None) for n, k in enumerate([None, "u"]) for i in range(3)]
    df = spark.createDataFrame(rows, "key string, request_id long, ts timestamp").repartition(3)
    for windows in (1, 24):
        out = RL.rate_limit(df, 2, chunk_windows=windows).collect()
        assert sorted((r.key or "", r.request_id, str(r.ts)) for r in out) == sorted((k or "", i, str(t)) for k, i, t in rows)
        got = {r.request_id: r.admitted for r in out}
        for n in (0, 10):
            assert [got[n + i] for i in range(5)] == [True, True, False, True, True]
            assert [got[100 + n + i] for i in range(3)] == [True, True, False]


def _admitted_in_order(rows, limit, window):
    """The sequential fold of (key, id, second)."""
    out, admitted = {}, {}
    for key, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        live = [x for x in admitted.get(key, []) if t - x < window]
        out[i] = len(live) < limit
        admitted[key] = live + [t] if out[i] else live
    return out


@pytest.mark.parametrize("limit,windows,warm", [(1, 1, 0), (2, 1, 1), (3, 4, 0), (2, 24, 2)])
def test_speculative_fold_is_the_sequential_fold(spark, limit, windows, warm):
    rng = random.Random(limit * 10 + windows)
    rows = []
    for key in range(6):  # sparse, bursty, and keys without any gap whose state never settles by itself
        t = 0
        for _ in range(400):
            t += [rng.randint(0, 200), rng.choice([0, 1, 3000, 9000]), 37, 35, rng.randint(900, 1900), 3599][key]
            rows.append((f"k{key}", len(rows), t))
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, i, base + dt.timedelta(seconds=t)) for k, i, t in rows],
                               "key string, request_id long, ts timestamp").repartition(5)
    out = RL.rate_limit(df, limit, chunk_windows=windows, warm_windows=warm).collect()
    assert len(out) == len(rows)
    assert {r.request_id: r.admitted for r in out} == _admitted_in_order(rows, limit, 3600)


def test_one_key_is_folded_by_many_tasks(spark):
    """A key without a gap: its chunks are pieces of the first round, and few rounds follow."""
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("hot", i, base + dt.timedelta(seconds=60 * i)) for i in range(6000)], "key string, request_id long, ts timestamp")
    landed, before = [], RL.land
    RL.land = lambda d, name: landed.append((name, before(d, name))) or landed[-1][1]
    try:
        out = RL.rate_limit(df, 7).collect()
    finally:
        RL.land = before
    first = next(d for name, d in landed if name == "rate-limit")
    assert first.filter("is_state").count() == 5 and len([1 for name, _ in landed if name == "rate-limit"]) <= 4
    want = _admitted_in_order([("hot", i, 60 * i) for i in range(6000)], 7, 3600)
    assert {r.request_id: r.admitted for r in out} == want


def _run_stream(spark, stream_df, name, mode):
    ck = os.path.join(checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex}")
    q = (stream_df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


def test_rate_limit_batch_equals_stream(spark):
    req = FX.requests(spark, SF)
    src = os.path.join(checkpoint_dir(spark), f"req-{uuid.uuid4().hex}")
    req.write.parquet(src)
    stream = spark.readStream.schema(req.schema).parquet(src)
    name = f"rl_{uuid.uuid4().hex[:8]}"
    got = _run_stream(spark, RL.rate_limit_stream(stream, 2), name, "append")
    batch = RL.rate_limit(req, 2)
    a = sorted(map(tuple, batch.select("key", "request_id", "admitted").collect()))
    b = sorted(map(tuple, got.select("key", "request_id", "admitted").collect()))
    assert a == b


def test_progress_state_batch_equals_stream(spark):
    ev = FX.progress_events(spark, SF)
    src = os.path.join(checkpoint_dir(spark), f"prog-{uuid.uuid4().hex}")
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    name = f"pg_{uuid.uuid4().hex[:8]}"
    got = _run_stream(spark, PG.progress_state_stream(stream), name, "update")
    cols = ["analysis_id", "status", "progress", "message", "current_step", "steps"]
    assert got.agg(F.sum("late")).first()[0] == 0
    a = sorted(map(tuple, PG.progress_state(ev).select(cols).collect()))
    b = sorted(map(tuple, got.select(cols).collect()))
    assert a == b


def test_assemble_chunks_terminal_states(spark):
    rows = [("a", 1, "chunk", "Hel"), ("a", 2, "chunk", "lo"), ("b", 1, "unavailable", None), ("c", 1, "failed", None)]
    rows += [("a", 3, "complete", None), ("d", 1, "unavailable", None), ("d", 2, "chunk", "x"), ("d", 3, "complete", None),
             ("e", 1, "chunk", "draft"), ("e", 2, "summary", "final"), ("f", 1, "chunk", "t"), ("f", 2, "unavailable", None),
             ("g", 1, "unavailable", None), ("g", 2, "complete", None), ("h", 1, "chunk", "old"), ("h", 2, "start", None),
             ("h", 3, "chunk", "new"), ("i", 1, "chunk", "k"), ("i", 2, "summary", None)]
    df = spark.createDataFrame(rows, "analysis_id string, seq long, kind string, text string")
    got = {r.analysis_id: (r.summary, r.status, r.progress) for r in PG.assemble_chunks(df).collect()}
    assert got == {"a": ("Hello", "complete", 100), "b": ("", "unavailable", 0), "c": ("", "failed", 0),
                   "d": ("x", "complete", 100), "e": ("final", "complete", 75), "f": ("t", "unavailable", 75),
                   "g": ("", "unavailable", 100), "h": ("new", "streaming", 75), "i": ("k", "streaming", 75)}


def test_assemble_chunks_batch_equals_stream(spark):
    ch = FX.summary_chunks(spark, SF)
    src = os.path.join(checkpoint_dir(spark), f"chunks-{uuid.uuid4().hex}")
    ch.write.parquet(src)
    stream = spark.readStream.schema(ch.schema).parquet(src)
    name = f"ch_{uuid.uuid4().hex[:8]}"
    got = _run_stream(spark, PG.assemble_chunks_stream(stream), name, "update")
    cols = ["analysis_id", "summary", "chunks", "status", "progress"]
    ch = ch.withColumn("analysis_id", F.col("analysis_id").cast("string"))
    a = sorted(map(tuple, PG.assemble_chunks(ch).select(cols).collect()))
    b = sorted(map(tuple, got.select(cols).collect()))
    assert a == b


def test_rule_feed_stream_equals_batch_fold(spark):
    from strata.operators import catalogue as CT
    from strata.plans.queries import _seeded
    from strata.streaming.rule_feed import RuleFeed

    cat = _seeded(spark, SF)
    changes = FX.rule_changes(spark, SF)
    src = os.path.join(checkpoint_dir(spark), f"feed-{uuid.uuid4().hex}")
    # three files, split by sequence ranges, so later micro-batches only hold later changes
    bounds = changes.approxQuantile("seq", [0.33, 0.66], 0.0)
    parts = [changes.filter(F.col("seq") <= bounds[0]),
             changes.filter((F.col("seq") > bounds[0]) & (F.col("seq") <= bounds[1])),
             changes.filter(F.col("seq") > bounds[1])]
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(os.path.join(src, f"part{k}"))
    stream = (spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    got = RuleFeed(spark, cat).run(stream)
    cols = ["rule_id", "severity", "message", "is_active"]
    a = sorted(map(tuple, CT.apply_rule_changes(cat, changes).select(cols).collect()))
    b = sorted(map(tuple, got.select(cols).collect()))
    assert a == b


ISSUES = "repo_id string, file_path string, note string"


def _versions(spark, rows):
    return spark.createDataFrame(rows, "repo_id string, path string, content string, size long, language string, "
                                       "lines int, deleted boolean, seq long")


def _job(spark, root):
    from strata.streaming.incremental import IncrementalScan
    scan = lambda f: f.select("repo_id", F.col("path").alias("file_path"), F.concat(F.lit("scan "), "content").alias("note"))
    return IncrementalScan(spark, scan, ISSUES, root, order_col="seq")


def test_incremental_scan_survives_restart_and_replay(spark):
    root = os.path.join(checkpoint_dir(spark), f"inc-{uuid.uuid4().hex}")
    job = _job(spark, root)
    seed = _versions(spark, [("r", "a", "a0", 2, "x", 1, False, 0), ("r", "b", "b0", 2, "x", 1, False, 0),
                             ("q", "z", "z0", 2, "x", 1, False, 0)])
    job.seed(seed, spark.createDataFrame([("r", "a", "seed a"), ("r", "b", "seed b"), ("q", "z", "seed z")], ISSUES))
    one = _versions(spark, [("r", "a", "a1", 2, "x", 1, False, 1), ("r", "a", "a2", 2, "x", 1, False, 2),
                            ("r", "c", "c1", 2, "x", 1, False, 1)])
    two = _versions(spark, [("r", "b", None, None, None, None, True, 3), ("r", "c", "c1", 2, "x", 1, False, 4)])
    job._batch(one, 0)
    # killed here: a new object on the same root replays batch 0 and goes on
    again = _job(spark, root)
    assert {r.note for r in again.issues().collect()} == {"scan a2", "scan c1", "seed b", "seed z"}
    again._batch(one, 0)
    again._batch(two, 1)
    again._batch(two, 1)
    last = _job(spark, root)
    assert {r.note for r in last.issues().collect()} == {"scan a2", "scan c1", "seed z"}
    assert {(r.repo_id, r.path) for r in last.snapshot().collect()} == {("r", "a"), ("r", "c"), ("q", "z")}
    assert not os.path.exists(f"{root}/issues/version=0/part=q")  # untouched repositories are not rewritten


LOGGED = {"names": ("k string, name string", ["k"]), "sizes": ("key string, size long", ["key"])}


def _folder_bytes(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root.replace("file:", "")) for f in names if f.endswith(".parquet"))


def test_delta_log_follows_the_changes(spark):
    """Random epochs, crashes before publishing, replays: the state is a dictionary's, and writes follow the change."""
    from strata.streaming.delta_log import DeltaLog
    root = os.path.join(checkpoint_dir(spark), f"log-{uuid.uuid4().hex}")
    log, want, rng, written = DeltaLog(spark, root, "k string", LOGGED, fanout=3), {}, random.Random(4), []
    seed = {f"k{i}": ("seed" * 500 + str(i), i) for i in range(2000)}

    def put(epoch, change, base):
        rows = {k: v for k, v in change.items() if v is not None}
        log.append(epoch, base, spark.createDataFrame([(k,) for k in change], "k string").coalesce(1),
                   {"names": spark.createDataFrame([(k, v[0]) for k, v in rows.items()], LOGGED["names"][0]).coalesce(1),
                    "sizes": spark.createDataFrame([(k, n) for k, v in rows.items() for n in range(v[1] % 3)], LOGGED["sizes"][0]).coalesce(1)})

    put(-1, seed, None)
    want.update(seed)
    for epoch in range(14):
        change = {rng.choice([f"k{rng.randint(0, 30)}", None]): rng.choice([None, (f"e{epoch}", rng.randint(0, 9))]) for _ in range(4)}
        base, before = log.newest(before=epoch), _folder_bytes(root)
        if epoch % 4 == 1:  # a crash after the delta is written, and after a merge: nothing is published
            published = DeltaLog.append.__globals__["_MANIFEST"]
            DeltaLog.append.__globals__["_MANIFEST"] = "no schema"
            with pytest.raises(Exception):
                put(epoch, change, base)
            DeltaLog.append.__globals__["_MANIFEST"] = published
            assert log.newest() == base
        put(epoch, change, base)
        if epoch % 5 == 2:
            put(epoch, change, log.newest(before=epoch))  # replayed
        want.update(change)
        written.append(_folder_bytes(root) - before)
    log = DeltaLog(spark, root, "k string", LOGGED, fanout=3)
    deltas = log.newest()
    assert {r.k: r.name for r in log.read("names", deltas).collect()} == {k: v[0] for k, v in want.items() if v}
    assert sorted(((r.key or ""), r.size) for r in log.read("sizes", deltas).collect()) == sorted(
        ((k or ""), n) for k, v in want.items() if v for n in range(v[1] % 3))
    some = spark.createDataFrame([("k3",), (None,), ("k1999",)], "k string")
    assert {r.k for r in log.read("names", deltas, some).collect()} == {k for k in ("k3", None, "k1999") if want.get(k)}
    assert len(deltas) <= 2 * 4 and max(d["level"] for d in deltas) >= 2
    assert sorted(written)[len(written) // 2] < 40_000  # the seed is some hundred times that


def test_rule_feed_survives_restart_and_replay(spark):
    from strata.streaming.rule_feed import RuleFeed
    root = os.path.join(checkpoint_dir(spark), f"feed-{uuid.uuid4().hex}")
    cat = FX.rules(spark)
    change = lambda rows: spark.createDataFrame(rows, "rule_id string, seq long, action string, severity string, pattern string, is_active boolean")
    one = change([("PII-EMAIL", 1, "toggle", None, None, None), ("STYLE-ANY-E", 2, "update", "high", "E+", True)])
    two = change([("PII-EMAIL", 3, "toggle", None, None, None), ("PII-PHONE", 4, "delete", None, None, None),
                  ("STYLE-ANY-E", 5, "update", None, None, False), ("STYLE-ANY-E", 6, "toggle", None, None, None)])
    RuleFeed(spark, cat, root)._batch(one, 0)
    again = RuleFeed(spark, cat, root)
    for batch, epoch in ((one, 0), (two, 1), (two, 1)):
        again._batch(batch, epoch)
    got = {r.rule_id: r for r in RuleFeed(spark, cat, root).catalogue().collect()}
    assert "PII-PHONE" not in got and got["PII-EMAIL"].is_active
    assert (got["STYLE-ANY-E"].severity, got["STYLE-ANY-E"].pattern, got["STYLE-ANY-E"].is_active) == ("high", "E+", True)
    assert got["PII-EMAIL"].created_at is not None
