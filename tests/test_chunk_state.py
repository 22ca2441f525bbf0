"""The appending stream against the batch, and what a batch writes to its state."""

import datetime as dt
import json
import os
import random
import uuid

import pytest

from strata.session import checkpoint_dir
from strata.streaming import chunk_state as CS
from strata.streaming import progress as PG

SCHEMA = "analysis_id string, seq long, kind string, text string, outcome string, ts timestamp"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(CS.ROCKSDB[0], None)
    spark.conf.set(*CS.ROCKSDB)
    yield
    spark.conf.set(CS.ROCKSDB[0], before) if before else spark.conf.unset(CS.ROCKSDB[0])


def run(spark, batches, ts_col=None):
    """One micro-batch per list of rows; (latest row of every analysis, state bytes written by each batch)."""
    src = os.path.join(checkpoint_dir(spark), f"chunks-{uuid.uuid4().hex}")
    latest, name = {}, f"c{uuid.uuid4().hex[:8]}"
    written = []

    def keep(df, _):
        latest.update({r["analysis_id"]: r for r in df.collect()})

    spark.createDataFrame([], SCHEMA).write.parquet(src)
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        q = (CS.assemble_chunks_appending(spark.readStream.schema(SCHEMA).parquet(src), ts_col=ts_col).writeStream.foreachBatch(keep)
             .outputMode("update").option("checkpointLocation", f"{src}-{name}").trigger(availableNow=True).start())
        q.awaitTermination()
        metrics = [json.loads(p.json)["stateOperators"][0]["customMetrics"] for p in q.recentProgress if p.stateOperators]
        written.append(max((m.get("rocksdbTotalBytesWritten", 0) for m in metrics), default=0))
    return latest, written


def test_batches_of_a_stream_equal_the_batch(spark, rocksdb):
    rng = random.Random(6)
    kinds = ["chunk"] * 10 + ["start", "summary", "unavailable", "failed", "complete"]
    rows = [(rng.choice("abc"), i, rng.choice(kinds), rng.choice([None, "", f"piece {i} "]), rng.choice([None, "failed"]), dt.datetime(2024, 1, 1))
            for i in range(150)]
    got, _ = run(spark, [rows[:40], rows[40:90], rows[90:]])
    want = PG.assemble_chunks(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(want) == len(got) == 3
    for r in want:
        mine = got[r.analysis_id]
        assert (mine.chars, mine.chunks, mine.status, mine.progress) == (len(r.summary), r.chunks, r.status, r.progress)
        assert mine.summary == (r.summary if r.status in CS.FINISHED else None)


def test_a_batch_writes_its_own_chunks(spark, rocksdb):
    """Equal batches of an ever longer text write equal amounts."""
    ts = dt.datetime(2024, 1, 1)
    batches = [[("a", 100 * b + i, "chunk", f"{b}-{i} " + "x" * 200, None, ts) for i in range(100)] for b in range(5)]
    got, written = run(spark, batches)
    assert got["a"].chars == sum(len(r[3]) for rows in batches for r in rows) and got["a"].summary is None
    assert written[0] > 0 and max(written[1:]) < 1.5 * min(written[1:])


def test_a_finished_analysis_is_forgotten(spark, rocksdb):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[("a", 1, "chunk", "one", None, at(0)), ("a", 2, "complete", None, None, at(0))], [("b", 1, "chunk", "x", None, at(9))],
               [("b", 2, "chunk", "y", None, at(9))], [("a", 3, "chunk", "new", None, at(10))]]
    got, _ = run(spark, batches, "ts")
    assert (got["a"].chars, got["a"].chunks, got["a"].status) == (3, 1, "streaming")
    assert got["b"].chars == 2
