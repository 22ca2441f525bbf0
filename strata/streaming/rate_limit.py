"""Per-key sliding-hour admission (batch and Structured Streaming twins).

An event is admitted when fewer than ``N`` *admitted* events of its key are
younger than the window (age < 3600 s); rejected events do not count.  The
decision depends on earlier decisions, so it is not a range-window count.

Batch: a speculative parallel fold.  A key's time is cut into chunks of ``CHUNK_WINDOWS`` windows, and every chunk is
folded on its own: it starts from an empty state ``WARM_WINDOWS`` windows before its first event and so usually enters with
the state the whole fold would have.  Each chunk keeps the state (at most ``N`` admitted times) it entered and left
with.  Where the state left by the chunk before differs from the state entered, the chunk is folded again from the
true one, together with the chunks after it in its group; groups double every round, so a key whose chunks never agree
by themselves is done after as many rounds as its number of chunks has bits.  When all states agree, every decision
is the sequential fold's.

Stream: ``applyInPandasWithState`` keeps the same ``N`` timestamps per key in
the state store, with an event-time watermark of one window.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.positions import null_safe_join
from strata.session import land

WINDOW_SECONDS = 3600
# Windows of a key folded together, and windows before them from which the fold starts with an empty state.
CHUNK_WINDOWS = 24
WARM_WINDOWS = 2
# FIXED VALUES: configured limits per hour
LIMITS = {"analysis": 10, "ai": 20, "token": 5}

OUT_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("request_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("admitted", T.BooleanType()),
])


class _Fold:
    """Admission of one key's events in order of time."""

    def __init__(self, limit: int, window_us: int, admitted=()) -> None:
        self.limit, self.window_us, self.admitted = limit, window_us, deque(int(x) for x in admitted)

    def forget(self, now: int) -> None:
        while self.admitted and now - self.admitted[0] >= self.window_us:
            self.admitted.popleft()

    def admit(self, now: int) -> bool:
        self.forget(now)
        if len(self.admitted) < self.limit:
            self.admitted.append(now)
            return True
        return False


# Rows of a round: decisions (``is_state`` false), and for each chunk the states it entered and left with.
_ROUND = ("key string, request_id long, ts timestamp, admitted boolean, chunk long, is_state boolean, first_us long, "
          "entered array<long>, left array<long>")


def _fold_pieces(pieces: DataFrame, limit: int, window_us: int) -> DataFrame:
    """Folds rows (key, piece, chunk, warm, ts, request_id, entered) piece by piece; a piece is one or more chunks.

    One pass over rows sorted by (key, piece, time) carries a single fold and writes the states at every change
    of chunk.  Warm rows move the state only.
    """
    ordered = pieces.repartition("key", "piece").sortWithinPartitions("key", "piece", "chunk", "ts", "request_id")
    columns = ["key", "request_id", "ts", "admitted", "chunk", "is_state", "first_us", "entered", "left"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = fold = chunk = None  # chunk: [key, chunk, first_us, state entered]

        def state() -> tuple:
            return (chunk[0], None, None, None, chunk[1], True, chunk[2], chunk[3], list(fold.admitted))

        for pdf in batches:
            times = pdf["ts"].values.astype("datetime64[us]").astype(np.int64).tolist()
            keys = pdf["key"].astype(object).where(pdf["key"].notna(), None).tolist()
            chunks = [None if pd.isna(c) else int(c) for c in pdf["chunk"]]
            piece = [None if pd.isna(c) else int(c) for c in pdf["piece"]]
            flags, out = np.zeros(len(pdf), bool), []
            for i, (key, now, warm) in enumerate(zip(keys, times, pdf["warm"].tolist())):
                if fold is None or at != (key, piece[i]):
                    if chunk is not None:
                        out.append(state())
                    entered = pdf["entered"].iat[i]
                    at, fold, chunk = (key, piece[i]), _Fold(limit, window_us, () if entered is None else entered), None
                if not warm and (chunk is None or chunk[1] != chunks[i]):
                    if chunk is not None:
                        out.append(state())
                    fold.forget(now)
                    chunk = (key, chunks[i], now, list(fold.admitted))
                flags[i] = fold.admit(now)
            own = ~pdf["warm"].to_numpy(bool)
            decided = pdf.loc[own, ["key", "request_id", "ts", "chunk"]].assign(
                admitted=flags[own], is_state=False, first_us=None, entered=None, left=None)
            yield decided[columns]
            if out:
                yield pd.DataFrame(out, columns=columns)
        if chunk is not None:
            yield pd.DataFrame([state()], columns=columns)

    return ordered.mapInPandas(run, _ROUND)


def rate_limit(events: DataFrame, limit: int, key_col: str = "key", ts_col: str = "ts",
               id_col: str = "request_id", window_seconds: int = WINDOW_SECONDS,
               chunk_windows: int = CHUNK_WINDOWS, warm_windows: int = WARM_WINDOWS) -> DataFrame:
    """Admission flag for every event (batch), by the speculative fold described above.

    The first round folds every chunk of ``chunk_windows`` windows, in as many tasks as there are; its events travel
    once (those of a chunk's last ``warm_windows`` also to the next chunk).  Later rounds read only the keys and chunks
    whose states disagree.  Every round ends in a table in the shared folder.

    A null key is a key like others; a key's events without a time are a piece of their own, in which the first
    ``limit`` by id are admitted.
    """
    window_us = int(window_seconds) * 1_000_000
    span = window_us * chunk_windows
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    src = events.select(F.col(key_col).cast("string").alias("key"), F.col(id_col).cast("long").alias("request_id"),
                        F.col(ts_col).cast("timestamp").alias("ts")).withColumn("chunk", F.floor(us / F.lit(span)))
    own = F.struct(F.col("chunk").alias("chunk"), F.lit(False).alias("warm"))
    late = us >= (F.col("chunk") + 1) * span - warm_windows * window_us
    copies = F.when(late, F.array(own, F.struct((F.col("chunk") + 1).alias("chunk"), F.lit(True).alias("warm")))).otherwise(F.array(own))
    none = F.lit(None).cast("array<bigint>")
    first = src.withColumn("c", F.explode(copies)).select("key", "request_id", "ts", "c.*", F.col("c.chunk").alias("piece"), none.alias("entered"))
    rounds = [land(_fold_pieces(first, limit, window_us).withColumn("round", F.lit(0)), "rate-limit")]
    base = rounds[0].agg(F.min("chunk")).first()[0] or 0
    while True:
        states = rounds[0].filter("is_state AND chunk IS NOT NULL")
        for later in rounds[1:]:
            states = states.unionByName(later.filter("is_state"))
        if len(rounds) > 1:  # a chunk's latest states
            latest = states.groupBy("key", "chunk").agg(F.max_by(F.struct("first_us", "entered", "left"), "round").alias("s"))
            states = latest.select("key", "chunk", "s.*")
        before = Window.partitionBy("key").orderBy("chunk")  # a row for every chunk of a key
        truth = F.filter(F.coalesce(F.lag("left").over(before), F.array().cast("array<bigint>")),
                         lambda t: F.col("first_us") - t < window_us)
        wrong = (states.withColumn("truth", truth).filter(F.col("truth") != F.col("entered"))
                 .select("key", "chunk", "truth", F.shiftright(F.col("chunk") - base, len(rounds)).alias("piece")))
        again = land(wrong.groupBy("key", "piece").agg(F.min("chunk").alias("from"), F.min_by("truth", "chunk").alias("entered")),
                     "rate-limit-again")
        if again.isEmpty():
            break
        placed = src.withColumn("piece", F.shiftright(F.col("chunk") - base, len(rounds)))
        redo = null_safe_join(placed, again, ["key", "piece"]).filter("chunk >= `from`").withColumn("warm", F.lit(False))
        rounds.append(land(_fold_pieces(redo, limit, window_us).withColumn("round", F.lit(len(rounds))), "rate-limit"))
    decided = rounds[0].filter("NOT is_state")
    if len(rounds) > 1:
        for later in rounds[1:]:
            decided = decided.unionByName(later.filter("NOT is_state"))
        redone = rounds[1].filter("is_state").select("key", "chunk", "round")
        for later in rounds[2:]:
            redone = redone.unionByName(later.filter("is_state").select("key", "chunk", "round"))
        last = redone.groupBy("key", "chunk").agg(F.max("round").alias("_last"))
        decided = null_safe_join(decided, last, ["key", "chunk"], "left").filter(F.col("round") == F.coalesce("_last", F.lit(0)))
    return decided.select("key", "request_id", "ts", "admitted")


STATE_SCHEMA = T.StructType([T.StructField("admitted_us", T.ArrayType(T.LongType()))])


def rate_limit_stream(events: DataFrame, limit: int, key_col: str = "key", ts_col: str = "ts",
                      id_col: str = "request_id", window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Streaming twin: per-key state = admitted timestamps still inside the window."""
    window_us = int(window_seconds) * 1_000_000
    src = (events.select(F.col(key_col).cast("string").alias("key"), F.col(id_col).cast("long").alias("request_id"),
                         F.col(ts_col).cast("timestamp").alias("ts"))  # watermarks need TIMESTAMP (not NTZ)
           .withWatermark("ts", f"{int(window_seconds)} seconds"))

    def step(key, pdfs, state):
        if state.hasTimedOut:  # a window after the last admission: nothing left to remember
            state.remove()
            return
        admitted = state.get[0] if state.exists else []
        # of the key's micro-batch only two numbers a row are held, for the order by time
        times, ids = zip(*((p["ts"].values.astype("datetime64[us]").astype(np.int64), p["request_id"].to_numpy())
                           for p in pdfs))
        ts_us, ids = np.concatenate(times), np.concatenate(ids)
        order = np.lexsort((ids, ts_us))
        ts_us, ids = ts_us[order], ids[order]
        fold = _Fold(limit, window_us, admitted)
        flags = np.array([fold.admit(t) for t in ts_us.tolist()], bool)
        kept = list(fold.admitted)
        state.update((kept,))
        if kept:
            state.setTimeoutTimestamp((kept[-1] + window_us) // 1000)
        for at in range(0, len(ids), 10_000):
            part = slice(at, at + 10_000)
            yield pd.DataFrame({"key": key[0], "request_id": ids[part], "ts": ts_us[part].astype("datetime64[us]"),
                                "admitted": flags[part]})

    return src.groupBy("key").applyInPandasWithState(
        step, OUT_SCHEMA, STATE_SCHEMA, "append", "EventTimeTimeout")
