"""Summary chunks as a stream whose state grows by appending.

``assemble_chunks_stream`` keeps the text so far as one value and so writes it again with every batch.  Here the text is
a list in the state store: a batch appends its chunks and rewrites only a few numbers (characters, chunks, status,
progress), however long the text is.  A start event or a summary with text empties the list.  The whole text is read
once, when the analysis finishes; until then an update carries its numbers only.

With an event time a finished analysis is forgotten by a timer an hour after its last event.

The job runs on ``transformWithState``, which needs Spark's RocksDB state store (``ROCKSDB``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Setting that the session needs before the stream starts.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass",
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FORGET_AFTER_MS = 3_600_000
FINISHED = ("complete", "failed", "unavailable")
OUT = "analysis_id string, summary string, chars long, chunks long, status string, progress int"


class ChunkProcessor(StatefulProcessor):
    """One analysis: ``pieces`` of its text, and its ``numbers``."""

    def __init__(self, min_progress: int, timed: bool) -> None:
        self.min_progress, self.timed = min_progress, timed

    def init(self, handle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "text string")
        self.numbers = handle.getValueState("numbers", "chars long, chunks long, status string, progress int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chars, chunks, status, progress = self.numbers.get() if self.numbers.exists() else (0, 0, None, 0)
        added: list[tuple[str]] = []
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for e in events.to_dict("records"):
            kind, said = e["kind"], e["text"] if isinstance(e["text"], str) else None
            if kind == "start" or kind == "summary" and said is not None:
                self.pieces.clear()
                added, chars = [], 0
            if kind in ("chunk", "summary") and said:
                added.append((said,))
                chars += len(said)
            if kind in ("start", "chunk"):
                status = "streaming"
            elif kind in ("unavailable", "failed"):
                status = kind
            elif kind == "summary":
                status = "failed" if e.get("outcome") == "failed" else "complete" if said else status
            elif kind == "complete":
                status, progress = "complete" if chars else status, 100
            if kind == "chunk":
                chunks, progress = chunks + 1, max(progress, self.min_progress)
        if added:
            self.pieces.appendList(added)
        self.numbers.update((chars, chunks, status, progress))
        done = status in FINISHED
        if self.timed and done:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            last = int(events["event_time"].astype("datetime64[ms]").astype("int64").max())
            self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + FORGET_AFTER_MS)
        text = "".join(p[0] for p in self.pieces.get()) if done else None
        yield pd.DataFrame({"analysis_id": [key[0]], "summary": [text], "chars": [chars], "chunks": [chunks], "status": [status], "progress": [progress]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.pieces.clear()
        self.numbers.clear()
        yield pd.DataFrame(columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def assemble_chunks_appending(chunks: DataFrame, min_progress: int = 75, ts_col: str | None = None,
                              watermark: str = "1 hour") -> DataFrame:
    """analysis_id, summary (once finished, else null), chars, chunks, status, progress: an update for each batch that
    has events of the analysis; events of one micro-batch are taken in ``seq`` order."""
    outcome = F.col("outcome") if "outcome" in chunks.columns else F.lit(None).cast("string")
    events = chunks.select(F.col("analysis_id").cast("string").alias("analysis_id"), "seq", "kind", "text", outcome.alias("outcome"),
                           *([F.col(ts_col).cast("timestamp").alias("event_time")] if ts_col else []))
    if ts_col:
        events = events.withWatermark("event_time", watermark)
    return events.groupBy("analysis_id").transformWithStateInPandas(
        ChunkProcessor(min_progress, ts_col is not None), OUT, "update", "EventTime" if ts_col else "None")
