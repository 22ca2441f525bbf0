"""Progress tracking and summary-chunk assembly: batch forms and stream twins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ["complete", "failed"]
FORGET_AFTER_MS = 3_600_000  # a finished analysis leaves the state store after an hour


def _step(step, status) -> Column:
    return F.when(F.coalesce(F.col(step), F.lit("")) != "", F.col(step)).otherwise(F.col(status))


def progress_state(events: DataFrame) -> DataFrame:
    """Events -> current status, progress, message and step per analysis.

    The latest update (by ``seq``) wins; ``current_step`` falls back to the
    status; ``steps`` counts updates (``progress_steps`` has them as rows).  A
    keyed ``max_by`` aggregate, so partial aggregation keeps one candidate per
    analysis and map task.
    """
    last = F.max_by(F.struct("status", "progress", "message", "step", "ts"), F.col("seq"))
    agg = events.groupBy("analysis_id").agg(last.alias("_l"), F.count(F.lit(1)).alias("steps"),
                                            F.max("ts").alias("last_ts"))
    return agg.select("analysis_id", F.col("_l.status").alias("status"), F.col("_l.progress").alias("progress"),
                      F.col("_l.message").alias("message"), _step("_l.step", "_l.status").alias("current_step"), "steps",
                      "last_ts", F.col("_l.status").isin(*TERMINAL).alias("is_complete"))


def progress_steps(events: DataFrame) -> DataFrame:
    """The step history as rows, in ``seq`` order: a projection, batch and stream alike."""
    return events.select("analysis_id", "seq", "step", "message", "progress", F.col("ts").alias("timestamp"))


PROGRESS_OUT = ("analysis_id string, status string, progress int, message string, current_step string, steps long, "
                "is_complete boolean, late long")


def progress_state_stream(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Streaming twin (update mode): one small state row per analysis.

    ``late`` counts the analysis's events that were older than the watermark when they came (they still
    count as updates).  An analysis that has finished is forgotten an hour of event time later.
    """
    src = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)

    def update(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        seq, status, progress, message, step, steps, late, last = state.get if state.exists else (
            None, None, 0, None, None, 0, 0, 0)
        mark = state.getCurrentWatermarkMs()
        for pdf in frames:
            ms = pdf["ts"].astype("datetime64[ms]").astype("int64")
            steps, late, last = steps + len(pdf), late + int((ms < mark).sum()), max(last, int(ms.max()))
            top = pdf.loc[pdf["seq"].idxmax()]
            if seq is None or top["seq"] >= seq:
                seq, status, progress = int(top["seq"]), top["status"], int(top["progress"])
                message, step = top["message"], top["step"] or top["status"]
        state.update((seq, status, progress, message, step, steps, late, last))
        done = status in TERMINAL
        if done:
            state.setTimeoutTimestamp(max(last, mark) + FORGET_AFTER_MS)
        yield pd.DataFrame([(key[0], status, progress, message, step, steps, done, late)],
                           columns=[c.split()[0] for c in PROGRESS_OUT.split(", ")])

    return src.groupBy("analysis_id").applyInPandasWithState(
        update, PROGRESS_OUT, "seq long, status string, progress int, message string, step string, steps long, "
        "late long, last long", "update", "EventTimeTimeout")


# ---------------------------------------------------------------------------
# Summary chunks.  Event kinds: start, chunk, unavailable, failed, summary (the whole text, replacing the
# chunks so far; ``outcome`` may say failed) and complete (the analysis as a whole).

def assemble_chunks(chunks: DataFrame, min_progress: int = 75) -> DataFrame:
    """Summary text, state and progress per analysis, as its events leave them in ``seq`` order.

    start and chunk set ``streaming``; unavailable and failed set themselves; a summary with text replaces
    the text so far and sets ``complete`` (``failed`` if its outcome says so); complete sets ``complete``
    if there is text by then, and progress 100.  Chunks raise progress to ``min_progress``.  An analysis's
    events meet in one row, as its text does.
    """
    outcome = F.col("outcome") if "outcome" in chunks.columns else F.lit(None).cast("string")
    event = F.struct("seq", "kind", "text", outcome.alias("outcome"))
    events = chunks.groupBy("analysis_id").agg(F.sort_array(F.collect_list(event)).alias("_e"))
    zero = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).alias("progress"), F.lit(False).alias("text"),
                    F.lit(-1).alias("base"), F.lit(0).alias("at"))

    def fold(s, e):
        kind, blank = e["kind"], F.coalesce(e["text"], F.lit("")) == ""
        replaces = (kind == "start") | ((kind == "summary") & e["text"].isNotNull())
        text = (F.when(kind == "start", False).when(replaces, ~blank)
                .when(kind == "chunk", s["text"] | ~blank).otherwise(s["text"]))
        status = (F.when(kind.isin("start", "chunk"), "streaming").when(kind.isin("unavailable", "failed"), kind)
                  .when((kind == "summary") & (e["outcome"] == "failed"), "failed")
                  .when((kind == "summary") & ~blank, "complete")
                  .when((kind == "complete") & s["text"], "complete").otherwise(s["status"]))
        progress = (F.when(kind == "complete", 100).when(kind == "chunk", F.greatest(s["progress"], F.lit(min_progress)))
                    .otherwise(s["progress"]))
        return F.struct(status.alias("status"), progress.alias("progress"), text.alias("text"),
                        F.when(replaces, s["at"]).otherwise(s["base"]).alias("base"), (s["at"] + 1).alias("at"))

    folded = events.select("analysis_id", "_e", F.aggregate("_e", zero, fold).alias("_s"))
    # the text: from the last event that replaced it on
    told = F.filter(F.transform("_e", lambda e, i: F.struct(i.alias("i"), e.alias("e"))), lambda x: (
        x["i"] >= F.col("_s.base")) & ((x["e"]["kind"] == "chunk") | (x["i"] == F.col("_s.base"))))
    text = F.array_join(F.transform(told, lambda x: F.when(
        x["e"]["kind"] == "start", "").otherwise(F.coalesce(x["e"]["text"], F.lit("")))), "")
    return folded.select("analysis_id", text.alias("summary"),
                         F.size(F.filter("_e", lambda e: e["kind"] == "chunk")).cast("long").alias("chunks"),
                         F.col("_s.status").alias("status"), F.col("_s.progress").alias("progress"))


CHUNKS_OUT = "analysis_id string, summary string, chunks long, status string, progress int"


def assemble_chunks_stream(chunks: DataFrame, min_progress: int = 75, ts_col: str | None = None,
                           watermark: str = "1 hour") -> DataFrame:
    """Streaming twin (update mode): the same fold with the text so far as state; events of one
    micro-batch are taken in ``seq`` order.  With an event time (``ts_col``) a finished analysis is
    forgotten an hour after its last event; events without a time give nothing to expire by."""
    def update(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        text, count, status, progress = state.get if state.exists else ("", 0, None, 0)
        pdf = pd.concat(list(frames)).sort_values("seq", kind="stable")
        added = []
        for e in pdf.to_dict("records"):
            kind, said = e["kind"], e["text"] if isinstance(e["text"], str) else None
            if kind == "start":
                text, added, status = "", [], "streaming"
            elif kind == "chunk":
                added.append(said or "")
                count, status, progress = count + 1, "streaming", max(progress, min_progress)
            elif kind in ("unavailable", "failed"):
                status = kind
            elif kind == "summary":
                if said is not None:
                    text, added = said, []
                status = "failed" if e.get("outcome") == "failed" else "complete" if said else status
            elif kind == "complete":
                progress = 100
                status = "complete" if text or any(added) else status
        text += "".join(added)
        state.update((text, count, status, progress))
        if ts_col and (status in TERMINAL or status == "unavailable"):
            last = int(pdf[ts_col].astype("datetime64[ms]").astype("int64").max())
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + FORGET_AFTER_MS)
        yield pd.DataFrame([(key[0], text, count, status, progress)],
                           columns=["analysis_id", "summary", "chunks", "status", "progress"])

    keyed = chunks.withColumn("analysis_id", F.col("analysis_id").cast("string"))
    if ts_col:
        keyed = keyed.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    return keyed.groupBy("analysis_id").applyInPandasWithState(
        update, CHUNKS_OUT, "text string, chunks long, status string, progress int", "update",
        "EventTimeTimeout" if ts_col else "NoTimeout")
