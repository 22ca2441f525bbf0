"""Summary texts as ropes: ordered segments of bounded size instead of one row with everything.

``assemble_chunks`` gathers an analysis in a row.  Here its events are numbered and summed along their order
(``sequenced``: a long analysis spans many partitions): a running count of the events that replace the text (start, and
summary with text) tells epochs apart, and inside an epoch the running length gives every chunk its offset.  The text
is that of the last epoch, cut into segments of ``SEGMENT_CHARS`` characters; a chunk that crosses a cut writes a piece
into each segment.  The text as a whole exists only if a caller joins the segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.positions import null_safe_join, sequenced

SEGMENT_CHARS = 1 << 16


def _told(chunks: DataFrame) -> DataFrame:
    """Events with their epoch, their text's end in the epoch (``upto``) and the texts told so far in it (``told``)."""
    outcome = F.col("outcome") if "outcome" in chunks.columns else F.lit(None).cast("string")
    kind, text = F.col("kind"), F.coalesce("text", F.lit(""))
    replaces = F.coalesce((kind == "start") | ((kind == "summary") & F.col("text").isNotNull()), F.lit(False))
    own = F.when((kind == "chunk") | ((kind == "summary") & F.col("text").isNotNull()), text).otherwise(F.lit(""))
    events = chunks.select("analysis_id", "seq", "kind", outcome.alias("outcome"), own.alias("own"), replaces.alias("replaces"))
    order = [F.col("seq"), F.col("kind"), F.col("own")]
    epochs = sequenced(events, ["analysis_id"], order, "at", {"epoch": F.col("replaces").cast("long")})
    return sequenced(epochs, ["analysis_id", "epoch"], [F.col("at")], "_in", {
        "upto": F.length("own").cast("long"), "told": (F.col("own") != "").cast("long")}).drop("_in")


def chunk_states(chunks: DataFrame, min_progress: int = 75) -> DataFrame:
    """analysis_id, chars, chunks, status, progress: what ``assemble_chunks`` says, without the text."""
    events = _told(chunks)
    kind, blank = F.col("kind"), F.col("own") == ""
    status = (F.when(kind.isin("start", "chunk"), "streaming").when(kind.isin("unavailable", "failed"), kind)
              .when((kind == "summary") & (F.col("outcome") == "failed"), "failed")
              .when((kind == "summary") & ~blank, "complete")
              .when((kind == "complete") & (F.col("told") > 0), "complete"))
    return events.withColumn("_status", status).groupBy("analysis_id").agg(
        F.max_by("upto", "at").alias("chars"), F.count_if(kind == "chunk").alias("chunks"),
        F.max_by("_status", F.when(F.col("_status").isNotNull(), F.col("at"))).alias("status"),
        F.coalesce(F.max(F.when(kind == "complete", 100).when(kind == "chunk", min_progress)), F.lit(0)).alias("progress"))


def text_segments(chunks: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """analysis_id, segment (from 0), offset, length, text: the summary text in order; no row for an empty text."""
    events = _told(chunks)
    last = events.groupBy("analysis_id").agg(F.max("epoch").alias("epoch"))
    size = F.lit(segment_chars).cast("long")
    end = F.col("upto")
    begin = end - F.length("own")
    pieces = (null_safe_join(events.filter("own <> ''"), last, ["analysis_id", "epoch"])
              .select("analysis_id", "own", begin.alias("_b"), end.alias("_e"))
              .select("*", F.explode(F.sequence(F.floor(F.col("_b") / size), F.floor((F.col("_e") - 1) / size))).alias("segment")))
    first = F.greatest(F.col("segment") * size, F.col("_b"))
    stop = F.least((F.col("segment") + 1) * size, F.col("_e"))
    cut = pieces.select("analysis_id", "segment", F.struct(
        first.alias("offset"), F.substring("own", (first - F.col("_b") + 1).cast("int"), (stop - first).cast("int")).alias("text")).alias("p"))
    return (cut.groupBy("analysis_id", "segment").agg(F.sort_array(F.collect_list("p")).alias("_p"))  # at most segment_chars characters
            .select("analysis_id", "segment", F.get("_p", F.lit(0))["offset"].alias("offset"),
                    F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("text"))
            .select("analysis_id", "segment", "offset", F.length("text").cast("long").alias("length"), "text"))
