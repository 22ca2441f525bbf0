"""Line de-duplication by overlapping three-line windows (operator 2).

A text is its newline-separated lines; lines without a word (ASCII white space only) take no part.  Every three
consecutive remaining lines are one window, hashed to 128 bits.  A window that also stands earlier (smaller
doc_id, then earlier line) covers its three lines; covered positions are merged and their lines removed.

Windows are counted with map-side pre-aggregation, so a window that fills a third of the corpus reaches the
reducers as one row per task.  Only hashes of repeated windows are joined back, from a checkpointed table, which
lets adaptive execution split hot hashes; the text itself is joined once, by document.

Defined results: null and empty texts, and texts of fewer than three lines with a word, lose nothing; rows that
share doc_id and text are one document and are treated alike; null doc_ids sort first; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import cut, let, nested, row_key, table, upto

WINDOW = 3
#: A line with a word: something other than ASCII white space.
HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    """(position, line) of the lines that hold a word."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1),
                                lambda x, i: F.struct(i.alias("at"), x.alias("line"))),
                    lambda x: x["line"].rlike(HAS_WORD))


def _windows(text: Column) -> Column:
    """One (start, h1, h2) per window; start counts lines with a word."""
    return let(F.transform(_lines(text), lambda x: x["line"]), lambda lines: F.transform(
        upto(F.size(lines) - (WINDOW - 1)), lambda i: F.struct(
            i.alias("start"), F.xxhash64(F.slice(lines, i + 1, WINDOW)).alias("h1"),
            F.xxhash64(F.lit("second"), F.slice(lines, i + 1, WINDOW)).alias("h2"))))


def covered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, key, starts: starts of the windows that also stand earlier, for documents that have such."""
    at = (docs.select("doc_id", row_key().alias("key"), F.explode(_windows(F.col("text"))).alias("w"))
          .select("doc_id", "key", "w.start", "w.h1", "w.h2"))
    first = cut(at.groupBy("h1", "h2")
                .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "start")).alias("first"))
                .filter("n > 1").select("h1", "h2", "first"))
    later = (at.join(first, ["h1", "h2"])
             .filter(~F.struct("doc_id", "key", "start").eqNullSafe(F.col("first"))))
    return later.groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts"))


def judged_lines(docs: DataFrame) -> DataFrame:
    """row (the caller's columns), kept_text, n_lines (with a word) and n_removed."""
    covered = covered_lines(docs).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"),
                                         F.col("starts").alias("_starts"))
    joined = nested(docs).join(covered, F.col("id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    gone = F.transform(F.array_distinct(F.flatten(F.transform(
        F.col("_starts"), lambda s: F.array(*[s + i for i in range(WINDOW)])))), lambda i: i.cast("int"))
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    # positions that stay, by one set difference: linear in the lines
    kept = let(_lines(F.col("text")), lambda worded: let(lines, lambda each: F.array_join(F.transform(
        F.array_except(upto(F.size(each)), F.transform(gone, lambda i: F.element_at(worded, i + 1)["at"])),
        lambda i: F.element_at(each, i + 1)), "\n")))
    return joined.select(
        "row", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.when(F.col("_starts").isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias("n_removed"),
        F.when(F.col("_starts").isNull(), F.col("text")).otherwise(kept).alias("kept_text"))


RESULTS = ["n_lines", "n_removed", "kept_text"]


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with their columns and ``kept_text``, ``n_lines`` (with a word) and ``n_removed``, which take the place of
    columns of these names."""
    return judged_lines(docs).select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in RESULTS], *RESULTS)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines with a word, lines removed, and the digest of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed",
                                   F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; a document all of whose lines stand earlier goes."""
    out = judged_lines(docs).filter("n_removed = 0 OR n_removed < n_lines")
    text = F.col("kept_text")
    return out.select(*[text.alias("text") if c == "text"
                        else F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("row.n_chars"))
                        .cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"row.`{c}`")
                        for c in docs.columns])


WINDOWED_SQL = r"""
WITH line AS (
  SELECT doc_id, i AS ix, ls[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
       unnest(range(1, len(ls) + 1)) AS u(i)),
worded AS (
  SELECT doc_id, ix, line, row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS pos
  FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
win AS (
  SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS body
  FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS rn FROM win WHERE body IS NOT NULL),
dead AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, unnest([0, 1, 2]) AS u(k) WHERE rn > 1),
gone AS (
  SELECT w.doc_id, w.ix FROM worded w JOIN dead d ON w.doc_id = d.doc_id AND w.pos = d.pos)
"""

ORACLE = WINDOWED_SQL + """
SELECT d.doc_id, coalesce(n.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.body, '')) AS kept_sha256
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM worded GROUP BY 1) n ON d.doc_id = n.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1) g ON d.doc_id = g.doc_id
LEFT JOIN (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.ix) AS body
           FROM line l LEFT JOIN gone x ON l.doc_id = x.doc_id AND l.ix = x.ix WHERE x.ix IS NULL GROUP BY 1) k
       ON d.doc_id = k.doc_id
"""
