"""Benchmark decontamination by winnowing (operator 1, DataFrame functions only).

Every 13-word window of a text is represented by the smallest of the hashes of the 9-word grams inside it
(winnowing: k = 9, five grams to a window, so texts that share 13 consecutive words share a fingerprint).
Documents are semi-joined to the benchmark on distinct fingerprints, so nothing multiplies with the number of
items that share one.  Hits are then extended: in the documents found, every window whose fingerprint hit is
compared word by word with the benchmark's windows, and overlapping hits merge into hit words.  Items of fewer
than 13 words are one window of their own length; their documents' grams of that length are looked up likewise.

No side is broadcast by hint: Spark does so only where its measured size is below its own threshold.  A passage
that a third of the documents hold yields one row per document and start, never pairs of documents.

Defined results: null, empty and wordless texts have no words and are never hit; wordless items are no window;
rows that share doc_id and text are one document with the same result each; repeated items count once; a null
item_id counts as no item though its windows hit; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import cut, let, nested, row_key, table, upto, words

WINDOW = 13
GRAM = 9


def _minima(word_hashes: Column) -> Column:
    """Smallest gram hash of each window, by the window's start."""
    grams = F.transform(upto(F.size(word_hashes) - (GRAM - 1)), lambda i: F.xxhash64(F.slice(word_hashes, i + 1, GRAM)))
    return let(grams, lambda g: F.transform(upto(F.size(g) - (WINDOW - GRAM)),
                                            lambda i: F.array_min(F.slice(g, i + 1, WINDOW - GRAM + 1))))


def _fingerprints(tokens: Column) -> Column:
    return let(F.transform(tokens, lambda w: F.xxhash64(w)), _minima)


def _grams(tokens: Column, n: int) -> Column:
    return F.transform(upto(F.size(tokens) - (n - 1)), lambda i: F.xxhash64(F.slice(tokens, i + 1, n)))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item_id, len, window (its words): every window of every item."""
    worded = items.select("item_id", words(F.col("text")).alias("words"))
    n = F.least(F.size("words"), F.lit(WINDOW))
    windows = F.transform(upto(F.size("words") - n + 1), lambda i: F.slice("words", i + 1, n))
    return (worded.filter(F.size("words") > 0)
            .select("item_id", n.alias("len"), F.explode(F.array_distinct(windows)).alias("window")))


def _prints(tokens: Column, n: int) -> Column:
    """What stands for every window of n words: its winnowed hash, for short items the hash of its words."""
    return _fingerprints(tokens) if n == WINDOW else _grams(tokens, n)


def _candidates(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, key, len, hashes: the fingerprints of a document that the benchmark has too, of all lengths in one pass."""
    own = F.when(F.col("len") == WINDOW, _fingerprints(F.col("window"))[0]).otherwise(F.xxhash64("window"))
    theirs = windows.select("len", own.alias("h")).distinct()

    def tagged(prints: Column, n: int) -> Column:
        return F.transform(F.array_distinct(prints), lambda h: F.struct(F.lit(n).alias("len"), h.alias("h")))

    every = let(words(F.col("text")), lambda w: F.flatten(F.array(*[tagged(_prints(w, n), n) for n in lengths])))
    ours = docs.select("doc_id", row_key().alias("key"), F.explode(every).alias("x")).select("doc_id", "key", "x.len", "x.h")
    return (ours.join(theirs, ["len", "h"], "left_semi").groupBy("doc_id", "key", "len")
            .agg(F.collect_set("h").alias("hashes")))


def contaminated_windows(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits: doc_id, key, start, len, window), (the benchmark's windows)."""
    windows = cut(benchmark_windows(items))
    # at most WINDOW values, whatever the size of the benchmark
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect()) or [WINDOW]
    found = _candidates(docs, windows, lengths).select(
        F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "len", "hashes")
    keyed = docs.select("doc_id", "text", row_key().alias("key"))
    held = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")))

    def starts(w: Column) -> Column:
        by_length = F.lit(None).cast("array<bigint>")
        for n in lengths:
            by_length = F.when(F.col("len") == n, _prints(w, n)).otherwise(by_length)
        return let(by_length, lambda prints: F.transform(F.filter(
            F.transform(prints, lambda h, i: F.struct(h.alias("h"), i.alias("start"))),
            lambda x: F.array_contains("hashes", x["h"])), lambda x: F.struct(
                x["start"].alias("start"), F.slice(w, x["start"] + 1, F.col("len")).alias("window"))))

    exploded = held.select("doc_id", "key", "len", F.explode(let(words(F.col("text")), starts)).alias("x"))
    hits = (exploded.select("doc_id", "key", "len", "x.start", "x.window")
            .distinct().join(windows.select("window").distinct(), "window", "left_semi"))
    return hits, windows


def _merged(spans: Column) -> Column:
    """Positions covered by sorted (start, len) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(spans, zero, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["start"] + s["len"]).alias("end"),
        (acc["n"] + F.greatest(s["start"] + s["len"] - F.greatest(acc["end"], s["start"]), F.lit(0)))
        .cast("bigint").alias("n")))["n"]


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted array of item ids as strings), spans; one row per row of ``docs``."""
    hits, windows = contaminated_windows(docs, items)
    hits = cut(hits)
    spans = (hits.groupBy("doc_id", "key")
             .agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans")))
    # a passage's windows mostly belong to the same items: documents meet each set of items once, not each window's items
    sets = windows.groupBy("window").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    owners = (hits.select("doc_id", "key", "window").distinct().join(sets, "window").select("doc_id", "key", "items").distinct()
              .select("doc_id", "key", F.explode("items").alias("item"))
              .groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("item")).alias("items")))
    # text digests, not texts, meet the hits
    sized = docs.select("doc_id", row_key().alias("key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    for side, found in (("s", spans), ("o", owners)):
        found = found.withColumnsRenamed({"doc_id": f"{side}_doc", "key": f"{side}_key"})
        sized = sized.join(found, F.col("doc_id").eqNullSafe(F.col(f"{side}_doc"))
                           & (F.col("key") == F.col(f"{side}_key")), "left")
    return (sized.select("doc_id", "key", "n_words",
                    F.coalesce(_merged(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans"))


#: The contract's rule: some hit word, and a twentieth of the words or more are hit.
CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      F.expr(CONTAMINATED).alias("contaminated"))


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, with their columns as they came."""
    bad = (decontaminate(docs, table(spark, sf_dir, "benchmark")).filter(CONTAMINATED)
           .select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).distinct())
    return (nested(docs).select("row", "id", "key")
            .join(bad, F.col("id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left_anti")
            .select("row.*"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS body
  FROM iw, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS u(i) WHERE len(w) > 0),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS body
  FROM dw, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, len(w) - n + 2)) AS u(i)),
hits AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.body = win.body),
pos AS (SELECT DISTINCT doc_id, i + k AS p FROM hits, unnest(range(0, n)) AS u(k)),
per AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit,
       coalesce(per.n_items, 0)::BIGINT AS n_items, sha256(coalesce(per.ids, '')) AS items_sha256,
       coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(d.w) AS contaminated
FROM dw d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM pos GROUP BY 1) p ON d.doc_id = p.doc_id
LEFT JOIN per ON d.doc_id = per.doc_id
"""
