"""Ranked lexical search with bit-sliced Bloom signatures (operator 11).

Index.  Documents stand in blocks of similar size.  A block is a bit matrix: a column for every document, a row for
every hash value.  A term sets its ``HASHES`` rows in its document's column, once for each of ``LEVELS`` that its
number of occurrences reaches.  The rows of a term and level, and-ed, are a bitmap of the documents that may hold
the term so often; it may say so wrongly, but never misses one.

Bounds.  For a block and a set of queries the bitmaps say the highest level a term may have in a document.  The score
that the level's largest count would give, times the term's weight, summed over a query's terms, is an upper bound of
the document's score (the rows' weighted sums, all documents of the block at once).

Search.  (1) The ``PROBES`` documents of highest bound are scored exactly for each query; the ``TOP``-th best of these
scores is a threshold that the result cannot fall below.  (2) Every document whose bound reaches it is scored exactly
from its text; what is excluded is proven to be below.  Of documents with one text only the ``TOP`` smallest doc_ids
can be in a result; the others are excluded too.

Scale.  The texts are read once for the index and the document frequencies (a partial count per task), and twice
for scoring, where only the documents asked for leave the scan.  Queries are taken in blocks of bounded text; the
queries and thresholds of a block go to every task, documents never do.  Probes and documents to
score are broadcast only if their count allows it, and else joined by a shuffle.
A query's best documents are limited in every task before they meet.

Defined results: null and wordless texts have no terms and are never found; a wordless query finds nothing; every
row of ``documents`` counts, repeated ones too, and has a rank of its own; null doc_ids come last among equal scores;
repeated queries (equal item_id and text) are one, several texts under one item_id are queries of their own, each
with its own ranks; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.llm.common import cut, land, map_columns, row_key, shared_dir, sized, table

TOP = 20
PROBES = 32
HASHES = 3
#: Occurrences from which a term has a further level in a signature.
LEVELS = (1, 2, 3, 5, 9)
#: Rows of a block's matrix per term and level of its largest document.
ROWS_PER_KEY = 8
#: Documents of a block, bits of a block's matrix, keys held by a task before it writes blocks, distinct terms counted
#: by a task before it writes counts, characters and number of queries in a block, terms of queries bounded at once,
#: documents to score that may be broadcast (they bound memory, not results).
BLOCK_DOCS = 1024
BLOCK_BITS = 1 << 25
HELD_KEYS = 1 << 21
HELD_TERMS = 1 << 19
QUERY_CHARS = 1 << 22
QUERY_ROWS = 20_000
TERMS_AT_ONCE = 4096
BROADCAST_ROWS = 200_000
#: Bounds are summed in single precision; they are raised by more than the rounding can take away.
SLACK = 1.0001

#: Letters, digits and all that is not ASCII make terms; A-Z become a-z and other bytes white space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def term_hashes(distinct) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64)


def slice_rows(hashes: np.ndarray, level: int, rows: int) -> np.ndarray:
    """The matrix rows of each hash at a level, one line per hash function (``rows``: a power of two)."""
    h = hashes * np.uint64(2 * level + 0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    step = (hashes >> np.uint64(17)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(rows - 1) for i in range(HASHES)]).astype(np.int64)


def length_norm(n: np.ndarray | int, n_docs: int, n_terms: int):
    return 100 - 25 + (25 * n * n_docs) // n_terms


def saturation(tf, norm):
    return (1_000_000_000 * tf) // (1000 * tf + 12 * norm)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ---- index ----------------------------------------------------------------------------------------------------------

_INDEX = ("term binary, df long, doc_ids array<long>, keys array<long>, sizes array<long>, rows long, slices binary")


def _blocks(held: list[tuple]) -> Iterator[list]:
    """Index rows of documents (doc_id, key, size, hashes, levels), those of similar size together."""
    held.sort(key=lambda d: -int(d[4].sum()))
    at = 0
    while at < len(held):
        keys = int(held[at][4].sum())
        rows = 1 << max(6, (ROWS_PER_KEY * keys - 1).bit_length())
        most = min(BLOCK_DOCS, max(8, BLOCK_BITS // rows // 8 * 8))
        some = [d for d in held[at: at + most] if 2 * int(d[4].sum()) >= keys]
        at += len(some)
        bits = np.zeros((rows, -(-len(some) // 8) * 8), bool)
        columns = np.repeat(np.arange(len(some)), [len(d[3]) for d in some])
        hashes, levels = np.concatenate([d[3] for d in some]), np.concatenate([d[4] for d in some])
        for level in range(len(LEVELS)):
            reached = levels > level
            for own in slice_rows(hashes[reached], level, rows):
                bits[own, columns[reached]] = True
        yield [[None], [None], *[[[d[i] for d in some]] for i in range(3)], [rows], [np.packbits(bits, axis=1).tobytes()]]


def build_index(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: signature blocks, and partial document frequencies of terms."""
    def counts(df: Counter) -> list:
        return [list(df), list(df.values()), *[[None] * len(df)] * 5]

    def run(slices: Iterator[list]) -> Iterator[list]:
        held, n_keys, df = [], 0, Counter()
        for doc_ids, keys, texts in slices:
            for doc_id, key, text in zip(doc_ids, keys, texts):
                found = terms(text)
                if not found:
                    continue
                tf = Counter(found)
                df.update(tf.keys())
                levels = np.searchsorted(LEVELS, np.fromiter(tf.values(), np.int64, len(tf)), "right")
                held.append((doc_id, key, len(found), term_hashes(tf), levels))
                n_keys += len(tf)
                if n_keys > HELD_KEYS:
                    yield from _blocks(held)
                    held, n_keys = [], 0
            if len(df) > HELD_TERMS:
                yield counts(df)
                df.clear()
        if df:
            yield counts(df)
        yield from _blocks(held)

    return map_columns(sized(docs.select("doc_id", row_key().alias("key"), "text")), ["doc_id", "key", "text"], _INDEX, run)


# ---- bounds ---------------------------------------------------------------------------------------------------------

class Queries:
    """A block of queries: their terms' weights, prepared for bounding and for scoring."""

    def __init__(self, queries: list[Counter], df: dict[bytes, int], n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.terms = [{t: q * weight(df[t], n_docs) for t, q in tf.items() if t in df} for tf in queries]
        self.groups: list[tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]] = []
        place: dict[bytes, int] = {}
        members: list = []
        for i, own in enumerate(self.terms):
            if members and len(place) + len(own) > TERMS_AT_ONCE:
                self.groups.append((term_hashes(place), members))
                place, members = {}, []
            if own:
                at = np.array([place.setdefault(t, len(place)) for t in own], np.int64)
                members.append((i, at, np.array(list(own.values()), np.float32)))
        self.groups.append((term_hashes(place), members))

    def bounds(self, sizes: np.ndarray, rows: int, slices: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(query, upper bound of each document's score) over a block."""
        matrix = np.frombuffer(slices, np.uint8).reshape(rows, -1)
        n, norm = len(sizes), length_norm(sizes, self.n_docs, self.n_terms)
        top = [*(x - 1 for x in LEVELS[1:]), None]
        most = np.stack([np.zeros(n), *[saturation(t, norm) if t else np.full(n, 1_000_000) for t in top]])
        most, each = most.astype(np.float32), np.arange(n)
        for hashes, members in self.groups:
            level = np.zeros((len(hashes), n), np.uint8)
            alive = None
            for i in range(len(LEVELS)):
                for own in slice_rows(hashes, i, rows):
                    alive = matrix[own] if alive is None else alive & matrix[own]
                level += np.unpackbits(alive, axis=1, count=n)
            gains = most[level, each]
            for query, at, weights in members:
                yield query, weights @ gains[at]

    def scores(self, text: str | None, asked: list[int]) -> Iterator[tuple[int, int]]:
        """(query, exact score) of a document."""
        found = terms(text)
        tf, norm = Counter(found), length_norm(len(found), self.n_docs, self.n_terms)
        for query in asked:
            yield query, sum(w * saturation(tf[t], norm) for t, w in self.terms[query].items() if t in tf)


def _block_rows(index: DataFrame) -> DataFrame:
    return index.filter("slices IS NOT NULL").select("doc_ids", "keys", "sizes", "rows", "slices")


def best_bounds(index: DataFrame, queries: Queries, probes: int) -> DataFrame:
    """query, doc_id, key: the documents of highest bound for each query."""
    def run(slices: Iterator[list]) -> Iterator[list]:
        best: dict[int, list] = {}
        for each in slices:
            for doc_ids, keys, sizes, rows, raw in zip(*each):
                for query, bound in queries.bounds(np.array(sizes), rows, raw):
                    at = np.argpartition(-bound, probes)[:probes] if len(bound) > probes else np.arange(len(bound))
                    mine = best.setdefault(query, [])
                    mine += [(float(bound[i]), doc_ids[i], keys[i]) for i in at.tolist() if bound[i] > 0]
                    if len(mine) > probes:
                        mine.sort(key=lambda x: -x[0])
                        del mine[probes:]
        for query, mine in best.items():
            if mine:
                bound, doc_ids, keys = zip(*mine)
                yield [[query] * len(mine), list(bound), list(doc_ids), list(keys)]

    found = map_columns(_block_rows(index), ["doc_ids", "keys", "sizes", "rows", "slices"],
                        "query int, bound double, doc_id long, key long", run, rows=8)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.col("bound").desc(), "doc_id", "key"))
    return found.withColumn("_at", place).filter(F.col("_at") <= probes).select("query", "doc_id", "key")


def not_excluded(index: DataFrame, queries: Queries, thresholds: dict[int, int], top: int) -> DataFrame:
    """query, doc_id, key: documents whose bound reaches the query's threshold; of one text the smallest doc_ids."""
    def run(slices: Iterator[list]) -> Iterator[list]:
        for each in slices:
            for doc_ids, keys, sizes, rows, raw in zip(*each):
                out: list[tuple] = []
                for query, bound in queries.bounds(np.array(sizes), rows, raw):
                    at = np.flatnonzero(bound * SLACK >= thresholds.get(query, 1)).tolist()
                    of_text: Counter = Counter()
                    for i in sorted(at, key=lambda i: (doc_ids[i] is None, doc_ids[i])) if len(at) > top else at:
                        of_text[keys[i]] += 1
                        if of_text[keys[i]] <= top:
                            out.append((query, doc_ids[i], keys[i]))
                if out:
                    yield list(zip(*out))

    found = map_columns(_block_rows(index), ["doc_ids", "keys", "sizes", "rows", "slices"],
                        "query int, doc_id long, key long", run, rows=8).distinct()
    place = F.row_number().over(W.partitionBy("query", "key").orderBy(F.col("doc_id").asc_nulls_last()))
    return found.withColumn("_at", place).filter(F.col("_at") <= top).drop("_at")


# ---- search ---------------------------------------------------------------------------------------------------------

def exact_scores(docs: DataFrame, asked: DataFrame, queries: Queries, small: bool) -> DataFrame:
    """query, doc_id, key, score (above 0) of the documents asked for, from their texts."""
    wanted = (asked.groupBy("doc_id", "key").agg(F.collect_list("query").alias("asked"))
              .withColumnsRenamed({"doc_id": "_doc", "key": "_key"}))
    keyed = docs.select("doc_id", row_key().alias("key"), "text")
    met = keyed.join(F.broadcast(wanted) if small else wanted,
                     F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")))

    def run(slices: Iterator[list]) -> Iterator[list]:
        for doc_ids, keys, texts, wanted in slices:
            out = [(query, doc_id, key, score) for doc_id, key, text, own in zip(doc_ids, keys, texts, wanted)
                   for query, score in queries.scores(text, own) if score > 0]
            if out:
                yield list(zip(*out))

    return map_columns(met, ["doc_id", "key", "text", "asked"], "query int, doc_id long, key long, score long", run)


def ranked(scores: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "key")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, probes: int = PROBES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the best documents of each item."""
    spark = docs.sparkSession
    index = land(build_index(docs), f"{shared_dir(spark).rstrip('/')}/signatures-{uuid.uuid4().hex}")
    total = index.filter("slices IS NOT NULL").select(
        F.sum(F.size("sizes")).alias("docs"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("terms")).first()
    shape = items.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {shape.simpleString()}, rank int, doc_id long, score long")
    asked = items.select("item_id", "text").filter("text IS NOT NULL").distinct()
    size = asked.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("rows")).first()
    blocks = max(math.ceil((size["chars"] or 0) / QUERY_CHARS), math.ceil(size["rows"] / QUERY_ROWS))
    if not total["docs"]:
        return out
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        counters = [Counter(terms(r["text"])) for r in part]
        wanted = spark.createDataFrame([(t,) for t in set().union(*counters)], "term binary")
        df = {bytes(r["term"]): r["df"] for r in index.filter("term IS NOT NULL").join(wanted, "term", "left_semi")
              .groupBy("term").agg(F.sum("df").alias("df")).collect()}  # at most the block's terms
        queries = Queries(counters, df, total["docs"], total["terms"])
        probed = cut(best_bounds(index, queries, probes))
        best = exact_scores(docs, probed, queries, probed.count() <= BROADCAST_ROWS)
        thresholds = {r["query"]: r["score"] for r in ranked(best, top).filter(F.col("rank") == top).collect()}
        rest = cut(not_excluded(index, queries, thresholds, top))
        found = ranked(exact_scores(docs, rest, queries, rest.count() <= BROADCAST_ROWS), top)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(part)],
                                      f"query int, item_id {shape.simpleString()}")
        out = out.union(cut(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")))
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH term AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM term GROUP BY 1, 2),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
asked AS (
  SELECT item_id, t, count(*) AS q
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY 1, 2),
weight AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, total WHERE t IN (SELECT t FROM asked) GROUP BY t, docs),
norm AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM size, total),
score AS (
  SELECT a.item_id, tf.doc_id, sum(a.q * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * norm.m)))::BIGINT AS score
  FROM asked a JOIN weight w ON a.t = w.t JOIN tf ON tf.t = a.t JOIN norm ON norm.doc_id = tf.doc_id GROUP BY 1, 2),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 20
"""
