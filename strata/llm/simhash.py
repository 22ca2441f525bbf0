"""SimHash near-duplicates through a Gray-order hierarchical index (operator 5).

A text's 64-bit fingerprint is the bitwise majority of the XXH64 values of its 3-word shingles.  Two fingerprints
link when at most two bits differ; components of links are the groups of near-duplicates.

Search.  Fingerprints first become distinct, so copies cost one entry however many there are.  Two differing bits
leave one of three bit blocks untouched, and within the other bits again one of three, so every link has both
ends under at least one of nine (block, sub-block) keys; each fingerprint goes to its nine buckets by a plain
shuffle, and a bucket that many share is cut into parts and searched part against part.  Inside a partition the
fingerprints of a bucket are sorted by Gray rank and a hierarchical index is built over them: each node factors the
bits that all fingerprints below share and its parent does not yet hold.  A query walks down from the root of its bucket, adds the differences on each node's own bits, and drops
the whole group once more than two have accumulated.  A link is emitted only under the first key its ends share,
hence once.  A fingerprint has at most 2,080 others within two bits, so links are at most linear in fingerprints.

Components are minimum labels over links with pointer jumping, in DataFrame joins over checkpointed tables.

Defined results: null and wordless texts have fingerprint zero and link like others; a text of one or two words
has its whole sequence as only shingle; repeated rows share their component; a null doc_id is never a
component's id unless all its documents' ids are null; extra columns are ignored (kept by the stage).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import cut, map_columns, row_key, table

SHINGLE = 3
MAX_DISTANCE = 2
SEED = 42
FANOUT = 8
#: Rows gathered before buckets are searched; queries looked up together, and the nodes they may visit in the worst
#: case (they bound memory, not results).
CHUNK = 1 << 14
QUERIES_AT_ONCE = 1 << 11
FRONTIER = 1 << 22
#: Fingerprints of a bucket that are searched together; larger buckets are cut into parts.
BUCKET = 1 << 16
#: Rows of a partition of the component tables, and the least number of partitions (files) they have.
ROWS_PER_PART = 200_000
LEAST_PARTS = 8

_BITS = ((np.arange(256, dtype=np.uint8)[:, None] >> np.arange(8, dtype=np.uint8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the shingles' hash bits as an unsigned integer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = [0, *ends[: len(tokens) - shingle].tolist()]
    stops = (ends[shingle - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(lanes[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row (hash of the text), fp (the 64 bits as a signed long)."""
    def run(slices: Iterator[list]) -> Iterator[list]:
        for doc_ids, rows, texts in slices:
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            yield [doc_ids, rows, fps.view(np.int64).tolist()]

    return map_columns(docs.select("doc_id", row_key().alias("row"), "text"), ["doc_id", "row", "text"],
                       "doc_id long, row long, fp long", run)


def key_masks(distance: int = MAX_DISTANCE) -> list[int]:
    """Bit masks such that two fingerprints within ``distance`` bits agree on all bits of at least one."""
    parts = distance + 1

    def blocks(bits: list[int]) -> list[list[int]]:
        return [bits[len(bits) * i // parts: len(bits) * (i + 1) // parts] for i in range(parts)]

    masks = []
    for block in blocks(list(range(64))):
        rest = [b for b in range(64) if b not in block]
        masks += [sum(1 << b for b in block + sub) for sub in blocks(rest)]
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def gray_rank(fp: Column) -> Column:
    """Position of a bit pattern in the Gray code's order."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp


class GrayIndex:
    """Hierarchical index over buckets of fingerprints in Gray order (rows sorted by bucket, then rank)."""

    def __init__(self, fps: np.ndarray, first: np.ndarray) -> None:
        """``first``: for each row the row at which its bucket begins."""
        self.fps = fps
        full = np.full(len(fps), ~np.uint64(0), np.uint64)
        bits, values, bucket = full, fps, first
        self.levels = []  # from the leaves up: own bits, values, first child, number of children
        children = None
        while True:
            self.levels.append([bits, values, children])
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            sizes = np.diff(np.r_[starts, len(bucket)])
            if (sizes == 1).all():
                break
            place = np.arange(len(bucket)) - np.repeat(starts, sizes)
            head = np.flatnonzero(place % FANOUT == 0)
            count = np.diff(np.r_[head, len(bucket)])
            all_and = np.bitwise_and.reduceat(values, head)
            all_or = np.bitwise_or.reduceat(values, head)
            shared = np.bitwise_and.reduceat(bits, head) & ~(all_and ^ all_or)
            # factor: what the parent holds is compared there, once for the whole group
            self.levels[-1][0] = bits & ~np.repeat(shared, count)
            bits, values, bucket, children = shared, all_and, bucket[head], (head, count)
        self.root = np.cumsum(np.r_[True, first[1:] != first[:-1]]) - 1

    def within(self, rows: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(query row, row found) for the queries ``rows``, each in its own bucket."""
        query, node, passed = rows, self.root[rows], np.zeros(len(rows), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            bits, values, children = self.levels[level]
            passed = passed + np.bitwise_count((self.fps[query] ^ values[node]) & bits[node])
            near = passed <= distance
            query, node, passed = query[near], node[near], passed[near]
            if children is not None:
                head, count = children[0][node], children[1][node]
                query, passed = np.repeat(query, count), np.repeat(passed, count)
                node = np.repeat(head, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        return query, node


def _links(k: np.ndarray, bucket: np.ndarray, fps: np.ndarray, masks: np.ndarray, distance: int,
           apart: np.ndarray | None = None) -> Iterator[list]:
    """``k``: rows' key number; ``bucket``: which rows are searched together; ``apart``: only rows of different parts of a
    bucket link, where they are not -1."""
    apart = np.full(len(k), -1) if apart is None else apart
    new = np.r_[True, bucket[1:] != bucket[:-1]]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(k)])
    shared = np.repeat(sizes > 1, sizes)
    if not shared.any():
        return
    k, apart, fps, sizes = k[shared], apart[shared], fps[shared], sizes[sizes > 1]
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    index = GrayIndex(fps, first)
    step = max(1, min(QUERIES_AT_ONCE, FRONTIER // int(sizes.max())))
    for at in range(0, len(fps), step):
        a, b = index.within(np.arange(at, min(at + step, len(fps))), distance)
        fits = (fps[a] < fps[b]) & ((apart[a] < 0) | (apart[a] != apart[b]))
        a, b = a[fits], b[fits]
        differ = fps[a] ^ fps[b]
        earliest = np.argmax((differ[:, None] & masks[None, :]) == 0, axis=1)
        a, b = a[earliest == k[a]], b[earliest == k[a]]
        if len(a):
            yield [fps[a].view(np.int64).tolist(), fps[b].view(np.int64).tolist()]


def _deal(keyed: DataFrame) -> DataFrame:
    """k, v, lo, hi, part, fp: rows of (k, v, lo, hi) are searched together.

    A bucket of over ``BUCKET`` fingerprints is cut into parts by their hash, and every two parts (and each part with
    itself) are searched on their own; ``part`` is a row's part where lo and hi differ, else -1.
    """
    zero = F.lit(0).cast("long")
    large = cut(keyed.groupBy("k", "v").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET))
    if large.isEmpty():
        return keyed.select("k", "v", zero.alias("lo"), zero.alias("hi"), F.lit(-1).cast("long").alias("part"), "fp")
    parts = F.coalesce(F.ceil(F.col("n") / (BUCKET / 2)), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), F.col("m"))
    spread = (keyed.join(large, ["k", "v"], "left").withColumn("m", parts).withColumn("own", own)
              .withColumn("other", F.explode(F.sequence(zero, F.col("m") - 1))))
    return spread.select("k", "v", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                         F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).cast("long").alias("part"), "fp")


def links(distinct: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """a, b: every pair of distinct fingerprints (column ``fp``) within ``distance`` bits, once."""
    masks = key_masks(distance)
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v"))
                     for i, m in enumerate(masks)])
    together = ["k", "v", "lo", "hi"]
    dealt = (_deal(distinct.select("fp", F.explode(keys).alias("key")).select("key.k", "key.v", "fp"))
             .repartition(*together).sortWithinPartitions(*together, gray_rank(F.col("fp"))))
    mask_array = np.array(masks, np.uint64)

    def run(slices: Iterator[list]) -> Iterator[list]:
        held = [np.empty(0, np.int64)] * 6

        def found(rows: list) -> Iterator[list]:
            k, v, lo, hi, part, fp = rows
            change = (k[1:] != k[:-1]) | (v[1:] != v[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            # rows of one part alone (lo = hi) link freely; of two parts only across
            yield from _links(k, np.cumsum(np.r_[0, change]), fp.view(np.uint64), mask_array, distance, part)

        for rows in slices:
            held = [np.concatenate([h, np.array(p, np.int64)]) for h, p in zip(held, rows)]
            if len(held[0]) < CHUNK:
                continue
            goes_on = np.logical_and.reduce([c == c[-1] for c in held[:4]])  # the last bucket may go on
            end = int(np.flatnonzero(~goes_on)[-1]) + 1 if not goes_on.all() else 0
            if end:
                yield from found([h[:end] for h in held])
                held = [h[end:] for h in held]
        if len(held[0]):
            yield from found(held)

    return map_columns(dealt, [*together, "part", "fp"], "a long, b long", run, rows=CHUNK)


def components(pairs: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable over ``pairs`` (a, b), for nodes that have a pair.

    Labels take their neighbours' minimum, then the label of their label, until none changes; a round more than
    doubles the reach, and each round's table is checkpointed, in as many partitions as its rows need.
    """
    both = cut(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))))
    parts = max(LEAST_PARTS, math.ceil(both.count() / ROWS_PER_PART))
    edges = both.coalesce(parts)
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")).coalesce(parts))
    while True:
        near = (edges.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        hooked = cut(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("hook")).coalesce(parts))
        target = hooked.select(F.col("node").alias("hook"), F.col("hook").alias("far"))
        moved = cut(hooked.join(target, "hook").select("node", F.col("far").alias("new"), "label").coalesce(parts))
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.filter("new < label").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, row, fp, component_id (smallest doc_id of the component), component_row (the smallest row hash under
    it); one row per row of ``docs``."""
    prints = cut(fingerprints(docs, shingle))
    document = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")  # null ids last
    distinct = cut(prints.groupBy("fp").agg(F.min(document).alias("least")))
    labels = components(links(distinct, distance))
    named = (distinct.join(labels, distinct["fp"] == labels["node"], "left")
             .select("fp", "least", F.coalesce("label", "fp").alias("label")))
    ids = cut(named.groupBy("label").agg(F.min("least").alias("first")))
    by_print = cut(named.select("fp", "label").join(ids, "label").select(
        "fp", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("component_row")))
    return prints.join(by_print, "fp")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id, columns as they came.

    Documents are told apart by doc_id and text; of several texts under the smallest doc_id one stays.  Rows equal in
    both are one document.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row") == F.col("component_row"))
    gone = (near_duplicates(docs).filter(~stays)
            .select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_doc"]) & (F.xxhash64(docs["text"]) == gone["_row"]),
                     "left_anti")
