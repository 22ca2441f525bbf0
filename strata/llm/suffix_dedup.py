"""Exact substring de-duplication by column-wise suffix ordering (operator 7).

A byte is removed if a ``LENGTH``-byte string that covers it also starts earlier in the collection.

Candidates.  In every ``LENGTH``-byte window the ``GRAM``-byte gram with the smallest hash (leftmost of equals) is its
anchor; equal windows have equal anchors at equal offsets.  Consecutive windows with one anchor make a context: the
bytes they cover.  Only anchors whose hash occurs twice in the corpus can hold a repeated window.  Contexts that
are equal byte by byte collapse into their first occurrence with map-side aggregation; each later one is removed
whole.

Ordering.  The different contexts that share an anchor are aligned at it, so equal windows start in the same
column.  The collection's transform is then built column by column from the right: each round inserts one symbol
of every context in front of the suffixes ordered so far (a stable counting sort by the new symbol) and updates
the common prefixes of neighbours (one more than the least on the way between their old places, else zero).  Runs
of neighbours with ``LENGTH`` symbols in common are the equal windows of that column; all but the earliest are
removed.  Blocks of contexts are read one after the other from Spark's sorted partition files; a round needs
memory for one symbol, place and prefix per context.

Scale.  Contexts under one anchor are dealt over as many chunks as ``CHUNK`` contexts fit, so an anchor in a third
of all documents is no single task: within a chunk all but the first of equal windows fall, and the chunks'
firsts meet in an aggregation on the window's 128-bit digest.  Phases end in written tables in the shared folder,
which survive lost executors and free the shuffle files before.

Defined results: null and empty texts have no bytes; texts under ``LENGTH`` bytes lose nothing; null doc_ids come
first; rows that share doc_id and text are one document and lose the same bytes; documents that share a doc_id
but not the text are ordered by the text's hash; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import land, map_columns, row_key, shared_dir, table

LENGTH = 100
GRAM = 40
#: Windows' grams; contexts of one anchor in a chunk; contexts ordered at once (they bound memory, not results).
GRAMS = LENGTH - GRAM + 1
CHUNK = 4096
BLOCK = 8192
#: Bytes of a text whose anchors are found at once; also the room for positions in a packed hash.
STRETCH = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 20) - 1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every gram, place of every window's anchor) of at most STRETCH + LENGTH bytes."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    powers = {}
    size = 1
    while size * 2 <= GRAM:
        h = h[:-size] * _power(size) + h[size:]
        size *= 2
        powers[size] = h
    n = len(codes) - GRAM + 1
    grams, at = None, 0
    for size in sorted(powers, reverse=True):
        while GRAM - at >= size:
            part = powers[size][at: at + n]
            grams = part if grams is None else grams * _power(size) + part
            at += size
    grams = grams ^ (grams >> np.uint64(31))
    grams *= np.uint64(0x94D049BB133111EB)
    grams ^= grams >> np.uint64(29)
    least = (grams & ~_PLACE) | np.arange(n, dtype=np.uint64)
    size = 1
    while size * 2 <= GRAMS:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if GRAMS > size:
        least = np.minimum(least[: size - GRAMS], least[GRAMS - size:])
    return grams, (least & _PLACE).astype(np.int64)


def contexts(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor, first window, number of windows) of each run of windows with one anchor."""
    codes = np.frombuffer(raw, np.uint8)
    windows = len(codes) - LENGTH + 1
    parts = []
    for at in range(0, windows, STRETCH):
        stop = min(at + STRETCH, windows)
        grams, place = _anchors(codes[at: stop + LENGTH - 1])
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        parts.append((grams[place[first]].view(np.int64), place[first] + at, first + at,
                      np.diff(np.r_[first, len(place)])))
    if not parts:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts))


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


# ---- column-wise ordering -----------------------------------------------------------------------------------------

def repeated_windows(texts: list[bytes], offsets: np.ndarray, prior: np.ndarray) -> Iterator[tuple]:
    """Per column (members, starts of runs): contexts whose windows at the column are equal, run after run.

    ``offsets``: where each context's anchor stands in it; ``prior``: the contexts' order in the collection.
    Yields (column, members, run starts, index of each run's earliest member), runs of one included.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    width = int(offsets.max())
    begin = width - offsets  # column of a context's first symbol
    end = begin + sizes
    columns = int(end.max())
    symbols = np.zeros((columns, len(texts)), np.uint8)
    for i, t in enumerate(texts):
        # no byte of UTF-8 is 255: zero is left for what lies before a context
        symbols[begin[i]: end[i], i] = np.frombuffer(t, np.uint8) + np.uint8(1)
    entering = np.argsort(end, kind="stable")
    entry = end[entering]
    order, common = np.empty(0, np.int64), np.empty(0, np.uint8)
    for column in range(columns - 1, -1, -1):
        a, b = np.searchsorted(entry, [column + 1, column + 2])
        if b > a:  # the empty suffixes of contexts that end here come first
            order = np.concatenate([entering[a:b], order])
            common = np.concatenate([np.zeros(b - a, np.uint8), common])
        symbol = symbols[column, order]
        moved = np.argsort(symbol, kind="stable")
        lo, hi = moved[:-1] + 1, moved[1:] + 1  # neighbours now; common prefixes between their old places
        same = np.flatnonzero(symbol[moved[1:]] == symbol[moved[:-1]])
        least = _range_min(common, lo[same], hi[same])
        common = np.zeros(len(order), np.uint8)
        common[same + 1] = np.minimum(least, 254) + 1
        order = order[moved]
        live = np.flatnonzero((begin[order] <= column) & (end[order] >= column + LENGTH))
        if not len(live):
            continue
        # members of a run are neighbours; others (shorter or begun later) never stand inside one
        starts = np.flatnonzero(np.r_[True, (common[live[1:]] < LENGTH) | (live[1:] != live[:-1] + 1)])
        members = order[live]
        earliest = np.minimum.reduceat(prior[members], starts)
        yield column - width, members, starts, earliest


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) for each pair, by a table of minima over powers of two."""
    span = hi - lo
    out = np.empty(len(lo), np.uint8)
    level, table_ = 1, values
    while len(span):
        here = (span >= level) & (span < 2 * level)
        if here.any():
            out[here] = np.minimum(table_[lo[here]], table_[hi[here] - level])
        if 2 * level > len(values):
            break
        table_ = np.minimum(table_[:-level], table_[level:])
        level *= 2
    return out


# ---- phases -------------------------------------------------------------------------------------------------------

def repeated_anchors(docs: DataFrame) -> DataFrame:
    """hash: of anchors that occur twice or more."""
    def run(slices: Iterator[list]) -> Iterator[list]:
        for (texts,) in slices:
            yield [np.concatenate([contexts(_raw(t))[0] for t in texts])]

    return (map_columns(docs, ["text"], "hash long", run).groupBy("hash").agg(F.count("*").alias("n"))
            .filter("n > 1").select("hash"))


def shared_contexts(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """hash, digest, doc_id, key, start, windows, offset: contexts of repeated anchors."""
    def of_documents(slices: Iterator[list]) -> Iterator[list]:
        for doc_ids, keys, texts in slices:
            hashes = [np.unique(contexts(_raw(t))[0]) for t in texts]
            at = pa.array(np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]))
            yield [pa.array(doc_ids, pa.int64()).take(at), pa.array(keys, pa.int64()).take(at), np.concatenate(hashes)]

    keyed = docs.select("doc_id", "text", row_key().alias("key"))
    ours = map_columns(keyed, ["doc_id", "key", "text"], "doc_id long, key long, hash long", of_documents)
    # by document, not doc_id: rows without a doc_id do not meet
    wanted = (ours.join(anchors, "hash", "left_semi").groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"))
              .agg(F.collect_set("hash").alias("hashes")))
    held = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")))

    def run(slices: Iterator[list]) -> Iterator[list]:
        for doc_ids, keys, texts, hashes in slices:
            out = [[] for _ in range(5)]
            at = []
            for i, (text, wanted_) in enumerate(zip(texts, hashes)):
                raw = _raw(text)
                found, place, first, windows = contexts(raw)
                keep = np.flatnonzero(np.isin(found, np.array(wanted_, np.int64)))
                at.append(np.full(len(keep), i))
                offset = (place - first)[keep]
                digests = np.fromiter((xxhash.xxh64_intdigest(raw[a: a + w + LENGTH - 1], o) for a, w, o in zip(
                    first[keep].tolist(), windows[keep].tolist(), offset.tolist())), np.uint64, len(keep))
                for column, x in zip(out, (found[keep], digests.view(np.int64), first[keep], windows[keep], offset)):
                    column.append(x)
            at = pa.array(np.concatenate(at))
            hash_, digest, first, windows, offset = (np.concatenate(c) for c in out)
            yield [hash_, digest, pa.array(doc_ids, pa.int64()).take(at), pa.array(keys, pa.int64()).take(at), first,
                   windows.astype(np.int16), offset.astype(np.int16)]

    return map_columns(held, ["doc_id", "key", "text", "hashes"], "hash long, digest long, doc_id long, key long, "
                       "start long, windows short, offset short", run)


def _texts_of(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """hash, chunk, chunks, doc_id, key, start, offset, body: the bytes of contexts."""
    wanted = (firsts.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"))
              .agg(F.collect_list(F.struct("hash", "chunk", "chunks", "start", "windows", "offset")).alias("parts")))
    held = docs.select("doc_id", "text", row_key().alias("key")).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")))

    def run(slices: Iterator[list]) -> Iterator[list]:
        for doc_ids, keys, texts, parts in slices:
            out = []
            for doc_id, key, text, parts_ in zip(doc_ids, keys, texts, parts):
                raw = _raw(text)
                for p in parts_:
                    out.append((p["hash"], p["chunk"], p["chunks"], doc_id, key, p["start"], p["offset"],
                                raw[p["start"]: p["start"] + p["windows"] + LENGTH - 1]))
            yield list(zip(*out))

    return map_columns(held, ["doc_id", "key", "text", "parts"], "hash long, chunk int, chunks int, doc_id long, "
                       "key long, start long, offset short, body binary", run)


def ordered_windows(bodies: DataFrame) -> DataFrame:
    """doc_id, key, start, stop, w1, w2: windows found equal to an earlier one (w1 null), and, of anchors in several
    chunks, the first of each chunk's equal windows with its digest."""
    dealt = bodies.repartition("hash", "chunk").sortWithinPartitions("hash", "chunk")

    def search(rows: list) -> list:
        hashes, chunks_, chunks, doc_ids, keys, starts, offsets, bodies_ = rows
        starts, offsets = np.array(starts, np.int64), np.array(offsets, np.int64)
        order = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is not None, doc_ids[i] or 0, keys[i], starts[i]))
        prior = np.empty(len(order), np.int64)
        prior[order] = np.arange(len(order))
        # places of equal windows of one document follow the anchors'
        several = np.array(chunks) > 1
        gone, spans, firsts = [], [], []
        for column, members, runs, earliest in repeated_windows(bodies_, offsets, prior):
            sizes = np.diff(np.r_[runs, len(members)])
            first = prior[members] == np.repeat(earliest, sizes)
            gone.append(members[~first])
            spans.append(np.full((~first).sum(), column))
            for i in members[first & several[members]].tolist():
                at = int(offsets[i]) + column
                firsts.append((i, column, hashlib.blake2b(bodies_[i][at: at + LENGTH], digest_size=16).digest()))
        gone, spans = np.concatenate(gone or [[]]).astype(np.int64), np.concatenate(spans or [[]]).astype(np.int64)
        begin = starts[gone] + offsets[gone] + spans
        # neighbouring windows of one context make one span
        by = np.lexsort((begin, gone))
        gone, begin = gone[by], begin[by]
        head = np.flatnonzero(np.r_[True, (gone[1:] != gone[:-1]) | (begin[1:] > begin[:-1] + LENGTH)]) \
            if len(gone) else np.empty(0, np.int64)
        tail = np.r_[head[1:], len(gone)] - 1 if len(head) else head
        who = [*gone[head].tolist(), *(f[0] for f in firsts)]
        a = [*begin[head].tolist(), *(int(starts[i] + offsets[i]) + c for i, c, _ in firsts)]
        b = [*(begin[tail] + LENGTH).tolist(), *(int(starts[i] + offsets[i]) + c + LENGTH for i, c, _ in firsts)]
        digest = [(None, None)] * len(head) + [(int.from_bytes(d[:8], "little", signed=True),
                                                 int.from_bytes(d[8:], "little", signed=True)) for _, _, d in firsts]
        return [[doc_ids[i] for i in who], [keys[i] for i in who], a, b, [d[0] for d in digest], [d[1] for d in digest]]

    def run(slices: Iterator[list]) -> Iterator[list]:
        held: list[list] = [[] for _ in range(8)]
        for part in slices:
            held = [h + p for h, p in zip(held, part)]
            if len(held[0]) < BLOCK:
                continue
            last = (held[0][-1], held[1][-1])  # its chunk may go on
            cut = len(held[0])
            while cut and (held[0][cut - 1], held[1][cut - 1]) == last:
                cut -= 1
            if cut:
                yield search([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if held[0]:
            yield search(held)

    return map_columns(dealt, ["hash", "chunk", "chunks", "doc_id", "key", "start", "offset", "body"],
                       "doc_id long, key long, start long, stop long, w1 long, w2 long", run, rows=BLOCK)


def removed_spans(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, key, spans (array of start, stop; may overlap): what is removed of each document that loses bytes."""
    anchors = land(repeated_anchors(docs), f"{folder}/anchors")
    shared = land(shared_contexts(docs, anchors), f"{folder}/contexts")
    place = F.struct("doc_id", "key", "start")
    first = land(shared.groupBy("hash", "digest").agg(
        F.min(F.struct("doc_id", "key", "start", "windows", "offset")).alias("first"), F.count("*").alias("copies"))
        .select("hash", "digest", "copies", "first.*"), f"{folder}/first")
    # copies of a whole context after its first
    known = first.filter("copies > 1").select("hash", "digest", F.struct("doc_id", "key", "start").alias("first"))
    copies = (shared.join(known, ["hash", "digest"]).filter(~place.eqNullSafe(F.col("first")))
              .select("doc_id", "key", "start", (F.col("start") + F.col("windows") + (LENGTH - 1)).alias("stop")))
    # different contexts under one anchor
    several = land(first.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
                   .select("hash", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), f"{folder}/several")
    dealt = first.join(several, "hash").withColumn(
        "chunk", F.pmod(F.xxhash64("digest"), F.col("chunks").cast("long")).cast("int"))
    found = land(ordered_windows(_texts_of(docs, dealt)), f"{folder}/windows")
    heads = found.filter("w1 IS NOT NULL")
    least = land(heads.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                 .filter("n > 1").select("w1", "w2", "first"), f"{folder}/heads")
    across = heads.join(least, ["w1", "w2"]).filter(~place.eqNullSafe(F.col("first")))
    spans = copies.union(found.filter("w1 IS NULL").select(copies.columns)).union(across.select(copies.columns))
    return spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merge(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that overlap or touch."""
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(stops[by])
    head = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[head], reach[np.r_[head[1:], len(starts)] - 1]


def suffix_dedup(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs), kept (the remaining bytes); one row per row of ``docs``."""
    spans = land(removed_spans(docs, folder), f"{folder}/spans").withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    joined = docs.select("doc_id", "text", row_key().alias("key")).join(
        spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("key").eqNullSafe(F.col("_key")), "left")

    def run(slices: Iterator[list]) -> Iterator[list]:
        for doc_ids, texts, spans_ in slices:
            out = []
            for doc_id, text, parts in zip(doc_ids, texts, spans_):
                raw = _raw(text)
                runs, kept = [], raw
                if parts:
                    a, b = merge(np.array([p["start"] for p in parts]), np.array([p["stop"] for p in parts]))
                    runs = [{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist())]
                    kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))
                out.append((doc_id, len(raw), runs, kept))
            yield list(zip(*out))

    return map_columns(joined, ["doc_id", "text", "spans"], "doc_id long, n_bytes long, "
                       "spans array<struct<start:long,stop:long>>, kept binary", run)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/suffix-{uuid.uuid4().hex}"
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
