"""Packing of token sequences by non-negative least squares (operator 13).

A document's ids are cut into whole windows of ``WINDOW`` ids and one remainder.  What remains to be packed is a
histogram of remainder lengths, whatever the number of documents.

Plan (on the driver, from at most ``WINDOW`` counts).  All combinations of up to three lengths that fill a window
are enumerated; their repeat counts are the non-negative least-squares solution against the histogram
(an active-set method that takes in blocks of combinations and leaves a vertex, so few combinations are
used), rounded and limited to the pieces there are.  The pieces left over are packed greedily, the longest that
fits first; where none fits, one is cut to fill the window.  The last, unfilled sequence is cut into sequences of
power-of-two lengths, which take no padding.  The plan is a list of (length, range of ranks, part of the piece,
first sequence, offset); its size depends on the number of lengths, not of documents.

Job.  Each task encodes its documents, numbers the pieces of every length among its own, and the phase ends in a
table in the shared folder.  Counts per task and length give every task's first rank (an exclusive sum over tasks),
so a length that a third of all pieces have is numbered by all tasks.  Pieces look up their rank in the plan, and
the places meet the ids in one join.

Defined results: null and empty texts have the end id alone; every id lies in exactly one piece; repeated rows are
packed each on its own; rows are told apart by their place in the written table, so null and shared doc_ids are no
matter; an empty table has no pieces; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.llm.common import json_tokenizer, land, map_columns, ranks_encoding, shared_dir, sized, table, vocabulary

WINDOW = 1024
END_ID = 0
#: Pieces that a task hands on at once.
PIECES_AT_ONCE = 1024
#: Most rounds of the least-squares solution; what is not solved then is packed greedily.
ROUNDS = 12


# ---- plan ---------------------------------------------------------------------------------------------------------

def combinations(window: int) -> np.ndarray:
    """Every non-increasing triple of lengths that fills the window; zero stands for no piece."""
    rows = []
    for a in range(-(-window // 3), window + 1):
        b = np.arange(-(-(window - a) // 2), min(a, window - a) + 1)
        rows.append(np.stack([np.full(len(b), a), b, window - a - b], axis=1))
    return np.concatenate(rows)


def repeat_counts(histogram: np.ndarray, combos: np.ndarray, rounds: int = ROUNDS, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of combinations, their non-negative counts) of least squared difference from the histogram."""
    target = histogram.astype(float)
    target[0] = 0
    rest, used, x = target.copy(), np.empty(0, np.int64), np.empty(0)

    def products(of: np.ndarray) -> np.ndarray:
        """How many lengths each two combinations share (their columns' inner products)."""
        out = 1e-9 * np.eye(len(of))
        for one in combos[of].T:
            for other in combos[of].T:
                out += (one[:, None] == other) & (one > 0)[:, None]
        return out

    for _ in range(rounds):
        gain = rest[combos].sum(axis=1)
        gain[used] = 0
        limit = tolerance * max(1.0, target.max(initial=0))
        taken, block = np.zeros(len(target), bool), []
        for c in np.argsort(-gain)[: 4 * len(target)].tolist():
            if gain[c] <= limit:
                break
            own = combos[c][combos[c] > 0]
            if not taken[own].any():  # different lengths, so that a block's columns are independent
                taken[own] = True
                block.append(c)
        if not block:
            break
        best, fresh = block[0], set(block)
        used, x = np.r_[used, block], np.r_[x, np.zeros(len(block))]
        while True:
            z = np.linalg.solve(products(used), target[combos[used]].sum(axis=1))
            bad = z <= 1e-9
            if not bad.any():
                x = z
                break
            stuck = bad & (x == 0)
            if stuck.any():
                if fresh <= set(used[stuck].tolist()):  # a single new column always gains
                    stuck[used == best] = False
                    if not stuck.any():
                        break
                keep = ~stuck
            else:
                ratio = np.full(len(x), np.inf)
                ratio[bad] = x[bad] / (x[bad] - z[bad])
                step = ratio.min()
                x = x + step * (z - x)
                keep = ratio > step + 1e-12
            used, x = used[keep], np.maximum(x[keep], 0)
        rest = target.copy()
        np.subtract.at(rest, combos[used], x[:, None])
        rest[0] = 0
    return used, x


class Plan:
    """Places for pieces: rows (length, first rank, end rank, start in the piece, part's length, sequence, offset)."""

    def __init__(self, histogram: np.ndarray) -> None:
        self.counts = histogram.astype(np.int64).copy()
        self.pool = {n: [(n, 0, int(c), 0)] for n, c in enumerate(self.counts) if c}
        self.rows, self.sequences = [], 0

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        """(piece's length, first rank, pieces, start) of ``n`` parts of the length."""
        self.counts[length] -= n
        out, pool = [], self.pool[length]
        while n:
            origin, rank, count, start = pool.pop()
            k = min(n, count)
            out.append((origin, rank, k, start))
            if count > k:
                pool.append((origin, rank + k, count - k, start))
            n -= k
        return out

    def place(self, parts: list, length: int, offset: int, sequence: int) -> None:
        for origin, rank, k, start in parts:
            self.rows.append((origin, rank, rank + k, start, length, sequence, offset))
            sequence += k

    def repeat(self, lengths: list[int], n: int, cut: int = 0) -> None:
        """``n`` sequences of the lengths, one after the other; of the last piece only ``cut`` ids, if given."""
        offset = 0
        for at, length in enumerate(lengths):
            parts = self.take(length, n)
            own = cut if cut and at == len(lengths) - 1 else length
            self.place(parts, own, offset, self.sequences)
            if own < length:
                self.counts[length - own] += n
                self.pool.setdefault(length - own, []).extend((o, r, k, s + own) for o, r, k, s in parts)
            offset += own
        self.sequences += n

    def fill_greedily(self, window: int) -> None:
        """Packs what is left, longest piece that fits first, cutting one where none fits."""
        while self.counts.any():
            left, gap, lengths = self.counts.copy(), window, []
            while gap and len(fits := np.flatnonzero(left[: gap + 1])):
                lengths.append(int(fits[-1]))
                left[lengths[-1]] -= 1
                gap -= lengths[-1]
            if not gap:
                self.repeat(lengths, self.times(lengths))
            elif left.any():
                longer = int(np.flatnonzero(left)[0])
                self.repeat([*lengths, longer], self.times([*lengths, longer]), cut=gap)
            else:
                self.split_last(lengths)

    def times(self, lengths: list[int]) -> int:
        return min(int(self.counts[n]) // k for n, k in Counter(lengths).items())

    def split_last(self, lengths: list[int]) -> None:
        """The last pieces in sequences of power-of-two lengths."""
        total = sum(lengths)
        room = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        offset = 0
        for length in lengths:
            [(origin, rank, _, start)] = self.take(length, 1)
            while length:
                own = min(length, room[0] - offset)
                self.rows.append((origin, rank, rank + 1, start, own, self.sequences, offset))
                start, length, offset = start + own, length - own, offset + own
                if offset == room[0]:
                    room.pop(0)
                    self.sequences, offset = self.sequences + 1, 0


def plan_packing(histogram: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> Plan:
    """``histogram``: pieces of each length 0..window (none of length 0)."""
    plan = Plan(histogram)
    if plan.counts[window]:
        plan.repeat([window], int(plan.counts[window]))
    if plan.counts.any():
        combos = combinations(window)
        used, x = repeat_counts(plan.counts, combos, rounds)
        for c in np.argsort(-x).tolist():
            lengths = [int(n) for n in combos[used[c]] if n]
            n = min(int(x[c] + 0.5), plan.times(lengths))
            if n:
                plan.repeat(lengths, n)
    plan.fill_greedily(window)
    return plan


class Places:
    """Looks up the places of a piece by its length and rank."""

    def __init__(self, rows: list[tuple]) -> None:
        by_part = defaultdict(list)
        for length, first, end, start, size, sequence, offset in rows:
            by_part[length, start].append((first, end, size, sequence, offset))
        self.parts = {k: sorted(v) for k, v in by_part.items()}
        self.firsts = {k: [x[0] for x in v] for k, v in self.parts.items()}

    def of(self, length: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, size, sequence, offset) of each part."""
        start = 0
        while start < length:
            first, _, size, sequence, offset = self.parts[length, start][bisect_right(self.firsts[length, start], rank) - 1]
            yield start, size, sequence + rank - first, offset
            start += size


# ---- ids ----------------------------------------------------------------------------------------------------------

#: Characters whose classes (letter, digit, white space) no Unicode version changes: Latin, and general punctuation.
PLAIN = re.compile("[\u0000-\u024f\u2010-\u2027\u2030-\u205e]*+")


class TextEncoder:
    """Ids of whole texts under a byte-level BPE file of the tokenizers library.

    ``ranks_path`` holds the same vocabulary as ranks; tiktoken gives the same ids several times faster (the tests
    compare them character by character).  Texts with special tokens, which the library takes as one id, and texts with other
    characters than ``PLAIN`` ones go through the library.
    """

    def __init__(self, path: str, ranks_path: str, end_id: int = END_ID) -> None:
        self.tokenizer, self.ranks = json_tokenizer(path), ranks_encoding(ranks_path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([end_id], self.type).tobytes()

    def ids(self, text: str | None) -> bytes:
        """The text's ids and the end id, packed little-endian."""
        text = text or ""
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            ids = self.ranks.encode_to_numpy(text, disallowed_special=())
        else:
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        return ids.astype(self.type).tobytes() + self.end


def encode_documents(docs: DataFrame, path: str, ranks_path: str, window: int) -> DataFrame:
    """part, row, doc_id, doc_tokens, ids, and the ranks of the remainder and the first whole window in the part."""
    def run(slices: Iterator[list]) -> Iterator[list]:
        encoder, part, row = TextEncoder(path, ranks_path), TaskContext.get().partitionId(), 0
        seen: Counter = Counter()
        for doc_ids, texts in slices:
            out = []
            for doc_id, raw in zip(doc_ids, map(encoder.ids, texts)):
                n = len(raw) // encoder.type.itemsize
                rest = n % window
                out.append((part, row, doc_id, n, raw, encoder.type.itemsize, rest, seen[rest], seen[window]))
                seen[rest] += rest > 0
                seen[window] += n // window
                row += 1
            yield list(zip(*out))

    return map_columns(sized(docs.select("doc_id", "text")), ["doc_id", "text"], "part int, row long, doc_id long, doc_tokens long, ids binary, "
                                                 "id_bytes int, rest int, rest_rank long, whole_rank long", run)


def pack(docs: DataFrame, path: str | None = None, ranks_path: str | None = None, window: int = WINDOW,
         rounds: int = ROUNDS) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit) of every piece."""
    spark = docs.sparkSession
    path = vocabulary("byte_bpe_50k.json", path)
    ranks_path = vocabulary("byte_bpe_50k.tiktoken", ranks_path)
    encoded = land(encode_documents(docs, path, ranks_path, window), f"{shared_dir(spark).rstrip('/')}/packing-{uuid.uuid4().hex}")
    pieces = encoded.select("part", "row", "doc_tokens", F.explode(F.array(
        F.struct(F.col("rest").alias("length"), F.lit(1).cast("long").alias("n"), F.col("rest_rank").alias("rank"),
                 (F.col("doc_tokens") - F.col("rest")).alias("at")),
        F.struct(F.lit(window).alias("length"), F.floor(F.col("doc_tokens") / window).alias("n"),
                 F.col("whole_rank").alias("rank"), F.lit(0).cast("long").alias("at")))).alias("p")).select(
        "part", "row", "p.*").filter("length > 0 AND n > 0")
    counts = pieces.groupBy("part", "length").agg(F.sum("n").alias("n"))
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row a length
        histogram[r["length"]] = r["n"]
    rows = plan_packing(histogram, window, rounds).rows
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"]).select("part", "row", "length", "at", "n",
                                                             (F.col("rank") + F.col("before")).alias("rank"))

    def look_up(slices: Iterator[list]) -> Iterator[list]:
        places = Places(rows)
        for parts, numbers, lengths, ats, ns, ranks in slices:
            yield [parts, numbers, [[dict(zip(("start", "length", "sequence_id", "offset"), (at + k * window + s, size, q, o)))
                                     for k in range(n) for s, size, q, o in places.of(length, rank + k)]
                                    for length, at, n, rank in zip(lengths, ats, ns, ranks)]]

    shape = "array<struct<start: long, length: long, sequence_id: long, offset: long>>"
    placed = (map_columns(ranked, ["part", "row", "length", "at", "n", "rank"],
                          f"part int, row long, places {shape}", look_up)
              .groupBy("part", "row").agg(F.flatten(F.collect_list("places")).alias("places")))
    met = encoded.select("part", "row", "doc_id", "doc_tokens", "ids", "id_bytes").join(placed, ["part", "row"])

    def slice_ids(slices: Iterator[list]) -> Iterator[list]:
        names = ("start", "length", "sequence_id", "offset")
        for doc_ids, tokens, raws, sizes, found in slices:
            out = []
            for doc_id, n, raw, size, at in zip(doc_ids, tokens, raws, sizes, found):
                ids = np.frombuffer(raw, f"<u{size}").astype("<u4")
                for p in at:
                    start, length, sequence, offset = (p[c] for c in names)
                    out.append((doc_id, start, length, n, sequence, offset, ids[start: start + length].tobytes()))
                    if len(out) == PIECES_AT_ONCE:  # pieces of many documents leave together, those of a long one in parts
                        yield list(zip(*out))
                        out = []
            if out:
                yield list(zip(*out))

    return map_columns(met, ["doc_id", "doc_tokens", "ids", "id_bytes", "places"],
                       "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
                       slice_ids, rows=64)


def sequences(pieces: DataFrame, pad_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """sequence_id, n_tokens, ids (array, padded to the window unless the length is a power of two), from pieces."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    gathered = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))

    def run(slices: Iterator[list]) -> Iterator[list]:
        for numbers, sizes, found in slices:
            out = []
            for n, each in zip(sizes, found):
                ids = np.frombuffer(b"".join(p["ids"] for p in each), "<u4").tolist()
                out.append(ids + [pad_id] * (window - n if n & (n - 1) else 0))
            yield [numbers, sizes, out]

    return map_columns(gathered, ["sequence_id", "n_tokens", "parts"], "sequence_id long, n_tokens long, ids array<int>", run)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
