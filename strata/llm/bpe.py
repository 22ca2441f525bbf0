"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 8).

A text is encoded by halves: leaves are encoded on their own, and two neighbours are joined by encoding the
boundary anew.  The window around the boundary grows, on either side, until it reaches a place where a
non-space character is followed by white space.  No match of the split pattern runs across such a place, and none
that ends there looks beyond it, so the tokens outside the window cannot depend on what is inside; they stay, and
the window's tokens replace the rest.  If a side has no such place, the whole side is the window.  The join is
associative, so any tree gives the tokens of the whole text.  Decoding concatenates the tokens' bytes up a tree.

The job is a narrow map over rows; ids travel as little-endian unsigned 32-bit binary.

Defined results: null and empty texts have no tokens; texts of any length are encoded whole; repeated rows are
encoded alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import map_columns, ranks_encoding, table, vocabulary

#: Characters (encoding) and ids (decoding) of a leaf; the first radius searched for a stable place.
LEAF = 1 << 13
RADIUS = 64
STABLE = re.compile(r"\S[ \t\r\n]")


def stable_before(text: str, lo: int, cut: int) -> int:
    """The last stable place in (lo, cut), found in a growing window; ``lo`` if there is none."""
    radius = RADIUS
    while True:
        start = max(lo, cut - radius)
        place = None
        for m in STABLE.finditer(text, start, cut):
            place = m.start() + 1
        if place is not None:
            return place
        if start == lo:
            return lo
        radius *= 2


def stable_after(text: str, cut: int, hi: int) -> int:
    """The first stable place in (cut, hi), found in a growing window; ``hi`` if there is none."""
    radius = RADIUS
    while True:
        stop = min(hi, cut + radius)
        m = STABLE.search(text, cut, stop)
        if m:
            return m.start() + 1
        if stop == hi:
            return hi
        radius *= 2


def encode(encoding, text: str, lo: int = 0, hi: int | None = None, leaf: int = LEAF) -> list[int]:
    """Token ids of ``text[lo:hi]``."""
    hi = len(text) if hi is None else hi
    if hi - lo <= leaf:
        return encoding.encode_ordinary(text[lo:hi])
    mid = (lo + hi) // 2
    left, right = encode(encoding, text, lo, mid, leaf), encode(encoding, text, mid, hi, leaf)
    start, stop = stable_before(text, lo, mid), stable_after(text, mid, hi)
    stale_left = len(encoding.encode_ordinary(text[start:mid]))
    stale_right = len(encoding.encode_ordinary(text[mid:stop]))
    return left[: len(left) - stale_left] + encoding.encode_ordinary(text[start:stop]) + right[stale_right:]


def decode(encoding, ids: list[int], leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return encoding.decode_bytes(ids)
    mid = len(ids) // 2
    return decode(encoding, ids[:mid], leaf) + decode(encoding, ids[mid:], leaf)


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers)."""
    path = vocabulary("byte_bpe_multi_50k.tiktoken", path)

    def run(slices: Iterator[list]) -> Iterator[list]:
        encoding = ranks_encoding(path)
        for doc_ids, texts in slices:
            yield [doc_ids, [np.array(encode(encoding, t or ""), "<u4").tobytes() for t in texts]]

    return map_columns(docs, ["doc_id", "text"], "doc_id long, ids binary", run)


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded (the bytes of the text)."""
    path = vocabulary("byte_bpe_multi_50k.tiktoken", path)

    def run(slices: Iterator[list]) -> Iterator[list]:
        encoding = ranks_encoding(path)
        for doc_ids, ids in slices:
            yield [doc_ids, ids, [decode(encoding, np.frombuffer(x, "<u4").tolist()) for x in ids]]

    return map_columns(encoded, ["doc_id", "ids"], "doc_id long, ids binary, decoded binary", run)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_decode(bpe_encode(table(spark, sf_dir, "documents"))).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def stage_byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the bytes they decode to."""
    return bpe_decode(bpe_encode(docs)).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"))
