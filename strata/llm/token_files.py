"""Token-id files of patched frame-of-reference blocks (operator 3).

Documents are range-partitioned and sorted by doc_id; every task encodes its documents and writes one file of
blocks, so files in name order hold all ids in ascending doc_id order.

A block holds up to ``BLOCK`` ids: the block's minimum is subtracted, differences are packed at the width that the
``PERCENTILE`` of them fits, and the outliers beyond that width go to an exception list (position, value).

    file      magic, blocks, index, trailer
    block     u32 count, u32 minimum, u8 width, u32 exceptions, packed bits, u16 positions, u32 values
    index     u64 start of each block; then for each document i64 doc_id, u8 has doc_id, u64 first token, u64 tokens
    trailer   u64 blocks, u64 documents, u64 tokens, u64 start of the index, magic

Any token range is read by seeking to its blocks.  Files are written under another name and renamed when whole,
so a task that is run again replaces its own file with an equal one.  They lie in the shared folder (or one the
caller names), opened through Arrow's file systems.

Words between ASCII white space are encoded once per worker and reused: the tokenizer drops white space and no
rule of it looks across.  Only per-file totals are summed to find where each file begins.

Defined results: null and empty texts have the end id alone; null doc_ids come first; documents that share a
doc_id are ordered by their text's hash; an empty table has no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.llm.common import json_tokenizer, map_columns, row_key, shared_dir, table, vocabulary

MAGIC = b"PFORIDS1"
BLOCK = 1024
PERCENTILE = 90
END_ID = 2
#: Blocks encoded or decoded at once, and words kept in a worker's cache (they bound memory, not results).
BLOCKS_AT_ONCE = 256
CACHE_WORDS = 1_000_000
_WORDS: dict[str, tuple[dict, dict]] = {}  # words and pieces of this worker process, by vocabulary
_HEAD = struct.Struct("<IIBI")
_TRAILER = struct.Struct("<QQQQ8s")
_DOCUMENT = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("first", "<u8"), ("tokens", "<u8")])


# ---- blocks -----------------------------------------------------------------------------------------------------

def pack(values: np.ndarray, width: int) -> bytes:
    """Each value's lowest ``width`` bits, least significant first."""
    if not width:
        return b""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, width: int, count: int) -> np.ndarray:
    if not width:
        return np.zeros(count, np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    whole = np.zeros((count, 32), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()


def write_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    at = (len(rest) - 1) * PERCENTILE // 100
    width = int(np.partition(rest, at)[at]).bit_length()
    out = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    values = rest[out]
    return b"".join([_HEAD.pack(len(ids), low, width, len(out)), pack(rest, width),
                     out.astype("<u2").tobytes(), values.astype("<u4").tobytes()])


def read_block(raw: bytes) -> np.ndarray:
    count, low, width, exceptions = _HEAD.unpack_from(raw)
    at = _HEAD.size
    size = (count * width + 7) // 8
    ids = unpack(raw[at: at + size], width, count)
    at += size
    where = np.frombuffer(raw, "<u2", exceptions, at)
    ids[where] = np.frombuffer(raw, "<u4", exceptions, at + 2 * exceptions)
    return ids + np.uint32(low)


class TokenWriter:
    """Streams ids into a file; holds at most ``BLOCKS_AT_ONCE`` blocks and the index."""

    def __init__(self, sink) -> None:
        self.sink, self.at, self.pending, self.waiting = sink, len(MAGIC), [], 0
        self.starts, self.documents, self.tokens = [], [], 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id or 0, doc_id is not None, self.tokens, len(ids)))
        self.tokens += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK * BLOCKS_AT_ONCE:
            self._flush(self.waiting // BLOCK * BLOCK)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint32)
        for i in range(0, upto, BLOCK):
            raw = write_block(ids[i: min(i + BLOCK, upto)])
            self.sink.write(raw)
            self.starts.append(self.at)
            self.at += len(raw)
        self.pending, self.waiting = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        self._flush(self.waiting)
        self.sink.write(np.array(self.starts, "<u8").tobytes())
        self.sink.write(np.array(self.documents, _DOCUMENT).tobytes())
        self.sink.write(_TRAILER.pack(len(self.starts), len(self.documents), self.tokens, self.at, MAGIC))


class TokenFile:
    """Reads a file's documents, or any range of its tokens."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        source.seek(size - _TRAILER.size)
        blocks, documents, self.n_tokens, index, magic = _TRAILER.unpack(source.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(index)
        self.starts = np.r_[np.frombuffer(source.read(8 * blocks), "<u8").astype(np.int64), index]
        self.documents = np.frombuffer(source.read(_DOCUMENT.itemsize * documents), _DOCUMENT)

    def tokens(self, first: int, stop: int) -> np.ndarray:
        """Ids ``first`` to ``stop`` - 1, from the blocks that hold them."""
        if stop <= first:
            return np.empty(0, np.uint32)
        a, b = first // BLOCK, (stop - 1) // BLOCK + 1
        self.source.seek(int(self.starts[a]))
        raw = self.source.read(int(self.starts[b] - self.starts[a]))
        base = self.starts[a]
        ids = np.concatenate([read_block(raw[self.starts[i] - base: self.starts[i + 1] - base]) for i in range(a, b)])
        return ids[first - a * BLOCK: stop - a * BLOCK]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first token, ids) of every document, decoding each block once."""
        held, begin = np.empty(0, np.uint32), 0
        for doc_id, known, first, count in self.documents.tolist():
            stop = first + count
            if stop > begin + len(held):
                upto = min(self.n_tokens, (max(stop, begin + len(held) + BLOCK * BLOCKS_AT_ONCE) - 1) // BLOCK * BLOCK
                           + BLOCK)
                held = np.concatenate([held[first - begin:], self.tokens(begin + len(held), upto)])
                begin = first
            yield doc_id if known else None, first, held[first - begin: stop - begin]


# ---- documents --------------------------------------------------------------------------------------------------

#: A word of Latin letters and closing marks, in characters that normalisation leaves alone: the tokenizer splits it
#: into these two pieces.  Other words, with digits, apostrophes or other scripts, go through it whole; so does the
#: dotted capital I, which lower-cases to two characters.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u02af]+)([.,;:!?*$%&#]*)")


def _byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of a text from its words, each encoded once; pieces of plain words are shared between words."""

    def __init__(self, path: str) -> None:
        self.tokenizer, (self.known, self.pieces) = json_tokenizer(path), _WORDS.setdefault(path, ({}, {}))
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    @staticmethod
    def words(text: str | None) -> list[bytes]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        # the tokenizer lower-cases all but its special tokens (<|...|>); fewer words to know
        return (raw if b"<|" in raw else raw.lower()).split()

    def piece(self, piece: str) -> bytes:
        """Ids of one piece that the tokenizer's normaliser and splitter would hand to its model."""
        ids = self.pieces.get(piece)
        if ids is None:
            spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = [t.id for t in self.model.tokenize(spelled)]
            ids = self.pieces[piece] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def learn(self, new: Iterable[bytes]) -> None:
        whole, plain, pieces = [], PLAIN.fullmatch, self.pieces
        for w in new:
            m = plain(w.decode("utf-8", "replace"))
            if m is None:
                whole.append(w)
            else:
                # letter by letter, as the tokenizer does: no letter of a plain word looks at its neighbours
                stem, marks = m.groups()
                stem = stem.lower()
                ids = pieces.get(stem) or self.piece(stem)
                self.known[w] = ids + (pieces.get(marks) or self.piece(marks)) if marks else ids
        for w, e in zip(whole, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in whole],
                                                                add_special_tokens=False)):
            self.known[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        tokens = [self.words(t) for t in texts]
        wanted = set().union(*tokens)
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            self.pieces.clear()
            new = wanted
        self.learn(new)
        end = struct.pack("<I", END_ID)
        return [np.frombuffer(b"".join([*map(self.known.__getitem__, ws), end]), "<u4") for ws in tokens]


def write_token_files(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Writes the files; returns shard, file, n_docs, n_tokens (a row per file), from a table beside the files."""
    spark = docs.sparkSession
    path = vocabulary("word_bpe_49k.json", path)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # null and repeated doc_ids are dealt by their texts' hashes
    order = [F.col("doc_id").asc_nulls_first(), row_key().asc()]
    dealt = docs.select("doc_id", "text").repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def run(slices: Iterator[list]) -> Iterator[list]:
        encoder = writer = None
        for doc_ids, texts in slices:
            if writer is None:
                context = TaskContext.get()
                shard = context.partitionId()
                files, base = pyarrow.fs.FileSystem.from_uri(folder)
                files.create_dir(base, recursive=True)
                name = f"{base}/part-{shard:07d}.pfor"
                part = f"{base}/.part-{shard:07d}-{context.taskAttemptId()}"
                sink = files.open_output_stream(part)
                writer, encoder = TokenWriter(sink), WordEncoder(path)
            for doc_id, ids in zip(doc_ids, encoder.ids(texts)):
                writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            sink.close()
            if files.get_file_info(name).type != pyarrow.fs.FileType.NotFound:
                files.delete_file(name)
            files.move(part, name)
            yield [[shard], [f"{folder}/part-{shard:07d}.pfor"], [len(writer.documents)], [writer.tokens]]

    written = map_columns(dealt, ["doc_id", "text"], "shard long, file string, n_docs long, n_tokens long", run)
    written.write.parquet(f"{folder}/files")
    return spark.read.parquet(f"{folder}/files")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (over all files), n_tokens, ids_crc32 of every document, read from the files."""
    before = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    # a row per file, dealt one to a task
    placed = (files.select("file", F.coalesce(before, F.lit(0)).alias("offset"))
              .repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(slices: Iterator[list]) -> Iterator[list]:
        for names, offsets in slices:
            for name, offset in zip(names, offsets):
                system, at = pyarrow.fs.FileSystem.from_uri(name)
                out = []
                with system.open_input_file(at) as source:
                    for doc_id, first, ids in TokenFile(source, source.size()):
                        out.append((doc_id, offset + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(out) == 10_000:
                            yield list(zip(*out))
                            out = []
                if out:
                    yield list(zip(*out))

    return map_columns(placed, ["file", "offset"], "doc_id long, start long, n_tokens long, ids_crc32 long", run)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder))
