"""Quality rules from tokeniser fertility (operator 6).

Public vocabularies measure a text: characters per token (under a multilingual byte-level BPE and under a
32k piece BPE with byte fallback), the share of tokens that are single-byte fallbacks, and the entropy of the
token distribution.  Text that a vocabulary was not made for (shouting, symbol noise, broken encodings) splits
into many short tokens; boilerplate repeats few tokens.  A document outside its band is rejected: that of its
language, or where ``lang`` names none with a band, of the script that most of its letters are of (in Latin script
without any ``lang``: of the language whose letters it has).

Both vocabularies split at white space, so words are encoded once per worker and reused; whole texts are
measured, whatever their length.  The job is a narrow map: no shuffle, no state between rows.

Defined results: a null or empty text has no words, fails the base rules and has null measures; repeated rows
are judged alike; an unknown or null language takes the band of the text's script; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strata.llm.common import map_columns, piece_model, ranks_encoding, ship, table, vocabulary

#: Words kept in a worker's cache before it starts afresh (bounds memory, not results).
CACHE_WORDS = 300_000
#: Rows measured at once in the pipeline's stage.
ROWS = 256
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"

#: Per language: least characters per token (byte-level, piece), most byte-fallback share, least token entropy (bits).
BANDS = {
    "en": (2.02, 1.75, 0.10, 4.5),
    "de": (2.07, 1.85, 0.10, 4.5),
    "fr": (1.89, 1.60, 0.10, 4.5),
    "es": (1.90, 1.60, 0.10, 4.5),
}
#: Most characters per token (either vocabulary) and most token entropy of any text: beyond them it repeats a few long
#: entries, or draws from the vocabulary at random.
MOST_PER_TOKEN, MOST_ENTROPY = 9.0, 13.0
#: Texts without a language: those in Latin letters take the band of the language whose own letters they have most of,
#: English if none.
OWN_LETTERS = {"de": "äöüßÄÖÜ", "fr": "çèêàâîôûëïœæÇÈÊÀÂ", "es": "ñáíóúÑÁÍÓÚ¿¡"}
#: Other languages, by the script that most of a text's letters are of; scripts with few vocabulary entries have short
#: tokens and many bytes.
SCRIPT_BANDS = {
    "latin": (1.30, 1.20, 0.15, 4.0),
    "cyrillic": (1.20, 1.20, 0.20, 4.5),
    "greek": (0.70, 0.70, 0.60, 4.0),
    "semitic": (0.55, 0.55, 0.60, 4.0),
    "indic": (0.30, 0.30, 0.90, 3.5),
    "han": (0.35, 0.35, 0.80, 4.5),
    "kana": (0.35, 0.35, 0.70, 4.5),
    "hangul": (0.30, 0.30, 0.80, 4.0),
}
#: Texts mostly in other letters, or without letters.
OTHER_BAND = (0.25, 0.25, 0.97, 3.0)
#: Letters of the scripts.
SCRIPTS = {
    "latin": re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff]"),
    "cyrillic": re.compile("[\u0400-\u052f]"),
    "greek": re.compile("[\u0370-\u03ff\u1f00-\u1fff]"),
    "semitic": re.compile("[\u0590-\u08ff\ufb1d-\ufdff\ufe70-\ufefc]"),
    "indic": re.compile("[\u0900-\u0eff]"),
    "han": re.compile("[\u3400-\u9fff\U00020000-\U0003ffff]"),
    "kana": re.compile("[\u3041-\u30ff]"),
    "hangul": re.compile("[\u1100-\u11ff\uac00-\ud7af]"),
}

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, chars_per_token double, chars_per_piece double, byte_share double, "
          "token_entropy double, reason string")


def base_counts(text: str) -> tuple[int, int, int, int, int, list[bytes]]:
    raw = text.encode("utf-8", "surrogatepass")
    tokens = raw.split()
    word_chars = len(text) - sum(map(text.count, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    dup_lines = len(lines) - len(set(lines))
    return len(tokens), word_chars, symbols, dup_lines, repeated_words(tokens), tokens


def repeated_words(tokens: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    windows = list(zip(tokens, tokens[1:], tokens[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


class Fertility:
    """Token measures of a text from its words, each encoded once."""

    def __init__(self, piece_path: str, ranks_path: str) -> None:
        self.pieces, self.ranks = piece_model(piece_path), ranks_encoding(ranks_path)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.known: dict[bytes, tuple[bytes, int]] = {}  # ids under the piece model, number of ids under the other

    def learn(self, texts_words: list[list[bytes]]) -> None:
        wanted = {w for ws in texts_words for w in ws}
        new = [w for w in wanted if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, list(wanted)
        strings = [w.decode("utf-8", "replace") for w in new]
        pieces = self.pieces.encode(strings, num_threads=1)
        spaced = self.ranks._core_bpe.encode_ordinary
        for w, s, ids in zip(new, strings, pieces):
            self.known[w] = (struct.pack(f"={len(ids)}i", *ids), len(spaced(" " + s)))

    def measure(self, tokens: list[bytes], word_chars: int) -> tuple[float, float, float, float]:
        each = [self.known[w] for w in tokens]
        ids = np.frombuffer(b"".join([x[0] for x in each]), np.int32)
        n_ranks = sum(x[1] for x in each)
        counts = np.bincount(ids)
        counts = counts[counts > 0]
        n = max(len(ids), 1)
        entropy = math.log2(n) - float((counts * np.log2(counts)).sum()) / n if len(ids) else 0.0
        return (word_chars / max(n_ranks, 1), word_chars / n, float(self.is_byte[ids].sum()) / n,
                entropy)


def script(text: str) -> str | None:
    """The script that most letters of a text are of (Japanese counts as kana where a tenth of it is); None without
    letters of a known script."""
    if text.isascii():
        counts = {"latin": len(text) - len(text.translate(_NO_LETTERS))}
    else:
        counts = {name: len(letters.findall(text)) for name, letters in SCRIPTS.items()}
        if 10 * counts["kana"] > counts["kana"] + counts["han"]:
            counts["kana"] += counts["han"]
    best = max(counts, key=counts.get)
    return best if counts[best] else None


_NO_LETTERS = {i: None for i in [*range(65, 91), *range(97, 123)]}


def band(lang: str | None, text: str, bands: dict = BANDS, scripts: dict = SCRIPT_BANDS) -> tuple:
    """The language's band, else that of the text's own script and letters."""
    if lang not in bands:
        written = script(text)
        if lang is not None or written != "latin":
            return scripts.get(written, OTHER_BAND)
        counts = {name: sum(map(text.count, letters)) for name, letters in OWN_LETTERS.items()}
        lang = max(counts, key=counts.get) if any(counts.values()) else "en"
        if lang not in bands:
            return scripts["latin"]
    return bands[lang]


def verdict(measures: tuple[float, float, float, float], within: tuple) -> str | None:
    """The measure that lies outside the band; None if the text passes."""
    per_token, per_piece, bytes_, entropy = measures
    least_token, least_piece, most_bytes, least_entropy = within
    if not least_token <= per_token <= MOST_PER_TOKEN:
        return "chars_per_token"
    if not least_piece <= per_piece <= MOST_PER_TOKEN:
        return "chars_per_piece"
    if bytes_ > most_bytes:
        return "byte_share"
    if not least_entropy <= entropy <= MOST_ENTROPY:
        return "token_entropy"
    return None


def quality_rules(docs: DataFrame, bands: dict = BANDS, scripts: dict = SCRIPT_BANDS, piece_path: str | None = None,
                  ranks_path: str | None = None) -> DataFrame:
    """One row per document with the base counts, the token measures and the verdict."""
    piece_path = vocabulary("piece_bpe_32k.model", piece_path)
    ranks_path = vocabulary("byte_bpe_multi_50k.tiktoken", ranks_path)

    def run(slices: Iterator[list]) -> Iterator[list]:
        fertility = Fertility(piece_path, ranks_path)
        for doc_ids, texts, langs in slices:
            base = [base_counts(t or "") for t in texts]
            fertility.learn([b[5] for b in base])
            out = []
            for doc_id, lang, text, (n, chars, symbols, dups, repeats, tokens) in zip(doc_ids, langs, texts, base):
                failed = n < MIN_WORDS or 100 * repeats > 50 * n
                measures = fertility.measure(tokens, chars) if tokens else (None,) * 4
                reason = "base" if failed else verdict(measures, band(lang, text, bands, scripts))
                out.append((doc_id, n, chars, symbols, dups, repeats, failed, reason is None, *measures, reason))
            yield list(zip(*out))

    return map_columns(docs, ["doc_id", "text", "lang"], SCHEMA, run)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their columns as they came."""
    ship(spark)
    piece_path = vocabulary("piece_bpe_32k.model")
    ranks_path = vocabulary("byte_bpe_multi_50k.tiktoken")
    text, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(piece_path, ranks_path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = [t or "" for t in batch.column(text).to_pylist()]
                base = [base_counts(t) for t in texts]
                passed = [n >= MIN_WORDS and 100 * repeats <= 50 * n for n, _, _, _, repeats, _ in base]
                fertility.learn([b[5] for b, ok in zip(base, passed) if ok])
                yield batch.filter(pa.array([ok and verdict(fertility.measure(b[5], b[1]), band(lang, t)) is None
                                             for b, ok, lang, t in zip(base, passed, batch.column(lang_at).to_pylist(), texts)],
                                            pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any name may stand in the table, dots too
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
