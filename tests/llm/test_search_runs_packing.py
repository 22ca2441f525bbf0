"""Operators 11 to 13 against plain Python."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strata.llm import lexical_search, packing, periodic_runs
from strata.llm.common import vocabulary

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


# ---- ranked search ----

def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranking(docs, items, top):
    tfs = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(tfs), sum(sum(tf.values()) for _, tf in tfs)
    df = Counter(t for _, tf in tfs for t in tf)
    out = set()
    for item, text in items:
        found = []
        for doc, tf in tfs:
            m = 75 + (25 * sum(tf.values()) * n_docs) // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, q in Counter(terms(text)).items() if t in tf)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out |= {(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found)[:top], 1)}
    return out


def searched(spark, make_docs, docs, items, **kw):
    out = lexical_search.search(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"), **kw)
    rows = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_search(spark, make_docs, prose):
    rng = random.Random(11)
    items = [(i, prose(rng.randint(1, 40), i)) for i in range(25)]
    items += [(100, None), (101, "-- !"), (102, "Straße ÉTÉ straße x9"), (103, "nowhere"), (104, prose(3000, 9)), (3, items[3][1])]
    docs = [(i, prose(rng.randint(0, 300), 500 + i)) for i in range(400)]
    docs += [(1000 + i, prose(60, 7)) for i in range(60)]  # copies: ties far beyond the ranks
    docs += [(2000, items[5][1] + " " + prose(20, 5)), (2001, None), (2002, "..."), (2003, prose(40000, 4)),
             (2004, "STRASSE straße été, x9 X9 x9"), (None, prose(30, 3)), (2005, "x" * 60000)]
    assert searched(spark, make_docs, docs, items) == ranking(docs, items[:-1], 20)


@pytest.mark.parametrize("shrunk", [{"BLOCK_DOCS": 8, "HELD_KEYS": 300, "HELD_TERMS": 50},
                                    {"QUERY_CHARS": 200, "TERMS_AT_ONCE": 30}, {"QUERY_ROWS": 3}, {"BROADCAST_ROWS": 0, "ROWS_PER_KEY": 1}])
def test_search_in_small_pieces(spark, make_docs, prose, monkeypatch, shrunk):
    for name, value in shrunk.items():
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(12)
    items = [(i, prose(rng.randint(1, 30), i)) for i in range(12)]
    docs = [(i, prose(rng.randint(0, 120), 50 + i)) for i in range(150)] + [(900 + i, items[2][1]) for i in range(9)]
    assert searched(spark, make_docs, docs, items, top=7, probes=9) == ranking(docs, items, 7)


def test_search_repeated_rows_and_names(spark, make_docs):
    docs = [(1, "a b c")] * 3 + [(1, "a b d"), (None, "a b"), (None, "a b"), (2, "e f")]
    items = [(5, "a c"), (5, "d"), (None, "e"), (None, None)]
    assert len(searched(spark, make_docs, docs, items[1:])) == 2
    out = lexical_search.search(make_docs(docs).withColumn("key", F.lit(1)).withColumn("query", F.lit(2)),
                                spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0)))
    got = sorted(((r["item_id"] or 0), r["rank"], r["doc_id"] or 0) for r in out.collect())
    assert got == sorted([(5, 1, 1), (5, 2, 1), (5, 3, 1), (5, 4, 0), (5, 5, 0), (5, 6, 1), (5, 1, 1), (0, 1, 2)])


def test_search_of_nothing(spark, make_docs):
    docs = make_docs([(1, "x"), (2, None)])
    items = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert lexical_search.search(docs.filter("doc_id > 5"), items).collect() == []
    assert lexical_search.search(docs.filter("doc_id = 2"), items).collect() == []
    assert lexical_search.search(docs, items.filter("item_id > 5")).collect() == []


def test_bounds_never_fall_below_scores(prose):
    """Every document's bound reaches its exact score for every query."""
    docs = [(i, i, prose(5 + 7 * i, i)) for i in range(60)]
    held = []
    for doc_id, key, text in docs:
        tf = Counter(lexical_search.terms(text))
        levels = np.searchsorted(lexical_search.LEVELS, np.fromiter(tf.values(), np.int64), "right")
        held.append((doc_id, key, sum(tf.values()), lexical_search.term_hashes(tf), levels))
    df = Counter(t for _, _, text in docs for t in set(lexical_search.terms(text)))
    total = sum(h[2] for h in held)
    queries = lexical_search.Queries([Counter(lexical_search.terms(prose(20, 900 + i))) for i in range(10)], df, 60, total)
    seen = 0
    for _, _, (doc_ids,), _, (sizes,), (rows,), (raw,) in lexical_search._blocks(held):
        for query, bound in queries.bounds(np.array(sizes), rows, raw):
            for doc_id, most in zip(doc_ids, bound):
                exact = dict(queries.scores(docs[doc_id][2], [query]))[query]
                assert most * lexical_search.SLACK >= exact
                seen += 1
    assert seen == 600


# ---- periodic runs ----

def all_runs(words):
    """(start, length, period) by trying every period."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                out.setdefault((start, length), q)  # smallest period first
    return sorted((s, le, q) for (s, le), q in out.items())


def sample_texts(rng, n):
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            alphabet = rng.choice(["ab", "abc", "abcdefghijklmnop"])
            block = [rng.choice(alphabet) for _ in range(rng.randint(1, 12))]
            parts += block * rng.choice([1, 1, 2, 3, 4, 5, 9, 30]) + block[:rng.randint(0, len(block))]
        texts.append(" ".join(parts))
    return texts


def test_batch_of_tiles():
    texts = sample_texts(random.Random(3), 400)
    fragments = periodic_runs.batch_fragments([t.encode().split() for t in texts])
    for text, found in zip(texts, fragments):
        whole = {(lo, hi - lo + p): p for p, lo, hi in found if hi - lo + p >= max(6, 4 * p)}
        assert sorted((s, le, q) for (s, le), q in whole.items()) == all_runs(text.split())


@pytest.mark.parametrize("limits", [{}, {"whole_words": 10, "tile_words": 16}, {"whole_words": 40, "tile_words": 1}])
def test_runs(make_docs, limits):
    texts = sample_texts(random.Random(4), 150)
    docs = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "x " * 700), (None, "y " * 9), (None, "z")]
    docs += [(503, "a b " * 5), (503, "a b " * 5), (503, "b " * 6)]
    got = Counter((r["doc_id"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed_sha256"])
                  for r in periodic_runs.periodic_runs(make_docs(docs), **limits).collect())
    want = Counter()
    for doc_id, text in docs:
        words = (text or "").split()
        runs = all_runs(words)
        gone = {i for s, le, q in runs for i in range(s + q, s + le)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want[doc_id, tuple(sorted(runs, key=lambda r: (r[0], r[2]))), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert got == want
    assert sum(len(k[1]) for k in want) > 100


def test_runs_query(spark, tmp_path, make_docs, prose):
    """The registered query's columns, planted repetitions and all."""
    docs = [(i, prose(random.Random(i).randint(0, 150), i)) for i in range(120)] + [(500, None), (501, "a b a b a b a b c c c c c c")]
    make_docs(docs).withColumn("key", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for doc_id, text in docs:
        words = (text or "").split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = sorted(all_runs(words), key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        gone = {i for s, le, q in runs for i in range(s + q, s + le)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        listed = "".join(f"{s},{le},{q}\n" for s, le, q in runs)
        assert got[doc_id] == (len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
                               hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
    assert planted > 5 and sum(g[0] for g in got.values()) > 5


# ---- packing ----

def test_combinations():
    want = {(a, b, 12 - a - b) for a in range(13) for b in range(13) if a >= b >= 12 - a - b >= 0}
    assert {tuple(r) for r in packing.combinations(12).tolist()} == want


@pytest.mark.parametrize("seed", range(6))
def test_least_squares_is_optimal(seed):
    """No combination left out could lower the residual, and none that is used has a slope."""
    rng = np.random.default_rng(seed)
    histogram = rng.integers(0, 200, 33)
    histogram[0] = histogram[32] = 0
    combos = packing.combinations(32)
    used, x = packing.repeat_counts(histogram, combos, rounds=300, tolerance=1e-9)
    rest = histogram.astype(float)
    for c, n in zip(used, x):
        for length in combos[c]:
            rest[length] -= n
    rest[0] = 0
    gain = rest[combos].sum(axis=1)
    assert (x > 0).all() and gain.max() < 1e-3 and abs(gain[used]).max() < 1e-3


@pytest.mark.parametrize("histogram", [{5: 3}, {1: 1}, {16: 4}, {15: 1000}, {3: 500, 13: 100, 11: 7}, {7: 1, 9: 1}, {}] +
                         [dict(Counter(random.Random(i).choices(range(1, 17), k=300 * i))) for i in range(1, 6)])
def test_plan(histogram):
    counts = np.zeros(17, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    plan = packing.plan_packing(counts, 16)
    places = packing.Places(plan.rows)
    filled = {}
    for n, c in histogram.items():
        for rank in range(c):
            at = 0
            for start, size, sequence, offset in places.of(n, rank):
                assert start == at
                at += size
                filled.setdefault(sequence, []).append((offset, size))
            assert at == n
    assert sorted(filled) == list(range(plan.sequences))
    for parts in filled.values():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        assert end <= 16 and end & (end - 1) == 0  # full or a power of two: no padding
    tokens = sum(n * c for n, c in histogram.items())
    assert plan.sequences <= tokens // 16 + 4


def odd_texts(rng, n):
    pieces = [" ", "  ", "   ", "\n", " \n", "\n ", "\t", "a", "b.", "don't", "'s", " 's", "12", "3x", "é", "日本", " ", "\x1c", "\x85",
              "<|endoftext|>", "!", "--", "word", "Word", "\U0001F642", " ", "x" * 70]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(n)]


def test_ids_are_the_librarys(prose):
    path, ranks = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    plain = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205f)]]
    around = [f"{a}{c}{b}" for c in plain for a, b in (("x", "y"), (" ", " "), ("1 ", "\n"), ("'", "'s"), ("  ", "!"), (". ", "\t "))]
    rng = random.Random(1)
    mixed = ["".join(rng.choices(plain, k=rng.randint(1, 40))) for _ in range(3000)]
    texts = [*odd_texts(rng, 4000), *around, *mixed, None, "", prose(500, 1), "x" * 3000, " " * 300]
    library = Tokenizer.from_file(path)
    encoder = packing.TextEncoder(path, ranks)
    for text in texts:
        assert np.frombuffer(encoder.ids(text), encoder.type).tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_packing(make_docs, prose):
    rng = random.Random(2)
    docs = [(i, prose(rng.choice([1, 5, 30, 90, 90, 90, 200]), i)) for i in range(300)] + [(i, "same words here") for i in range(300, 500)]
    docs += [(600, None), (601, ""), (602, prose(6000, 1)), (603, "x"), (603, "x"), (None, "y"), (None, None)]
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    pieces = packing.pack(make_docs(docs).withColumn("rank", F.lit("clash")).withColumn("part", F.lit(0)))
    rows = pieces.collect()
    texts = {}
    for doc_id, text in docs:
        texts.setdefault(doc_id, []).append([*library.encode(text or "", add_special_tokens=False).ids, 0])
    found, filled = {}, {}
    for r in rows:
        ids = list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"]))
        assert len(ids) == r["length"] > 0
        found.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, wanted in texts.items():
        if len(wanted) == 1:
            assert sum((ids for _, ids, _ in sorted(found[doc_id])), []) == wanted[0]
        assert sum(len(ids) for _, ids, _ in found[doc_id]) == sum(map(len, wanted))
        assert {n for _, _, n in found[doc_id]} == set(map(len, wanted))
    assert sorted(filled) == list(range(len(filled)))
    padding = 0
    for parts in filled.values():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    assert padding == 0
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    assert sum(r["n_tokens"] for r in whole.values()) == sum(len(t) for ts in texts.values() for t in ts)
    assert all(len(r["ids"]) == r["n_tokens"] or len(r["ids"]) == 1024 for r in whole.values())


@pytest.mark.parametrize("run", [lambda d: periodic_runs.periodic_runs(d), lambda d: packing.pack(d)])
def test_nothing_to_do(make_docs, run):
    assert run(make_docs([(1, "x")]).filter("doc_id > 5")).collect() == []


def test_pieces_of_many_documents_leave_together(spark, make_docs, prose, monkeypatch):
    from strata.llm import packing
    seen, map_columns = [], packing.map_columns
    monkeypatch.setattr(packing, "map_columns", lambda df, columns, schema, fn, **k: seen.append(fn) or map_columns(df, columns, schema, fn, **k))
    assert packing.pack(make_docs([(i, prose(5, i)) for i in range(30)])).count() >= 30
    place = {"start": 0, "length": 2, "sequence_id": 0, "offset": 0}
    raw = bytes([1, 0, 2, 0])
    columns = [list(range(50)), [2] * 50, [raw] * 50, [2] * 50, [[place]] * 50]
    [out] = seen[-1](iter([columns]))
    assert list(out[0]) == list(range(50)) and set(out[6]) == {bytes([1, 0, 0, 0, 2, 0, 0, 0])}
    parts = list(seen[-1](iter([[[1], [2], [raw], [2], [[place] * 2500]]])))  # a long document in parts
    assert [len(p[0]) for p in parts] == [1024, 1024, 452]
