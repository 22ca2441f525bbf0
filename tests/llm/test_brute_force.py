"""Operators against plain Python on small planted fixtures."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import tiktoken  # noqa: F401
import xxhash

from strata.llm import bpe, decontamination, line_dedup, quality_rules, simhash, suffix_dedup, token_files
from strata.llm.common import json_tokenizer, ranks_encoding, vocabulary

LOWER = {i: i + 32 for i in range(65, 91)}


# ---- decontamination ----

def contaminated(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 13)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                owners = windows.get(tuple(w[i:i + n]))
                if owners:
                    hit |= set(range(i, i + n))
                    found |= owners
        out[doc] = (len(w), len(hit), sorted(map(str, found)))
    return out


def test_decontamination(spark, make_docs, prose):
    rng = random.Random(5)
    items = [(i, prose(rng.randint(10, 40), i)) for i in range(30)]
    items += [(100, "Short item"), (101, "uno, Dos tres"), (102, prose(13, 900)), (103, None), (104, "--"), (105, items[0][1])]
    docs = []
    for i in range(120):
        t = prose(rng.randint(0, 80), 1000 + i)
        if i % 3 == 0:
            w = rng.choice(items[:30])[1].split()
            k = rng.randint(0, 10)
            t += " " + ", ".join(w[k:k + rng.randint(8, 30)]).upper() + "\n" + prose(rng.randint(0, 30), i)
        if i % 7 == 0:
            t += " short ITEM, and uno dos tres"
        docs.append((i, t))
    docs += [(200, items[3][1] * 50)]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.decontaminate(
        make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = contaminated(docs, items)
    assert got == want
    assert sum(w[1] > 0 for w in want.values()) > 30


# ---- line de-duplication ----

def test_line_dedup_text(make_docs, prose):
    block = [prose(8, i) for i in range(4)]
    docs = [(1, "\n".join(["top", *block, "end"])), (2, "\n".join(["other", block[0], "", block[1], block[2], "x"])),
            (3, "\n".join(block[:2])), (4, "\n".join(block + block)), (5, "a\na\na\na\na")]
    out = {r["doc_id"]: (r["kept_text"], r["n_removed"]) for r in line_dedup.line_dedup(make_docs(docs)).collect()}
    assert out[1] == (docs[0][1], 0)
    assert out[2] == ("other\n\nx", 3)
    assert out[3] == (docs[2][1], 0)
    assert out[4] == ("", 8)
    assert out[5] == ("a", 4)


# ---- simhash ----

def simhash_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints):
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in prints}


def test_simhash(make_docs, prose):
    rng = random.Random(3)
    base = [prose(400, i) for i in range(15)]
    docs = [(i, prose(rng.choice([0, 1, 2, 3, 30]), 50 + i)) for i in range(20)]
    for i in range(20, 120):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "Changed"
        docs.append((i, " ".join(w)))
    prints = {d: simhash_of(t) for d, t in docs}
    out = simhash.near_duplicates(make_docs(docs)).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in out} == prints
    assert {r["doc_id"]: r["component_id"] for r in out} == grouped(prints)


def test_long_chains_become_one_component(spark):
    n = 200
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1002), (1001, 1002)], "a long, b long")
    out = {r["node"]: r["label"] for r in simhash.components(pairs).collect()}
    assert out == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000, 1002: 1000}


@pytest.mark.parametrize("one_bucket", [True, False])
def test_gray_index_finds_every_pair(one_bucket):
    rng = np.random.default_rng(1)
    fps = set()
    for x in rng.integers(0, 2 ** 63, 30, dtype=np.uint64).tolist():
        for _ in range(30):
            y = x
            for _ in range(rng.integers(0, 5)):
                y ^= 1 << int(rng.integers(64))
            fps.add(y)
    fps = np.array(sorted(fps), np.uint64)
    want = {(a, b) for i, a in enumerate(fps.tolist()) for b in fps.tolist()[i + 1:] if bin(a ^ b).count("1") <= 2}
    rank = fps.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    got = []
    if one_bucket:
        f = fps[np.argsort(rank)]
        a, b = simhash.GrayIndex(f, np.zeros(len(f), np.int64)).within(np.arange(len(f)), 2)
        got = [(x, y) for x, y in zip(f[a].tolist(), f[b].tolist()) if x < y]
    else:
        masks = np.array(simhash.key_masks(), np.uint64)
        for k, m in enumerate(masks):
            v = (fps & m).view(np.int64)
            o = np.lexsort((rank.view(np.int64), v))
            for a, b in simhash._links(np.full(len(fps), k), v[o], fps[o], masks, 2):
                got += [(x % (1 << 64), y % (1 << 64)) for x, y in zip(a, b)]
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_stage_removes_by_document(spark, make_docs, prose):
    a, b, c, d, e = (prose(300, 9000 + i) for i in range(5))
    rows = [(1, a), (None, a), (None, b),  # the copy under a null id goes, the other text under a null id stays
            (2, c), (3, c), (3, d),        # the same with a shared doc_id
            (None, None), (4, e), (4, e)]  # rows equal in both are one document
    out = simhash.stage_simhash(spark, make_docs(rows), "").collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out))) == sorted(map(str, (
        (1, a), (None, b), (2, c), (3, d), (None, None), (4, e), (4, e))))
    near = [(5, "  ".join(a.split())), (5, " ".join(a.split()) + " ")]  # two texts of equal words under the smallest id
    kept = simhash.stage_simhash(spark, make_docs(near + [(6, a)]), "").collect()
    assert len(kept) == 1 and (5, kept[0]["text"]) in near


# ---- quality rules ----

def test_quality_base_counts(make_docs, prose):
    texts = [prose(100, 1), "a b c a b c a b c", "x # y $$\nline one\nline one\n \nline  one\nline one", "", "é　b \x1c c"]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(make_docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        covered = {p for k, x in enumerate(windows) if windows.count(x) > 1 for p in range(k, k + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_fertility_rejects_symbol_noise(make_docs, prose):
    import pyarrow.parquet as pq
    clean = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.001/labels.parquet").to_pylist()}
    rows = [(d["doc_id"], d["text"], d["lang"]) for d in clean if labels.get(d["doc_id"]) == 1]
    marks = ["%%%", "###", "&&&", "$$$", "***"]
    loud = [(10_000 + i, " ".join(w + marks[k % 5] for k, w in enumerate(t.split())), lang) for i, t, lang in rows]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(make_docs(rows + loud)).collect()}
    judged = [i for i, _, _ in rows if not out[i]["base_failed"]]
    assert len(judged) > 20
    assert all(out[i]["kept"] for i in judged)
    assert sum(out[10_000 + i]["kept"] for i in judged) <= len(judged) // 20


# ---- suffix de-duplication ----

def stripped(docs, n=100):
    seen, out = set(), {}
    for doc, text in sorted(docs):
        raw = (text or "").encode()
        dead = bytearray(len(raw))
        for s in range(len(raw) - n + 1):
            if raw[s:s + n] in seen:
                dead[s:s + n] = b"\1" * n
            seen.add(raw[s:s + n])
        out[doc] = (sum(dead), sum(1 for i, d in enumerate(dead) if d and (not i or not dead[i - 1])),
                    bytes(b for b, d in zip(raw, dead) if not d))
    return out


@pytest.mark.parametrize("chunk", [4096, 3])
def test_suffix_dedup(make_docs, prose, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rng = random.Random(3)
    passages = [prose(60, 70 + i) + "é" for i in range(5)]
    docs = []
    for i in range(150):
        t = prose(rng.randint(0, 60), i)
        for _ in range(rng.randint(0, 3)):
            t += " " + rng.choice(passages)[rng.randint(0, 60):][:rng.randint(60, 300)] + prose(rng.randint(0, 9), i + 500)
        if i % 17 == 0:
            t = "ab" * rng.randint(0, 400)
        if i % 23 == 0 and docs:
            t = rng.choice(docs)[1]
        docs.append((i, t))
    out = {r["doc_id"]: (r["n_bytes"] - len(r["kept"]), len(r["spans"]), bytes(r["kept"]))
           for r in suffix_dedup.suffix_dedup(make_docs(docs), f"{tmp_path}/x").collect()}
    want = stripped(docs)
    assert out == want
    assert sum(x[0] for x in want.values()) > 5000


def test_contexts_cover_every_window_in_long_texts(monkeypatch):
    raw = bytes(random.Random(1).choices(b"abcd ", k=5000))
    whole = suffix_dedup.contexts(raw)
    assert whole[3].sum() == len(raw) - 99
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    parts = suffix_dedup.contexts(raw)
    spread = lambda c: np.repeat(c[0], c[3]).tolist()
    assert spread(whole) == spread(parts)


# ---- byte-level BPE ----

ALPHABET = ["a", "b", "'", "'re", "'s", " ", "  ", "\n", "\n\n", "\t", "é", "1", "23", "!", "...", "　", "\x1c",
            "\xa0", "the", "\U0001F642", " x", "́", "<|endoftext|>"]


def test_tree_reduction_equals_whole_encoding():
    encoding = ranks_encoding(vocabulary("byte_bpe_multi_50k.tiktoken"))
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 60)))
        ids = bpe.encode(encoding, text, leaf=rng.randint(1, 9))
        assert ids == encoding.encode_ordinary(text)
        assert bpe.decode(encoding, ids, 3) == text.encode()


def test_bpe_query_columns(make_docs, prose):
    encoding = ranks_encoding(vocabulary("byte_bpe_multi_50k.tiktoken"))
    docs = [(1, prose(9000, 1)), (2, "x" * 30000), (3, ""), (4, None)]
    for r in bpe.bpe_decode(bpe.bpe_encode(make_docs(docs))).collect():
        text = dict(docs)[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == encoding.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()


# ---- token files ----

def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1023, 1024):
        for top in (1, 2, 300, 49408, 2 ** 32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[rng.random(n) < 0.05] = top - 1
            assert (token_files.read_block(token_files.write_block(ids)) == ids).all()


def test_words_alone_encode_like_texts():
    path = vocabulary("word_bpe_49k.json")
    tokenizer, encoder = json_tokenizer(path), token_files.WordEncoder(path)
    rng = random.Random(4)
    letters = ALPHABET + ["<|", "İ", "Σ", "ß", "\x0b", "\x85", "ᄀ", "ᅡ", "THE", "<|ENDOFTEXT|>"]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        assert encoder.ids([text])[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_token_files(make_docs, prose, tmp_path):
    tokenizer = json_tokenizer(vocabulary("word_bpe_49k.json"))
    docs = [(i * 3 % 101, prose(i * 5, i)) for i in range(101)] + [(500, None), (501, prose(20000, 9))]
    files = token_files.write_token_files(make_docs(docs), f"{tmp_path}/t")
    out = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(files).collect()}
    at = 0
    for doc, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert out[doc] == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    first = files.orderBy("shard").first()
    with open(first["file"], "rb") as source:
        source.seek(0, 2)
        f = token_files.TokenFile(source, source.tell())
        everything = f.tokens(0, f.n_tokens)
        assert (f.tokens(5, 2000) == everything[5:2000]).all()
        assert hashlib.sha256(everything.tobytes()).digest() == hashlib.sha256(
            np.concatenate([ids for _, _, ids in f]).tobytes()).digest()
