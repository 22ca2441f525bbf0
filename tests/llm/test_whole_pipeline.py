"""The pipeline against plain Python, and inputs on which text, rows or columns were once lost."""

import base64
import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import html_extraction, line_dedup, quality_classifier, quality_rules
from strata.llm.common import vocabulary

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def ranks():
    with open(vocabulary("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def plain_measures(text, pieces, encoding):
    """Characters per token of both vocabularies, byte share and entropy, by the libraries on the whole text."""
    words = SPACE.findall(text)
    whole = " ".join(words)
    ids = pieces.encode(whole)
    chars = sum(map(len, words))
    counts = np.array(list(Counter(ids).values()), float) / len(ids)
    return (chars / len(encoding.encode_ordinary(" " + whole)), chars / len(ids), sum(map(pieces.is_byte, ids)) / len(ids),
            float(-(counts * np.log2(counts)).sum()))


def test_measures_are_the_libraries_on_whole_texts(spark, make_docs):
    pieces, encoding = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model")), ranks()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = make_docs([(10_000, "Tab\there  and\n\nlines é日本\U0001F642 ＦＵＬＬ x" * 30), (10_001, "a")])
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs.select(odd.columns).union(odd)).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.union(odd).collect()}
    for doc_id, text in texts.items():
        r = got[doc_id]
        if SPACE.findall(text or ""):
            want = plain_measures(text, pieces, encoding)
            assert (r["chars_per_token"], r["chars_per_piece"], r["byte_share"], r["token_entropy"]) == pytest.approx(want, rel=1e-9)


def plain_quality(rows):
    pieces, encoding = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model")), ranks()
    out = []
    for r in rows:
        words = SPACE.findall(r["text"] or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
        if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
            continue
        if quality_rules.verdict(plain_measures(r["text"], pieces, encoding), quality_rules.band(r["lang"], r["text"])) is None:
            out.append(r)
    return out


def doc_order(r):
    """Null doc_ids first, then by doc_id, then by the text's hash as Spark computes it."""
    return (r["doc_id"] is not None, r["doc_id"] or 0, r["key"])


def plain_line_dedup(rows):
    seen, covered = {}, {}
    for r in sorted(rows, key=doc_order):
        name = (r["doc_id"], r["key"])
        if name in covered:
            continue
        lines = (r["text"] or "").split("\n")
        worded = [i for i, x in enumerate(lines) if SPACE.search(x)]
        dead = set()
        for a in range(len(worded) - 2):
            window = tuple(lines[i] for i in worded[a:a + 3])
            if seen.setdefault(window, (*name, a)) != (*name, a):
                dead |= set(worded[a:a + 3])
        covered[name] = (len(worded), dead)
    out = []
    for r in rows:
        n, dead = covered[r["doc_id"], r["key"]]
        if not dead:
            out.append(r)
        elif len(dead) < n:
            text = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in dead)
            out.append({**r, "text": text, "n_chars": len(text)})
    return out


def plain_fingerprint(text):
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_simhash(rows):
    prints = [plain_fingerprint(r["text"]) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        own = (r["doc_id"] is None, r["doc_id"] or 0, r["key"])  # null ids last
        least[root(i)] = min(least.get(root(i), own), own)
    return [r for i, r in enumerate(rows) if least[root(i)] == (r["doc_id"] is None, r["doc_id"] or 0, r["key"])]


def plain_decontamination(rows, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = set()
    for text in items:
        w = find(text)
        n = min(len(w), 13)
        windows |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1 if n else 0)}
    sizes, out = {len(x) for x in windows}, []
    for r in rows:
        w = find(r["text"])
        hit = {i + k for n in sizes for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in windows for k in range(n)}
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def test_pipeline_is_the_plain_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    good = [r for r in rows if len((r["text"] or "").split()) > 120]
    passage = pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist()
    planted = [(None, good[0]["text"] + " and a word of its own"), (None, good[1]["text"]), (None, None), (7, good[2]["text"]),
               (7, good[3]["text"] + "\n" + good[4]["text"]), (7, good[3]["text"] + "\n" + good[4]["text"]), (900_001, ""),
               (900_002, good[5]["text"] + " " + max(passage, key=lambda t: len(t or ""))), (900_003, good[6]["text"]), (900_004, good[6]["text"])]
    extra = [(i, t, "en", "planted", None if t is None else len(t)) for i, t in planted]
    table = docs.union(spark.createDataFrame(extra, docs.schema)).repartition(5)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [r.asDict() for r in table.withColumn("key", F.xxhash64("text")).collect()]
    for stage in (plain_quality, plain_line_dedup, plain_simhash, lambda x: plain_decontamination(x, passage)):
        before = len(kept)
        # a document's key follows its text, as every stage reads what the one before has written
        kept = stage(kept)
        assert 0 < len(kept) < before
        keys = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(kept)], "i int, text string").withColumn("key", F.xxhash64("text"))
        keys = {r["i"]: r["key"] for r in keys.collect()}
        kept = [{**r, "key": keys[i]} for i, r in enumerate(kept)]
    encoding = ranks()
    want = Counter()
    for r in kept:
        ids = np.array(encoding.encode_ordinary(r["text"]), "<u4")
        want[r["doc_id"], len(ids), hashlib.sha256(r["text"].encode()).hexdigest(), ids.tobytes()] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want


CLASHES = ["_k", "_doc", "_key", "_row", "_starts", "key", "id", "row", "n_lines", "n_removed", "kept_text", "starts", "h1", "label", "node", "fp"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_every_column(name, stage, make_docs, prose, spark):
    docs = make_docs([(i, prose(150, i), "xx") for i in range(4)] + [(9, prose(150, 1) + "\n" + prose(10, 5), "xx"), (10, prose(60, 3) + "\n" + "\n".join(prose(30, i) for i in (1, 2, 3)), "xx"),
                                                                  (11, prose(60, 4) + "\n" + "\n".join(prose(30, i) for i in (1, 2, 3)), "xx")])
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit(c + " of "), F.col("doc_id").cast("string")))
    out = stage(spark, docs.withColumn("a.b", F.lit("dots")), SF)
    assert out.columns == [*docs.columns, "a.b"]
    rows = out.collect()
    assert len(rows) >= 4 and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHES) and rows[0]["a.b"] == "dots"


def test_line_dedup_results_take_the_place_of_equal_names(make_docs):
    out = line_dedup.line_dedup(make_docs([(1, "a\nb")]).withColumn("n_lines", F.lit("mine")).withColumn("_k", F.lit(5)))
    assert out.first().asDict() == {"doc_id": 1, "text": "a\nb", "lang": "en", "source": "s", "n_chars": 3, "_k": 5, "n_lines": 2,
                                    "n_removed": 0, "kept_text": "a\nb"}


def test_one_doc_id_on_many_rows_is_one_training_bag(make_docs, prose, spark):
    a, b = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = make_docs([(a, prose(20, 1))] * 3000 + [(a, prose(20, 2))] * 10 + [(b, prose(70_000, 3))])
    labels = spark.createDataFrame([(a, 1), (b, 0), (b, 0)], "doc_id long, quality int")
    bags = quality_classifier.training_bags(docs, labels, 2)
    assert [x[0] for x in bags] == [a, b]
    assert all(len(b[1]) <= quality_classifier.TRAIN_PASSAGES for b in bags)


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(1)
    sizes = [1, 4, 2]
    x, first, label = rng.normal(size=(7, quality_classifier.N_FEATURES)), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    shape = {"W": (quality_classifier.N_FEATURES, 5), "b": (5,), "V": (5, 3), "U": (5, 3), "a": (3,), "c": (5,), "d": ()}
    weights = {k: rng.normal(size=s) for k, s in shape.items()}
    importance = np.array([0.5, 0.3, 0.2])
    model = quality_classifier.GatedAttention(np.zeros(x.shape[1]), np.ones(x.shape[1]), weights)

    def plain_loss():
        loss, at = 0.0, 0
        for n, y, weight in zip(sizes, label, importance):
            h = np.tanh(x[at:at + n] @ weights["W"] + weights["b"])
            e = np.exp((np.tanh(h @ weights["V"]) / (1 + np.exp(-h @ weights["U"]))) @ weights["a"])
            p = 1 / (1 + np.exp(-((e / e.sum()) @ h @ weights["c"] + weights["d"])))
            loss -= weight * (y * np.log(p) + (1 - y) * np.log(1 - p))
            at += n
        return loss

    grads = model.gradients(model.forward(x, first), first, label, importance)
    for name, g in grads.items():
        flat = weights[name].reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 7)):
            kept, step = flat[i], 1e-6
            flat[i] = kept + step
            up = plain_loss()
            flat[i] = kept - step
            slope = (up - plain_loss()) / (2 * step)
            flat[i] = kept
            assert np.asarray(g).reshape(-1)[i] == pytest.approx(slope, rel=1e-4, abs=1e-8)


@pytest.mark.parametrize("page,text", [
    ("<article><p data-x=it's>Alpha</p><p>Beta don't</p><p>Gamma</p></article>", "Alpha Beta don't Gamma"),
    ('<article><p class="x>Alpha</p><p>Beta</p></article>', "Alpha Beta"),
    ("<article><p class='search-tips'>A</p><p class='note-form'>B</p><div class='legal'>C</div></article>", "A B C"),
    ("<article><p a=b/c title='x>y'>A<br/>B<img src=x/ alt=\"a>b\">C</p><div class='share-bar'>no</div></article", "A B C"),
    ("<article><p =a b='c' d=\"e\"f>A</p/x><p/>B</article>", "A B"),
    ("<p>a < b <c</p> d>e", "a < b d>e"),
])
def test_attributes_and_names_in_the_article(page, text):
    assert html_extraction.extract(page, None) == text


def test_deep_pages_take_linear_memory():
    def peak(n):
        tracemalloc.start()
        assert html_extraction.extract("<div>" * n + "x" + "</div>" * n + "y", None) == "x y"
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top
    assert peak(40_000) < 60e6 and peak(40_000) < 6 * peak(10_000)


def test_texts_of_unknown_language_are_judged_by_their_script(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    low, clean = {}, {}
    for name, table in (("own", docs), ("script", unknown)):
        rows = quality_rules.quality_rules(table).join(labels, "doc_id").filter("NOT base_failed").select("quality", "kept").collect()
        low[name] = sum(not r["kept"] for r in rows if r["quality"] == 0)
        clean[name] = sum(not r["kept"] for r in rows if r["quality"] == 1)
    assert low["own"] >= 20 and low["script"] >= low["own"] and clean["script"] <= clean["own"] + 1


def test_scripts():
    want = {"plain words": "latin", "\u041f\u0440\u0438\u0432\u0435\u0442 ok": "cyrillic", "\u03b3\u03b5\u03b9\u03ac": "greek",
            "\u05e9\u05dc\u05d5\u05dd": "semitic", "\u0939\u093f\u0928\u094d\u0926\u0940": "indic", "\u4e2d\u6587\u5b57": "han",
            "\u65e5\u672c\u8a9e\u306e\u6587": "kana", "\ud55c\uad6d": "hangul", "12 34 --": None, "": None, "\u00e9t\u00e9 1": "latin"}
    assert {t: quality_rules.script(t) for t in want} == want
    assert quality_rules.verdict((10.0, 4.0, 0.0, 7.0), quality_rules.band("en", "")) == "chars_per_token"
    assert quality_rules.verdict((4.0, 4.0, 0.0, 13.5), quality_rules.band(None, "\u00fc")) == "token_entropy"
    assert quality_rules.band(None, "na\u00efve caf\u00e9 \u00e7a") == quality_rules.BANDS["fr"] and quality_rules.band(None, "x") == quality_rules.BANDS["en"]
    assert quality_rules.band("pl", "x") == quality_rules.SCRIPT_BANDS["latin"] and quality_rules.band(None, "12") == quality_rules.OTHER_BAND


@pytest.mark.parametrize("bucket,chunk", [(1 << 16, 1 << 14), (6, 8), (2, 1)])
def test_large_buckets_are_searched_in_parts(spark, monkeypatch, bucket, chunk):
    """A family of fingerprints that share most bits, so that nearly all meet in a bucket."""
    from strata.llm import simhash
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    fps = {base ^ sum(1 << int(b) for b in rng.integers(0, 20, rng.integers(0, 6))) for _ in range(150)} | {int(x) for x in rng.integers(0, 1 << 62, 50)}
    fps |= {f ^ (1 << 63) for f in list(fps)[:30]}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = Counter((r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)).collect())
    unsigned = lambda x: x & ((1 << 64) - 1)
    pairs = Counter(frozenset((unsigned(a), unsigned(b))) for a, b in got.elements())
    want = {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
    assert set(pairs) == want and max(pairs.values()) == 1 and len(want) > 200
