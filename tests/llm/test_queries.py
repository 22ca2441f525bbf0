"""The registered queries that SQL cannot express, against plain Python over the whole small tables."""

import hashlib
import re
import struct
import zlib

import pyarrow.parquet as pq
import pytest
from test_brute_force import grouped, simhash_of, stripped

from strata.llm.common import json_tokenizer, ranks_encoding, vocabulary
from strata.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_op3(spark, texts):
    tokenizer = json_tokenizer(vocabulary("word_bpe_49k.json"))
    out = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op3_token_files"](spark, SF).collect()}
    at, want = 0, {}
    for doc_id in sorted(texts):
        ids = [*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 2]
        want[doc_id] = (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert out == want


def test_op5(spark, texts):
    prints = {d: simhash_of(t) for d, t in texts.items()}
    component = grouped(prints)
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash"](spark, SF).collect()}
    assert out == {d: (f"{prints[d]:016x}", component[d]) for d in texts}


def test_op6(spark, texts):
    for r in QUERIES["op6_quality_rules"](spark, SF).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])
        windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        seen = {}
        for x in windows:
            seen[x] = seen.get(x, 0) + 1
        covered = {p for k, x in enumerate(windows) if seen[x] > 1 for p in range(k, k + 3)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_op7(spark, texts):
    want = stripped(list(texts.items()))
    out = {r["doc_id"]: r for r in QUERIES["op7_suffix_dedup"](spark, SF).collect()}
    assert out.keys() == texts.keys()
    for d, r in out.items():
        removed, spans, kept = want[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (
            len(texts[d].encode()), removed, spans, sha(kept))


def test_op8(spark, texts):
    encoding = ranks_encoding(vocabulary("byte_bpe_multi_50k.tiktoken"))
    out = QUERIES["op8_byte_bpe"](spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(texts[r["doc_id"]].encode()))
