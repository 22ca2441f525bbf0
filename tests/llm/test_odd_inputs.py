"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import (bpe, decontamination, html_extraction, licenses, line_dedup, quality_classifier,
                        quality_rules, simhash, suffix_dedup, token_files)

SF = "/root/testdata/sf0.001"


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "one two three"), (2, None), (2, ""), (None, "four five")],
                                 "item_id long, text string")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, None), (None, 1, 1)],
                                 "doc_id long, quality int, toxic int")


OPERATORS = {
    "decontamination": lambda d, i, lb, tmp: decontamination.decontaminate(d, i),
    "line_dedup": lambda d, i, lb, tmp: line_dedup.line_dedup(d),
    "token_files": lambda d, i, lb, tmp: token_files.read_token_files(token_files.write_token_files(d, f"{tmp}/t")),
    "simhash": lambda d, i, lb, tmp: simhash.near_duplicates(d),
    "quality_rules": lambda d, i, lb, tmp: quality_rules.quality_rules(d),
    "suffix_dedup": lambda d, i, lb, tmp: suffix_dedup.suffix_dedup(d, f"{tmp}/s"),
    "bpe": lambda d, i, lb, tmp: bpe.bpe_decode(bpe.bpe_encode(d)),
    "licenses": lambda d, i, lb, tmp: licenses.license_scan(d),
    "quality_classifier": lambda d, i, lb, tmp: quality_classifier.quality_classifier(d, lb),
}
CLASHING = ["key", "start", "h", "words", "hashes", "len", "label", "fp", "_k", "spans", "ids", "window", "n_hit"]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows_in_rows_out(name, make_docs, items, labels, prose, tmp_path):
    rows = [(None, None), (None, "x y z"), (1, ""), (2, None), (3, "  \n\t\n "), (4, prose(30000, 1)),
            (5, prose(60, 2)), (5, prose(60, 2)), (6, "a" * 70000), (7, "\x00 é\U0001F642 \x85　 x")]
    docs = make_docs(rows)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("clash"))
    out = OPERATORS[name](docs, items, labels, tmp_path).collect()
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in out)
    assert ids == sorted((r[0] is not None, r[0] or 0) for r in rows)
    twins = [tuple(str(v) for k, v in r.asDict().items() if k != "start") for r in out if r["doc_id"] == 5]
    assert len(set(twins)) == 1 or name == "suffix_dedup"


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(name, make_docs, items, labels, tmp_path):
    docs = make_docs([(1, "x")]).filter("doc_id > 5")
    assert OPERATORS[name](docs, items.filter("item_id > 9"), labels.filter("doc_id > 9"), tmp_path).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_columns(name, stage, spark, make_docs, prose):
    rows = [(None, None), (1, ""), (2, None), (3, prose(200, 1), "xx"), (4, prose(200, 2), "xx"), (5, "a" * 50000)]
    docs = make_docs(rows).withColumn("key", F.lit(1)).withColumn("_doc2", F.lit("x"))
    out = stage(spark, docs, SF)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
        assert {3, 4} <= {r["doc_id"] for r in out.collect()}
        assert stage(spark, docs.filter("doc_id > 9"), SF).collect() == []
    else:
        assert out.count() == len(rows)


def test_pages(spark):
    rows = [(None, None, None), (1, "nothing", ""), (2, "http://h/", "<article>x"), (2, "http://h/", "<article>x"),
            (3, "http://h/", "<p>" * 3000 + "y"), (4, "http://h/", "plain & simple")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.withColumn("host", F.lit(1)).withColumn("classes", F.lit(2))
    out = {(r["page_id"], r["text"]) for r in html_extraction.extract_main_text(pages).collect()}
    assert out == {(None, ""), (1, ""), (2, "x"), (3, "y"), (4, "plain & simple")}
    assert html_extraction.extract_main_text(pages.filter("page_id > 9")).collect() == []


def test_plain_words_lower_case_letter_by_letter():
    from strata.llm.token_files import PLAIN
    for c in map(chr, range(0x2b0)):
        if PLAIN.fullmatch(c):
            assert f"A{c}B{c}".lower() == "".join(x.lower() for x in f"A{c}B{c}")
