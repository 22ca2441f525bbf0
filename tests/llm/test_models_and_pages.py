"""Held-out accuracy of the classifier, page extraction on planted pages, and the pipeline against brute force."""

import html
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import html_extraction, quality_classifier
from strata.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_classifier_on_held_out_labels(spark):
    scored = QUERIES["op10_quality_classifier"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    by = {q: [r["predicted"] for r in rows if r["quality"] == q] for q in (0, 1)}
    assert len(rows) > 60
    assert 1 - sum(by[0]) / len(by[0]) > 0.9 and sum(by[1]) / len(by[1]) > 0.9


def test_classifier_ignores_names_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.fit(quality_classifier.training_bags(docs, labels, 100))
    moved = docs.withColumn("doc_id", F.col("doc_id") + 7).withColumn("lang", F.lit("x")).withColumn("source", F.lit(""))
    a = quality_classifier.score_documents(docs, model).orderBy("doc_id").select("score").collect()
    b = quality_classifier.score_documents(moved, model).orderBy("doc_id").select("score").collect()
    assert [r["score"] for r in a] == pytest.approx([r["score"] for r in b], abs=1e-9)


def article_of(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inside))
    return " ".join(b for b in blocks if b)


def test_pages_of_the_test_data(spark):
    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    out = QUERIES["op4_html_extraction"](spark, SF).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r["text"] == article_of(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<div class="cookie-notice">Notice</div><nav><ul><li>Menu</ul></nav><main><div class="sidebar">Side</div>
<article><header><h1>Title &amp;lt; %d</h1></header><p>On<b>e</b> two<br>three <!-- no -->four<p>five
<script>if(a<b){}</script><form>Search</form><section class="comments"><p>Comment</section>
<ul><li>six<li>seven</ul></article><aside>More</aside></main><footer>Foot</footer>"""


def test_parts_that_are_no_main_text(spark):
    rows = [(i, f"http://one.example/{i}", PAGE % i) for i in range(5)]
    out = html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for r in out.collect():
        assert r["text"] == f"Title &lt; {r['page_id']} One two three four five six seven"


def test_the_article_that_stands_once_on_the_pages_of_a_host(spark):
    page = "<main>Top {0}<article class='post'><p>Text {0}</article>" + "<article class='teaser'>T</article>" * 3 + "</main>"
    rows = [(i, "https://two.example/a", page.format(i)) for i in range(4)] + [(9, "https://two.example/b", "<main>Only main</main>")]
    out = html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in out.collect()} == {**{i: f"Text {i}" for i in range(4)}, 9: "Only main"}


def test_template_tells_tokens_of_equal_vectors(spark):
    rows = [(i, "http://one.example/", "<body><nav>x</nav><article>" + "<p>t" * (i + 1) + "</article></body>")
            for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    classes = html_extraction.templates(pages).first()["classes"]
    skeleton = {t for c in classes if c["skeleton"] for t in c["tokens"]}
    assert skeleton == {"/body", "/body/nav", "/body/article"}
    assert ["/body/article/p"] in [c["tokens"] for c in classes if not c["skeleton"]]


def test_classes_of_the_template_are_ordered_and_nested(spark):
    # nav and footer change places; i and u of two slots have one vector; the records' tokens take turns
    page = ("<body>{0}<div class=a><i>x</i></div><div class=b><u>x</u></div><main>{1}</main></body>")
    turn = ["<nav>n</nav><footer>f</footer>", "<footer>f</footer><nav>n</nav>"]
    rows = [(i, "http://one.example/", page.format(turn[i % 2], "<dl><dt>t<dd>d</dl>" * (i + 2))) for i in range(4)]
    rows += [(i, "http://two.example/", "<main>" + "<b>x</b>" * (i % 2 + 1) + "<s>y</s>" * (i % 2 + 1) + "</main>") for i in range(4)]
    rows += rows[:1]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["host"]: r["classes"] for r in html_extraction.templates(pages).collect()}
    classes = {tuple(c["tokens"]): (c["outer"], c["skeleton"]) for c in found["one.example"]}
    record = "/body/main/dl"
    assert classes[record, record + "/dt", record + "/dd"] == ("/body/main", False)
    assert classes["/body/nav",] == ("/body", True) and classes["/body/footer",] == ("/body", True)
    two = {tuple(c["tokens"]): c["outer"] for c in found["two.example"]}  # b b s s: not in turns
    assert two == {("/main",): "", ("/main/b",): "/main", ("/main/s",): "/main"}


def test_an_article_in_a_repeated_slot_is_no_article(spark):
    page = "<main><article class=post>Text {0}</article><ul>{1}</ul></main>"
    record = "<li>Item</li><li><article class=teaser>Read on</article></li>"
    rows = [(i, "http://one.example/", page.format(i, record)) for i in range(4)]
    out = html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in out.collect()} == {i: f"Text {i}" for i in range(4)}


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, kept = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).persist()
        assert kept.columns == docs.columns
        assert kept.join(before, "doc_id", "left_anti").isEmpty()
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[-1] > counts[0] / 2
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in kept.select("doc_id").collect()}
    import hashlib
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    for r in out.collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert len(r["ids"]) == 4 * r["n_tokens"]


ELEMENTS = """<article><p>A <span aria-hidden=true>x</span><span>y</span> <a href="/hidden-gems">g</a>
<a style="overflow:hidden" href="/p?id=ad" data-id="share-3">h</a><p hidden>B<p>C
<h2 id="related-work">R</h2><h3 id="search-algorithms">S</h3><div class="share-bar">no<p>no</div><div>D</div></article>"""


def test_exclusion_is_by_element_and_whole_attribute():
    assert html_extraction.extract(ELEMENTS, None) == "A y g h C R S D"
    assert html_extraction.extract("<aside><article>Teaser</article></aside><main>Text</main>", None) == "Text"


def test_the_template_decides_where_names_do_not(spark):
    page = ("<body><div class=top>Site <b>name</b></div><div class=lnk><a>Home</a><p>About</div><div class=x><h1>T{0}</h1>"
            "<p>Text <i>{0}</i> of its own<p>Same for all</div><div class=low>All rights</div><div class=ad>Buy {0}</div>")
    rows = [(i, "http://n.example/", page.format(i)) for i in range(4)]
    rows += [(10 + i, "http://c.example/", f"<!-- {i} --><div class=x>One text, copied</div>") for i in range(3)]
    rows += [(20 + i, "http://a.example/", f"<div class=lnk>Menu</div><article>As ever<p>A{i}</article>") for i in range(3)]
    rows += [(30, "http://a.example/", "<div class=lnk>Menu</div><div class=x>No article</div>")]
    out = html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in out.collect()} == {
        **{i: f"T{i} Text {i} of its own" for i in range(4)}, **{10 + i: "One text, copied" for i in range(3)},
        **{20 + i: f"As ever A{i}" for i in range(3)}, 30: "No article"}
