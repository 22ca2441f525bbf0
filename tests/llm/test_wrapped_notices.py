"""Notices that line breaks cut, as in the headers of real files."""

import textwrap

from strata.llm import licenses


def test_wrapped_notices(make_docs, prose):
    rows, want = [], {}
    for i, (label, sentence) in enumerate(licenses.TEMPLATES):
        for j, (width, mark) in enumerate([(72, ""), (30, "# "), (44, "dnl ")]):
            body = "\n".join(mark + x for x in textwrap.wrap(f"{prose(7 * i, i)} {sentence}, {prose(9, j)}", width))
            rows.append((100 * j + i, f"{prose(200 * j, i)}\n\n{body}\n{prose(120, i + 1)}"))
            want[rows[-1][0]] = label
    scattered = licenses.TEMPLATES[9][1].split()
    rows.append((900, "\n".join(f"{w} {prose(6, k)}" for k, w in enumerate(scattered))))
    out = {r["doc_id"]: r for r in licenses.license_scan(make_docs(rows)).collect()}
    for doc, label in want.items():
        assert label in out[doc]["labels"] and out[doc]["score"] >= licenses.THRESHOLD
    assert out[900]["labels"] == [] and out[900]["score"] == 0


def test_words_of_a_notice_that_are_no_notice(make_docs, prose):
    cc = licenses.TEMPLATES[5][1].split()
    rows = [(1, "The students of MIT released their data under a different license"), (2, " ".join(f"{prose(15, i)} {w}" for i, w in enumerate(cc))),
            (3, "license MIT the\nunder released"), (4, "Released under the MIT\nLicense, the end"), (5, "released under the mit")]
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_scan(make_docs(rows)).collect()}
    assert out == {1: ([], 0.0), 2: ([], 0.0), 3: ([], 0.0), 4: (["mit"], 1.0), 5: ([], 0.0)}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software."""


def test_whole_notices_as_templates(make_docs, prose):
    templates = [("mit", MIT), ("house", "All parts of this work stay with the workshop that made them and may be lent for a day")]
    words = MIT.split()
    rows = [(1, prose(300, 1) + "\n * " + "\n * ".join(" ".join(words[i:i + 9]) for i in range(0, len(words), 9)) + "\n" + prose(90, 2)),
            (2, prose(100, 3) + " " + " ".join(words[: len(words) // 2])), (3, MIT.replace("Software", "Material")),
            (4, " ".join(f"{w} {prose(2, i)}" for i, w in enumerate(words)))]
    out = {r["doc_id"]: r["labels"] for r in licenses.license_scan(make_docs(rows), templates).collect()}
    assert out == {1: ["mit"], 2: [], 3: ["mit"], 4: []}
