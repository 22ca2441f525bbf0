"""License scan by an exact set-similarity join (operator 9, DataFrame functions only).

Text blocks are runs of consecutive words, whatever the line breaks: of as many words as the template has, and half as
many again for marks of comments.  A block meets a template when it contains at least ``THRESHOLD`` of the template's
distinct words; a template of under ``SHORT`` words must also stand in its order, with nothing left out.  Runs are
looked for in windows of twice the longest run, so that each lies in a window whole.  Templates are a parameter: by
default single sentences of well-known notices, but whole notices are taken likewise.  The join is exact:

* words are ordered by their frequency in the whole corpus, rarest first;
* prefix filter: of a template with t words and required overlap o, a window must hold one of the t - o + 1 rarest;
* length filter: a window with fewer than o words of the templates' vocabulary cannot meet it;
* positional filter: after a match at positions i and j at most 1 + min(t - i - 1, b - j - 1) words can be common;
* what remains is verified run by run, by intersecting the two sets.

Only the templates' own vocabulary is counted and ordered (a few hundred words, bounded by the parameter, not by
the corpus), over all documents.  The template side of the join is a constant table.

Beside the join, the contract's phrases are located word by word in the whole text.

Defined results: null and empty texts have no words and score 0; texts with neither phrase nor block score 0, a
phrase scores 1; rows that share doc_id and text are one document with the same result each; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import let, row_key, table, upto, words

THRESHOLD = 0.9
#: Templates of fewer distinct words say too little as a set: their order counts.
SHORT = 10

#: Phrases of the contract and their labels (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: One sentence of each notice (fixed values).
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License; you may obtain a copy of the "
                 "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License"),
    ("lgpl", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted"),
]


def _set(sentence: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[a-z0-9]+", sentence.lower())))


def _sequence(sentence: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", sentence.lower())


def _run(sentence: str) -> int:
    """Most words among which a template's must stand."""
    return math.ceil(1.5 * len(_sequence(sentence)))


def required(size: int, threshold: float) -> int:
    """Least number of common words."""
    return math.ceil(round(threshold * size, 9))


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words, rarest in the corpus first (one row per word of the vocabulary reaches the driver)."""
    counted = (docs.select(F.explode(words(F.col("text"))).alias("word")).filter(F.col("word").isin(vocabulary))
               .groupBy("word").count().collect())
    counts = {r["word"]: r["count"] for r in counted}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def license_blocks(docs: DataFrame, templates: list = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key, template, label, containment: every template that a run of the document's words meets."""
    spark = docs.sparkSession
    sets = [(label, _set(sentence)) for label, sentence in templates]
    order = word_order(docs, sorted({w for _, s in sets for w in s}))
    rank = {w: i for i, w in enumerate(order)}
    prefixes, rows = set(), []
    runs = [_run(sentence) for _, sentence in templates]
    for number, (label, tokens) in enumerate(sets):
        tokens = sorted(tokens, key=rank.get)
        need = required(len(tokens), threshold)
        for i, word in enumerate(tokens[: len(tokens) - need + 1]):
            rows.append((number, label, word, i, len(tokens), need, tokens, runs[number],
                         _sequence(templates[number][1]) if len(tokens) < SHORT else None))
            prefixes.add(word)
    theirs = spark.createDataFrame(rows, "template int, label string, word string, i int, t int, need int, "
                                         "tokens array<string>, run int, sequence array<string>")
    ordered = F.array(*map(F.lit, order))
    prefix = F.array(*[F.lit(w) for w in sorted(prefixes, key=rank.get)])
    least = min(required(len(t), threshold) for _, t in sets)
    # a document without any prefix word has no block with one
    likely = docs.select("doc_id", "text", row_key().alias("key")).filter(F.arrays_overlap(words(F.col("text")), prefix))
    step = max(runs)
    windows = likely.select("doc_id", "key", F.explode(let(words(F.col("text")), lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(step)),
        lambda i: F.slice(w, i + 1, F.lit(2 * step))))).alias("window"))
    # in the order of the first array: rarest first
    probes = (windows.filter(F.arrays_overlap("window", prefix))
              .select("doc_id", "key", "window", F.array_intersect(ordered, "window").alias("b"))
              .filter(F.size("b") >= least)
              .select("doc_id", "key", "window", "b", F.posexplode("b").alias("j", "word")))
    in_run = F.array_max(F.transform(upto(F.size("window")), lambda i: F.size(
        F.array_intersect(F.slice("window", i + 1, F.col("run")), "tokens"))))
    # a run that begins with the template's first word and holds its words in order
    in_order = F.exists(upto(F.size("window")), lambda i: (F.get("window", i) == F.get("sequence", F.lit(0))) & (
        F.slice(F.filter(F.slice("window", i + 1, F.col("run")), lambda x: F.array_contains("tokens", x)), 1, F.size("sequence"))
        == F.col("sequence")))
    return (probes.join(theirs, "word")
            .filter((F.size("b") >= F.col("need"))
                    & (1 + F.least(F.col("t") - F.col("i") - 1, F.size("b") - F.col("j") - 1) + F.least("i", "j")
                       >= F.col("need")))
            .filter(F.size(F.array_intersect("b", "tokens")) >= F.col("need"))
            .withColumn("common", F.when(F.col("sequence").isNull(), in_run).when(in_order, F.col("t")))
            .filter("common >= need")
            .groupBy("doc_id", "key", "template", "label")
            .agg(F.max(F.col("common") / F.col("t")).alias("containment")))


def _places(tokens: Column) -> Column:
    """(start, label) of every phrase occurrence."""
    phrases = [(p.split(), label) for p, label in PHRASES.items()]
    rare = F.array(*[F.lit(w) for w in ("mit", "apache", "nc")])

    def at(i: Column, phrase: list[str]) -> Column:
        test = F.lit(True)
        for k, w in enumerate(phrase):
            test = test & (F.get(tokens, i + k).eqNullSafe(w))
        return test

    found = F.lit(None).cast("string")
    def label_at(i: Column) -> Column:
        out = found
        for phrase, label in phrases:
            out = F.when(at(i, phrase), label).otherwise(out)
        return out

    return F.when(F.arrays_overlap(tokens, rare), F.filter(
        F.transform(upto(F.size(tokens)), lambda i: F.struct(i.alias("start"), label_at(i).alias("label"))),
        lambda x: x["label"].isNotNull())).otherwise(F.array().cast("array<struct<start:int,label:string>>"))


def license_scan(docs: DataFrame, templates: list = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, places (start, label), base_labels and labels (sorted arrays), score."""
    base = docs.select("doc_id", row_key().alias("key"), let(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _places(w).alias("places"))).alias("x")).select(
        "doc_id", "key", "x.n_words", "x.places")
    met = (license_blocks(docs, templates, threshold).groupBy("doc_id", "key")
           .agg(F.collect_set("label").alias("met"), F.max("containment").alias("containment"))
           .withColumnsRenamed({"doc_id": "_doc", "key": "_key"}))
    joined = base.join(met, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    base_labels = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    return joined.select(
        "doc_id", "n_words", "places", base_labels.alias("base_labels"),
        F.array_sort(F.array_union(base_labels, F.coalesce("met", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.transform("places", lambda x: x["start"].cast("long"))
    return license_scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _sql_templates() -> str:
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    return ", ".join(f"({i}, '{label}', {listed(_set(sentence))}, {listed(_sequence(sentence))}, {_run(sentence)}, "
                     f"{required(len(_set(sentence)), THRESHOLD)})" for i, (label, sentence) in enumerate(TEMPLATES))


def _sql_phrases() -> str:
    return ", ".join("([{}], '{}')".format(", ".join(f"'{w}'" for w in phrase.split()), label)
                     for phrase, label in PHRASES.items())


_SQL_WORDS = (r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE = f"""
WITH dw AS (SELECT doc_id, {_SQL_WORDS.format('text')} AS w FROM documents),
phrase(p, label) AS (VALUES {_sql_phrases()}),
place AS (
  SELECT doc_id, i - 1 AS start, label
  FROM dw, phrase, unnest(range(1, len(w) + 1)) AS u(i) WHERE w[i : i + len(p) - 1] = p),
template(id, label, tokens, seq, run, need) AS (VALUES {_sql_templates()}),
likely AS (SELECT doc_id, w, t.* FROM dw, template t WHERE len(list_intersect(w, tokens)) >= need),
block AS (SELECT doc_id, label, tokens, seq, need, w[i : i + run - 1] AS w FROM likely, unnest(range(1, len(w) + 1)) AS u(i)),
met AS (
  SELECT doc_id, label, len(tokens) AS t,
         CASE WHEN len(tokens) >= {SHORT} THEN len(list_intersect(w, tokens)) ELSE len(tokens) END AS common
  FROM block
  WHERE CASE WHEN len(tokens) >= {SHORT} THEN len(list_intersect(w, tokens)) >= need
             ELSE w[1] = seq[1] AND list_filter(w, lambda x: list_contains(tokens, x))[1 : len(seq)] = seq END),
named AS (SELECT doc_id, label FROM place UNION SELECT doc_id, label FROM met),
base AS (
  SELECT doc_id, count(*) AS n, min(start) AS lo, max(start) AS hi,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY 1),
every AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM named GROUP BY 1),
best AS (SELECT doc_id, max(common::DOUBLE / t) AS score FROM met GROUP BY 1)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base,
       base.lo::BIGINT AS first_word, base.hi::BIGINT AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.score, 0)::DOUBLE END AS score
FROM dw LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""
