"""Quality classifier by attention-based multiple-instance learning (operator 10).

A document is a bag of passages of ``PASSAGE`` words.  Every passage of the whole text is described by its
character classes, word lengths and repetition, and encoded by a small network; gated attention
(softmax of w . (tanh(V h) * sigmoid(U h))) weights the encodings, and the weighted sum is scored.  Only the
document's label is used in training; the weights say which passages decided.

Training.  The labelled rows whose crc32(doc_id as text) mod 3 is not 1 train the model, of these at most
``TRAIN_ROWS``, those with the smallest hash of doc_id, each with at most ``TRAIN_PASSAGES`` passages spread over its
text.  This bounded sample is all that reaches the driver (as passage features, computed on Spark); the small
network is fitted there with fixed seed and steps.  Scoring reads every passage of every document; it is a
narrow map over all documents.  labels, lang, source and doc_id never enter a score.

Defined results: null and empty texts are a bag of one passage without words; repeated rows score alike; of
several labels for one doc_id the mean counts, 0.5 as 1; of several texts under one doc_id the one with the smallest
hash trains; rows without a label train nothing; without any label
every score is 0.5; a null doc_id is not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import cut, map_columns, row_key, table

PASSAGE = 100
#: Most labelled documents that train the model, and most passages of one (evenly over the text).
TRAIN_ROWS = 2000
TRAIN_PASSAGES = 256
HIDDEN, ATTENTION, STEPS, RATE, DECAY, SEED = 16, 8, 250, 0.03, 1e-4, 7

#: Character classes counted in a passage: each of these bytes by itself, then ranges.
SINGLE = b"#*$%&|!?.,=@/<>\"\n"
_CLASS = np.full(256, len(SINGLE) + 5, np.uint8)
for _i, _b in enumerate(SINGLE):
    _CLASS[_b] = _i
_CLASS[48:58] = len(SINGLE)
_CLASS[65:91] = len(SINGLE) + 1
_CLASS[97:123] = len(SINGLE) + 2
_CLASS[128:] = len(SINGLE) + 3
_CLASS[[9, 11, 12, 13, 32]] = len(SINGLE) + 4
N_CLASS = len(SINGLE) + 6
N_FEATURES = N_CLASS + 4


def passages(text: str | None) -> np.ndarray:
    """One row of features per passage (float32)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    tokens = raw.split()
    if not tokens:
        return np.zeros((1, N_FEATURES), np.float32)
    codes = np.frombuffer(raw, np.uint8)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    heads = starts[::PASSAGE].copy()
    heads[0] = 0
    n = len(heads)
    owner = np.repeat(np.arange(n), np.diff(np.r_[heads, len(codes)]))
    counts = np.bincount(owner * N_CLASS + _CLASS[codes], minlength=n * N_CLASS).reshape(n, N_CLASS)
    share = counts / counts.sum(1, keepdims=True)
    runs = [tokens[i: i + PASSAGE] for i in range(0, len(tokens), PASSAGE)]
    sizes = np.array([len(r) for r in runs], float)
    distinct = np.array([len(set(r)) for r in runs], float) / sizes
    letters = np.array([sum(map(len, r)) for r in runs], float) / sizes
    before = [0.0] + [sum(w in known for w in r) / len(r) for known, r in zip(map(frozenset, runs), runs[1:])]
    return np.column_stack([np.sqrt(share), distinct, np.log1p(letters), np.log1p(sizes) / 5, before]).astype(np.float32)


def spread(bag: np.ndarray, most: int = TRAIN_PASSAGES) -> np.ndarray:
    """At most ``most`` passages, evenly over the text."""
    return bag if len(bag) <= most else bag[np.arange(most) * len(bag) // most]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_bags(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list:
    """(doc_id, features, label) of at most ``rows`` labelled documents outside the held-out third."""
    chosen = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # at most ``rows`` rows of two numbers
    texts = docs.select("doc_id", "text", row_key().alias("key")).join(F.broadcast(cut(chosen)), "doc_id")

    def run(slices: Iterator[list]) -> Iterator[list]:
        for doc_ids, keys, texts_, labels_ in slices:
            yield [doc_ids, keys, [spread(passages(t)).tobytes() for t in texts_], labels_]

    bags = map_columns(texts, ["doc_id", "key", "text", "label"], "doc_id long, key long, bag binary, label int", run)
    # copies of a document become one in the tasks
    found = bags.groupBy("doc_id").agg(F.min_by("bag", "key").alias("bag"), F.max("label").alias("label")).collect()
    return sorted(((r["doc_id"], np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES), r["label"])
                   for r in found), key=lambda x: (x[0], x[1].shape, x[1].tobytes()))


class GatedAttention:
    """The network; bags are rows of ``x`` beginning at ``first``."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict) -> None:
        self.mean, self.scale, self.w = mean, scale, weights

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        w, sizes = self.w, np.diff(np.r_[first, len(x)])
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        weight = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(h * weight[:, None], first)
        score = 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))
        return {"x": x, "h": h, "t": t, "s": s, "weight": weight, "z": z, "score": score, "sizes": sizes}

    def gradients(self, f: dict, first: np.ndarray, label: np.ndarray, importance: np.ndarray) -> dict:
        w, sizes = self.w, f["sizes"]
        out = (f["score"] - label) * importance
        per_row = np.repeat(out, sizes)
        dh = per_row[:, None] * f["weight"][:, None] * w["c"]
        dweight = per_row * (f["h"] @ w["c"])
        inner = np.add.reduceat(dweight * f["weight"], first)
        de = f["weight"] * (dweight - np.repeat(inner, sizes))
        gate = de[:, None] * w["a"]
        dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        dh = (dh + dt @ w["V"].T + ds @ w["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds,
                "a": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ out, "d": np.array(out.sum())}


def fit(bags: list) -> GatedAttention | None:
    """Adam on the class-balanced log loss, from a fixed seed."""
    if not bags:
        return None
    x = np.concatenate([b[1] for b in bags]).astype(np.float64)
    first = np.cumsum([0] + [len(b[1]) for b in bags[:-1]])
    label = np.array([b[2] for b in bags], float)
    share = np.clip(label.mean(), 0.02, 0.98)
    importance = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) / len(label)
    rng = np.random.default_rng(SEED)
    start = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = {"W": start(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": start(HIDDEN, ATTENTION),
               "U": start(HIDDEN, ATTENTION), "a": start(ATTENTION), "c": start(HIDDEN), "d": np.zeros(())}
    model = GatedAttention(x.mean(0), x.std(0) + 0.02, weights)
    first_moment = {k: np.zeros_like(v) for k, v in weights.items()}
    second_moment = {k: np.zeros_like(v) for k, v in weights.items()}
    for step in range(1, STEPS + 1):
        grads = model.gradients(model.forward(x, first), first, label, importance)
        for k, g in grads.items():
            g = g + DECAY * model.w[k]
            first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
            second_moment[k] = 0.999 * second_moment[k] + 0.001 * g * g
            model.w[k] = model.w[k] - RATE * (first_moment[k] / (1 - 0.9 ** step)) / (
                np.sqrt(second_moment[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def score_documents(docs: DataFrame, model: GatedAttention | None) -> DataFrame:
    """doc_id, score, n_passages, top_passage (the one with the largest attention)."""
    def run(slices: Iterator[list]) -> Iterator[list]:
        for doc_ids, texts in slices:
            bags = [passages(t) for t in texts]
            sizes = [len(b) for b in bags]
            if model is None:
                yield [doc_ids, [0.5] * len(bags), sizes, [0] * len(bags)]
                continue
            first = np.cumsum([0] + sizes[:-1])
            out = model.forward(np.concatenate(bags).astype(np.float64), first)
            top = [int(np.argmax(out["weight"][a: a + n])) for a, n in zip(first, sizes)]
            yield [doc_ids, out["score"].tolist(), sizes, top]

    return map_columns(docs, ["doc_id", "text"], "doc_id long, score double, n_passages long, top_passage long", run)


def quality_classifier(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    return score_documents(docs, fit(training_bags(docs, labels, rows)))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
