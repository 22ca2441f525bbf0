"""Periodic runs of words, found by tiles at every scale (operator 12).

A run is a maximal stretch of words with smallest period q and at least ``max(MIN_LENGTH, MIN_EXPONENT * q)`` words.

Tiles.  Periods are taken by octave, h <= p < 2h.  The octave's boundaries stand at every multiple of P = 2h, and a
tile is the P words before a boundary and the 2P after it, so neighbouring tiles overlap.  A run of the octave is
longer than P, so a boundary lies in it, and the tiles of its boundaries cover it together.

Solving a tile.  The Z-function of the words after the boundary, and that of the words before it read backwards,
say for every period of the octave how far words p apart agree to the right and to the left.  Agreement over P or
more places is a fragment (period, first and last agreeing place).  A fragment whose period is a multiple of a
shorter one is no run's own: the shorter period's octave finds the same stretch.  Tiles are tried only where the h
words on a side of the boundary stand again one period further, by rolling hashes of h words; the hashes only choose
tiles, the Z-functions decide.

Stitching.  Fragments are shuffled by document and period, and those that touch or overlap become one interval of
agreeing places; with q words more it is the maximal stretch, and counts if it is long enough.

Scale.  Short documents' tiles are solved where the text was read (all tiles of a batch at once), and their touching
fragments are merged before the shuffle.  The tiles of a document over ``WHOLE_WORDS`` words are rows of their own,
dealt over all tasks.  Words travel again only for documents that have a fragment.  The phase that reads the texts
ends in a table in the shared folder.

Defined results: null, empty and wordless texts have no words and no runs; repeated rows get equal results; rows
that share a doc_id but not the text are documents of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.llm.common import land, map_columns, row_key, shared_dir, sized, table

MIN_EXPONENT = 4
MIN_LENGTH = 6
#: Words of a document that is solved where it was read, and of a row of tiles of a longer one (they bound memory,
#: not results).
WHOLE_WORDS = 1 << 17
TILE_WORDS = 1 << 16

Rule = Callable[[int | None, list[bytes]], list[bytes]]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def z_function(s: list[int]) -> list[int]:
    """For each place how many symbols from there agree with the beginning (0 at place 0)."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def prime_divisors(n: int) -> list[int]:
    out, r = [], 2
    while r * r <= n:
        if n % r == 0:
            out.append(r)
            while n % r == 0:
                n //= r
        r += 1
    return out + [n] if n > 1 else out


def tile_fragments(ids: np.ndarray, boundary: int, half: int) -> Iterator[tuple[int, int, int]]:
    """(period, lo, hi) of the tile at ``boundary``: places lo..hi-1 agree with the word a period later."""
    span = 2 * half
    ahead = z_function(ids[boundary: boundary + 2 * span].tolist())
    before = ids[max(0, boundary - span): boundary][::-1].tolist()
    around = ids[max(0, boundary - span): boundary + span][::-1].tolist()
    behind = z_function([*before, None, *around])
    # what stands p words after the place before the boundary is so far into ``around``
    first = len(before) + 1 + min(span, len(ids) - boundary)
    for p in range(half, min(span, len(ahead))):
        right = min(ahead[p], span)
        left = min(behind[first - p], span)
        if left + right >= span and not any(ahead[p // r] >= p - p // r for r in prime_divisors(p)):
            yield p, boundary - left, boundary + right


_MIX = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(ids: np.ndarray) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def twice_as_long(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of 2 * size words from those of ``size``; windows that pass the end get some value."""
    out = h * (_MIX + np.uint64(2 * size))
    out[: max(0, len(h) - size)] += h[size:]
    return out ^ (out >> np.uint64(31))


def boundaries(h: np.ndarray, half: int) -> np.ndarray:
    """Boundaries at which ``half`` words on one side stand again a period of the octave later (or seem to)."""
    span = 2 * half
    rows = len(h) // span
    grid = h[: rows * span].reshape(rows, span)
    found = (grid[:, half:] == grid[:, :1]).any(axis=1)
    found[1:] |= (grid[1:, :half] == grid[:-1, half: half + 1]).any(axis=1)
    return np.flatnonzero(found) * span


def octave_fragments(ids: np.ndarray, h: np.ndarray, half: int) -> Iterator[tuple[int, int, int]]:
    """Fragments of an octave; the last tile is filled up with words that agree with none."""
    fill = -len(ids) % (2 * half)
    if fill:
        ids = np.concatenate([ids, -1 - ids.max(initial=0) - np.arange(fill)])
        h = np.concatenate([h, word_hashes(ids[len(h):])])
    for b in boundaries(h, half).tolist():
        yield from tile_fragments(ids, b, half)


def merged(fragments: Iterator[tuple]) -> list[tuple]:
    """(owner, period, lo, hi), those of one owner and period in order of place; touching ones become one."""
    reach: dict[tuple, list[list[int]]] = {}
    for owner, p, lo, hi in fragments:
        spans = reach.setdefault((owner, p), [])
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    return [(owner, p, lo, hi) for (owner, p), spans in reach.items() for lo, hi in spans]


def batch_fragments(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Per text its (period, lo, hi), all tiles of a scale solved together."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    known: dict[bytes, int] = {}
    parts, starts, at = [], [], 0
    for n, i in enumerate(order):
        own = np.fromiter((known.setdefault(w, len(known)) for w in texts[i]), np.int64, len(texts[i]))
        parts += [own, np.array([-1 - n])]  # a word that stands nowhere else ends the text
        starts.append(at)
        at += len(own) + 1
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    ids = np.where(ids < 0, len(known) - 1 - ids, ids)
    sizes, starts = np.array([len(texts[i]) for i in order]), np.array(starts, np.int64)
    h, half = word_hashes(ids), 1
    while len(sizes) and sizes[0] >= max(MIN_LENGTH, MIN_EXPONENT * half):
        long = int(np.searchsorted(-sizes, -max(MIN_LENGTH, MIN_EXPONENT * half), "right"))
        end = int(starts[long - 1] + sizes[long - 1] + 1)
        ids, h = ids[:end], h[:end]
        found = ((int(np.searchsorted(starts, lo, "right")) - 1, p, lo, hi)
                 for p, lo, hi in octave_fragments(ids, h, half))
        for owner, p, lo, hi in merged(found):
            out[order[owner]].append((p, lo - int(starts[owner]), hi - int(starts[owner])))
        h, half = twice_as_long(h, half), 2 * half
    return out


_FRAGMENTS = "array<struct<period: long, lo: long, hi: long>>"


def solve_documents(docs: DataFrame, rule: Rule | None, whole_words: int) -> DataFrame:
    """doc_id, key, n_words, plain_sha256, words (space-joined, where a run may be), fragments (null: still to solve)."""
    def run(slices: Iterator[list]) -> Iterator[list]:
        for doc_ids, keys, texts in slices:
            each = [words(t) for t in texts]
            if rule is not None:
                each = [rule(d, w) for d, w in zip(doc_ids, each)]
            short = [len(w) <= whole_words for w in each]
            solved = iter(batch_fragments([w for w, ok in zip(each, short) if ok]))
            fragments = [next(solved) if ok else None for ok in short]
            joined = [b" ".join(w) for w in each]
            yield [doc_ids, keys, [len(w) for w in each], [hashlib.sha256(j).hexdigest() for j in joined],
                   [None if f == [] else j for j, f in zip(joined, fragments)],
                   [None if f is None else [dict(zip(("period", "lo", "hi"), x)) for x in f] for f in fragments]]

    return map_columns(sized(docs.select("doc_id", row_key().alias("key"), "text")), ["doc_id", "key", "text"],
                       "doc_id long, key long, n_words long, plain_sha256 string, words binary, fragments "
                       + _FRAGMENTS, run)


def explode_tiles(long_docs: DataFrame, tile_words: int) -> DataFrame:
    """doc_id, key, half, base, ids: rows of neighbouring tiles of every octave of long documents."""
    def run(slices: Iterator[list]) -> Iterator[list]:
        for doc_ids, keys, joined in slices:
            for doc_id, key, text in zip(doc_ids, keys, joined):
                known: dict[bytes, int] = {}
                ids = np.fromiter((known.setdefault(w, len(known)) for w in text.split()), np.int32)
                half = 1
                while len(ids) >= max(MIN_LENGTH, MIN_EXPONENT * half):
                    span = 2 * half
                    step = max(span, tile_words // span * span)
                    for base in range(0, len(ids), step):
                        lo = max(0, base - span)
                        yield [[doc_id], [key], [half], [lo], [ids[lo: base + step + 2 * span].tobytes()]]
                    half *= 2

    return map_columns(long_docs, ["doc_id", "key", "words"],
                       "doc_id long, key long, half long, base long, ids binary", run, rows=1)


def solve_tiles(tiles: DataFrame) -> DataFrame:
    """doc_id, key, period, lo, hi of tile rows, dealt over all tasks."""
    def run(slices: Iterator[list]) -> Iterator[list]:
        for doc_ids, keys, halves, bases, raws in slices:
            for doc_id, key, half, base, raw in zip(doc_ids, keys, halves, bases, raws):
                ids = np.frombuffer(raw, "<i4").astype(np.int64)
                h, size = word_hashes(ids), 1
                while size < half:
                    h, size = twice_as_long(h, size), 2 * size
                found = merged((0, *x) for x in octave_fragments(ids, h, half))
                if found:
                    _, period, lo, hi = zip(*found)
                    yield [[doc_id] * len(found), [key] * len(found), list(period), [base + x for x in lo],
                           [base + x for x in hi]]

    dealt = tiles.repartition("doc_id", "key", "half", "base")
    return map_columns(dealt, ["doc_id", "key", "half", "base", "ids"],
                       "doc_id long, key long, period long, lo long, hi long", run, rows=8)


def stitch(fragments: DataFrame) -> DataFrame:
    """doc_id, key, start, length, period: the runs that fragments make together."""
    owner = ["doc_id", "key"]
    # equal rows of the table bring equal fragments: they meet before the sort
    once = fragments.groupBy(*owner, "period", "lo").agg(F.max("hi").alias("hi"))
    along = W.partitionBy(*owner, "period").orderBy("lo")
    reach = F.max("hi").over(along.rowsBetween(W.unboundedPreceding, -1))
    islands = (once.withColumn("_new", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("int"))
               .withColumn("_island", F.sum("_new").over(along)))
    whole = (islands.groupBy(*owner, "period", "_island").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
             .withColumn("length", F.col("hi") - F.col("start") + F.col("period"))
             .filter(F.col("length") >= F.greatest(F.lit(MIN_LENGTH), F.lit(MIN_EXPONENT) * F.col("period"))))
    return whole.groupBy(*owner, "start", "length").agg(F.min("period").alias("period"))


def kept_words(tokens: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words outside every run's repetitions; ``runs``: (start, length, period)."""
    keep = np.ones(len(tokens), bool)
    for start, length, period in runs:
        keep[start + period: start + length] = False
    return [w for w, k in zip(tokens, keep.tolist()) if k]


def periodic_runs(docs: DataFrame, rule: Rule | None = None, whole_words: int = WHOLE_WORDS,
                  tile_words: int = TILE_WORDS) -> DataFrame:
    """doc_id, n_words, n_runs, runs (array of start, length, period in order), collapsed (text without the
    repetitions, single-spaced; null where the document has no run and keeps all its words), collapsed_sha256; one row
    per row of ``docs``.

    ``rule`` may change a document's words before the search.
    """
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/runs-{uuid.uuid4().hex}"
    solved = land(solve_documents(docs, rule, whole_words), folder)
    near = solved.select("doc_id", "key", F.explode("fragments").alias("f")).select("doc_id", "key", "f.*")
    far = solve_tiles(explode_tiles(solved.filter("fragments IS NULL").select("doc_id", "key", "words"), tile_words))
    runs = (stitch(near.union(far)).groupBy("doc_id", "key")
            .agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
            .withColumnsRenamed({"doc_id": "_doc", "key": "_key"}))
    some = solved.filter("words IS NOT NULL").select("doc_id", "key", "n_words", "words")
    met = some.join(runs, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")

    def collapse(slices: Iterator[list]) -> Iterator[list]:
        for doc_ids, ns, joined, found in slices:
            found = [[(r["start"], r["length"], r["period"]) for r in f or []] for f in found]
            kept = [b" ".join(kept_words(w.split(), f)) for w, f in zip(joined, found)]
            yield [doc_ids, ns, [[dict(zip(("start", "length", "period"), r)) for r in f] for f in found],
                   [k.decode("utf-8", "replace") if f else None for k, f in zip(kept, found)],
                   [hashlib.sha256(k).hexdigest() for k in kept]]

    shape = "array<struct<start: long, length: long, period: long>>"
    out = map_columns(met, ["doc_id", "n_words", "words", "runs"],
                      f"doc_id long, n_words long, runs {shape}, collapsed string, collapsed_sha256 string", collapse)
    none = solved.filter("words IS NULL").select(
        "doc_id", "n_words", F.array().cast(shape).alias("runs"), F.lit(None).cast("string").alias("collapsed"),
        F.col("plain_sha256").alias("collapsed_sha256"))
    return out.union(none).withColumn("n_runs", F.size("runs").cast("long"))


def planted(doc_id: int | None, tokens: list[bytes]) -> list[bytes]:
    """The contract's planted repetition: every tenth document (by checksum of its number) repeats a stretch to its end."""
    if doc_id is None or not tokens:
        return tokens
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return tokens
    n, g = len(tokens), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return tokens[:a] + (tokens[a: a + p] * ((n - a) // p + 1))[: n - a]


def best_run(runs: list) -> tuple[int, int, int] | None:
    """(start, length, period) of greatest exponent, then least start, then least period."""
    return min(((r["start"], r["length"], r["period"]) for r in runs),
               key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its runs' number and digest, the strongest run, and the digest of the text without repetitions."""
    found = periodic_runs(table(spark, sf_dir, "documents"), planted)

    def digest(slices: Iterator[list]) -> Iterator[list]:
        for doc_ids, counts, runs, collapsed in slices:
            best = [best_run(r) or (None, None, None) for r in runs]
            listed = ["".join(f"{x['start']},{x['length']},{x['period']}\n" for x in r) for r in runs]
            yield [doc_ids, counts, *map(list, zip(*best)), [b[0] if b[0] is None else 1000 * b[1] // b[2] for b in best],
                   [hashlib.sha256(x.encode()).hexdigest() for x in listed], collapsed]

    return map_columns(found, ["doc_id", "n_runs", "runs", "collapsed_sha256"],
                       "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                       "runs_sha256 string, collapsed_sha256 string", digest)
