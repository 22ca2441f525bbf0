"""What a bounded cache would answer: reuse distances of requests, for every cache size at once.

A least-recently-used cache of C entries answers a request exactly if fewer than C other keys were asked since the
key's last request.  That number, the reuse distance, does not depend on C, so one pass gives the hit rate of every size.

With requests numbered 1, 2, ... and ``previous`` the number of the key's request before (0 if none), the
distance of request t with previous p is the number of requests before t whose own previous lies before p, less p: those
up to p all count, and of the others only a key's first since p does.  This is a dominance count over points (j,
previous of j).  Both axes are cut into stretches of equal length, and what counts for a request is

* points of its own stretch of requests, counted by one task a stretch;
* points of earlier stretches whose previous lies in the same stretch as its own, counted by one task a stretch too;
* points of earlier stretches with previous in an earlier stretch: running sums over the table of both stretches.

No two requests share a previous, so a task holds one stretch at most, and each request moves a fixed number of times.
A stretch is at least the root of the number of requests, so the table has no more cells than there are requests.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.positions import positions, sequenced
from strata.operators.prompts import ratio_3dp
from strata.session import land

# Bits of the least length of a stretch.
STRETCH_BITS = 16


def smaller_before(ranks: np.ndarray) -> np.ndarray:
    """For each place of a permutation of 0, 1, ..., how many earlier places hold a smaller rank."""
    out = np.zeros(len(ranks), np.int64)
    by_rank = np.argsort(ranks)  # places in the order of their ranks
    for level in range(max(len(ranks) - 1, 0).bit_length()):
        # halves of a block of 2^(level+1) places meet: those of the right half count those of the left
        at = by_rank[np.argsort(by_rank >> (level + 1), kind="stable")]
        block, right = at >> (level + 1), (at >> level) & 1 == 1
        left = np.cumsum(~right)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        before = np.repeat(left[starts] - ~right[starts], np.diff(np.r_[starts, len(at)]))
        out[at[right]] += (left - before)[right]
    return out


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Ranks by the keys, the last one first."""
    ranks = np.empty(len(keys[0]), np.int64)
    ranks[np.lexsort(keys)] = np.arange(len(ranks))
    return ranks


def _same_previous(pdf: pd.DataFrame) -> pd.DataFrame:
    """Requests of one stretch of previous: how many of them with smaller previous stand in earlier stretches."""
    pdf = pdf.sort_values("value", ignore_index=True)
    order = pdf["value"].to_numpy()
    pdf["_before"] = smaller_before(_ranks(-order, pdf["stretch"].to_numpy()))
    return pdf[["t", "value", "stretch", "of", "_before"]]


def _same_stretch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Requests of one stretch: how many earlier ones of it have a smaller previous."""
    pdf = pdf.sort_values("t", ignore_index=True)
    t = pdf["t"].to_numpy()
    pdf["_before"] += smaller_before(_ranks(t, pdf["value"].to_numpy()))
    return pdf.loc[pdf["value"] > 0, ["t", "_before"]]


def reuse_distances(requests: DataFrame, order: list[Column], key: str = "request_key") -> DataFrame:
    """key, t (number of the request), distance (null for a key's first request).

    ``order`` must tell requests apart; a null key is a key like others.
    """
    numbered = positions(requests.select(F.col(key).alias("key"), *[o.alias(f"_o{i}") for i, o in enumerate(order)]), [],
                         [F.col(f"_o{i}") for i in range(len(order))], "t").select("key", "t")
    uses = land(sequenced(numbered, ["key"], [F.col("t")], "_nth", neighbours=("t",)).select(
        "key", "t", F.col("previous_t").alias("previous")), "reuse")
    last = int(uses.agg(F.max("t")).first()[0] or 0)
    if not last:
        return uses.select("key", "t", F.col("previous").alias("distance"))
    bits = max(STRETCH_BITS, (last.bit_length() + 1) // 2)
    cell = [F.expr(f"shiftright(t, {bits})").alias("stretch"),
            F.when(F.col("value") > 0, F.expr(f"shiftright(value, {bits})")).otherwise(-1).alias("of")]  # -1: a key's first
    points = uses.select("t", F.coalesce("previous", F.lit(0)).alias("value")).select("t", "value", *cell)
    # points of each cell, then of the cells in earlier stretches, then of those with earlier previous
    held = points.groupBy("stretch", "of").agg(F.count(F.lit(1)).alias("_n"))
    grid = uses.sparkSession.range((last >> bits) + 1).select(
        F.col("id").alias("stretch"), F.explode(F.sequence(F.lit(-1).cast("long"), "id")).alias("of"))

    def earlier(group: str, order: str) -> object:
        return Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    above = (grid.join(held, ["stretch", "of"], "left")
             .select("stretch", "of", F.coalesce(F.sum("_n").over(earlier("of", "stretch")), F.lit(0)).alias("_n"))
             .select("stretch", "of", F.coalesce(F.sum("_n").over(earlier("stretch", "of")), F.lit(0)).alias("_above")))
    shape = "t long, value long, stretch long, of long, _before long"
    crossed = points.filter("value > 0").groupBy("of").applyInPandas(_same_previous, shape).union(
        points.filter("value = 0").select("t", "value", "stretch", "of", F.lit(0).cast("long").alias("_before")))
    summed = crossed.join(above, ["stretch", "of"]).select("t", "value", "stretch", (F.col("_before") + F.col("_above")).alias("_before"))
    before = summed.groupBy("stretch").applyInPandas(_same_stretch, "t long, _before long")
    return uses.join(before, "t", "left").select("key", "t", (F.col("_before") - F.col("previous")).cast("long").alias("distance"))


def cache_hit_rates(distances: DataFrame, sizes: list[int]) -> DataFrame:
    """size (null: unbounded), requests, hits and hit_rate (3 places) for each of ``sizes``."""
    wanted = F.array(*[F.struct(F.lit(s).cast("long").alias("size")) for s in [*sizes, None]])
    hit = F.coalesce(F.when(F.col("s.size").isNull(), F.col("distance").isNotNull()).otherwise(F.col("distance") < F.col("s.size")), F.lit(False))
    # equal distances meet before the sizes multiply them
    spread = distances.groupBy("distance").agg(F.count(F.lit(1)).alias("n")).select("distance", "n", F.explode(wanted).alias("s"))
    agg = spread.groupBy(F.col("s.size").alias("size")).agg(F.sum("n").alias("requests"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits"))
    return agg.select("size", "requests", "hits", ratio_3dp(F.col("hits"), F.col("requests")).alias("hit_rate"))
