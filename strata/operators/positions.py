"""Positions inside groups of any size, and joins on keys that may be null.

``row_number()`` over a whole group (say a repository holding a third of all rows) runs in one task.  Here
the rows are range-partitioned by (group, order) from sampled bounds, so a large group spans many
partitions and the partitions follow one another in order.  Rows are numbered inside each (partition, group);
the counts per partition give every partition its offset by an exclusive running sum, and offset plus inner number is
the position.  A window holds one partition's rows of a group, or one row per partition, never a whole
group.

The dealt rows are written once: a second evaluation could sample other bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.session import land


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where a null equals a null; the keys are kept once, from ``left``."""
    names = {c: f"_right_{i}_{c}" for i, c in enumerate(on)}
    other = right.withColumnsRenamed(names)
    condition = None
    for c, renamed in names.items():
        same = left[c].eqNullSafe(other[renamed])
        condition = same if condition is None else condition & same
    return left.join(other, condition, how).drop(*names.values())


def positions(df: DataFrame, group: list[str], order: list[Column], out: str = "position") -> DataFrame:
    """Add ``out`` = 1-based position within ``group`` by ``order``.

    Rows that agree in ``order`` come in some order; the caller breaks ties where it matters.  A null is a group
    like others, and rows with null order keys keep their row.
    """
    return sequenced(df, group, order, out)


def sequenced(df: DataFrame, group: list[str], order: list[Column], out: str = "position",
              sums: dict[str, Column] | None = None, neighbours: tuple[str, ...] = ()) -> DataFrame:
    """``positions``, with running totals up to and with each row (``sums``: name to summand), and the values that the
    rows before and after it have in the columns ``neighbours`` (as ``previous_x`` and ``next_x``, null at the ends)."""
    sums = sums or {}
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows that agree in everything are dealt over partitions too
    numbered = df.select("*", *[c.alias(f"_add_{name}") for name, c in sums.items()], F.monotonically_increasing_id().alias("_tie"))
    dealt = numbered.repartitionByRange(partitions, *[F.col(g) for g in group], *order, F.col("_tie"))
    landed = land(dealt.withColumn("_part", F.spark_partition_id()), "positions")
    inner = Window.partitionBy("_part", *group).orderBy(*order, F.col("_tie"))
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    within = landed.select("*", F.row_number().over(inner).alias("_inner"),
                           *[F.sum(f"_add_{name}").over(upto).alias(f"_run_{name}") for name in sums],
                           *[f(c).over(inner).alias(f"_{side}_{c}") for c in neighbours for side, f in (("lag", F.lag), ("lead", F.lead))])
    whole = within if neighbours else landed
    counts = whole.groupBy("_part", *group).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_add_{name}").alias(f"_all_{name}") for name in sums],
        *[f(c, "_inner").alias(f"_{side}_{c}") for c in neighbours for side, f in (("first", F.min_by), ("last", F.max_by))])
    parts = Window.partitionBy(*group).orderBy("_part")  # a row for every partition that the group reaches
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", *group, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_off{c}") for c in ("_n", *[f"_all_{n}" for n in sums])],
        *[F.lag(f"_last_{c}").over(parts).alias(f"_before_{c}") for c in neighbours],
        *[F.lead(f"_first_{c}").over(parts).alias(f"_after_{c}") for c in neighbours])
    size = F.count(F.lit(1)).over(inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = null_safe_join(within.withColumn("_size", size) if neighbours else within, offsets, ["_part", *group])
    return met.select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_off_n") + F.col("_inner")).cast("long").alias(out),
        *[(F.col(f"_off_all_{name}") + F.col(f"_run_{name}")).alias(name) for name in sums],
        *[F.when(F.col("_inner") == 1, F.col(f"_before_{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"previous_{c}") for c in neighbours],
        *[F.when(F.col("_inner") == F.col("_size"), F.col(f"_after_{c}")).otherwise(F.col(f"_lead_{c}")).alias(f"next_{c}") for c in neighbours])
