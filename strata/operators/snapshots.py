"""Snapshots of file trees as digests, compared from the root down.

A snapshot keeps a digest for every file and every directory.  A directory's digest sums up its children (two
64-bit sums of hashes of name and digest, and their number), built level by level from the deepest, so a directory of
any size is an aggregation with map-side combine.  Two snapshots are compared from the roots: only below directories
whose digests differ are children looked at, level by level, and files only in the directories reached.  The comparison
reads no text; building a snapshot reads each text once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.positions import null_safe_join
from strata.session import land

CHILD = ["repo_id", "parent", "name"]


def _totals(*columns: str) -> list[Column]:
    """Number of rows and sums of their hashes, in halves that do not overflow; the rows' order does not matter."""
    out = [F.count(F.lit(1)).alias("_n")]
    for seed in ("a", "b"):
        h = F.xxhash64(F.lit(seed), *columns)
        out += [F.sum(h.bitwiseAND(0xFFFFFFFF)).alias(f"_{seed}_low"), F.sum(F.shiftright(h, 32)).alias(f"_{seed}_high")]
    return out


def _digest() -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("_n", "_a_low", "_a_high", "_b_low", "_b_high")]), 256)


def _digest_of(children: DataFrame) -> DataFrame:
    """repo_id, path (the parents), digest of each directory from its children (repo_id, parent, name, kind, digest)."""
    totals = children.groupBy("repo_id", F.col("parent").alias("path")).agg(*_totals("name", "kind", "digest"))
    return totals.select("repo_id", "path", _digest().alias("digest"))


def _placed(nodes: DataFrame, kind: str) -> DataFrame:
    """Nodes (repo_id, path, digest) with their parent, name and depth; the root is the empty path."""
    cut = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return nodes.select("repo_id", "path", cut.alias("parent"), name.alias("name"), F.lit(kind).alias("kind"), "digest",
                        F.size(F.split("path", "/")).alias("depth"))


def snapshot(files: DataFrame) -> DataFrame:
    """Written table of a snapshot: repo_id, path, parent, name, kind (file / dir), digest, depth (root: 0).

    Of several rows for a path all count; rows without a path are left out.
    """
    texts = files.filter("path IS NOT NULL").select("repo_id", "path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))
    # repeated rows of a path: one file with the digest of all
    once = texts.groupBy("repo_id", "path").agg(F.min("digest").alias("_own"), *_totals("digest"))
    leaves = land(_placed(once.select("repo_id", "path", F.when(F.col("_n") == 1, F.col("_own")).otherwise(_digest()).alias("digest")),
                          "file"), "snapshot-files")
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    levels, below = [leaves], leaves.filter(F.col("depth") == deepest)
    for depth in range(deepest - 1, -1, -1):  # as many rounds as the tree is deep
        dirs = _digest_of(below)
        made = land(dirs.select("repo_id", "path", F.lit("").alias("parent"), F.lit("").alias("name"), F.lit("dir").alias("kind"), "digest",
                                F.lit(0).alias("depth")) if depth == 0 else _placed(dirs, "dir"), "snapshot-dirs")
        levels.append(made)
        below = made.unionByName(leaves.filter(F.col("depth") == depth)) if depth else made
    return reduce(DataFrame.unionByName, levels)


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files added, removed or modified between two ``snapshot`` tables: repo_id, path, change."""
    def level(depth: int, differing: DataFrame | None) -> DataFrame:
        """Nodes of a depth, below the directories that differ, whose digests are not equal."""
        def side(table: DataFrame, name: str) -> DataFrame:
            own = table.filter(F.col("depth") == depth).select("repo_id", "path", "parent", "kind", F.col("digest").alias(name))
            if differing is not None:
                own = null_safe_join(own, differing, ["repo_id", "parent"], "left_semi")
            return own.select("repo_id", "path", "kind", name)

        a, b = side(old, "_old"), side(new, "_new")
        theirs = b.select(F.col("repo_id").alias("_r"), F.col("path").alias("_p"), F.col("kind").alias("_k"), "_new")
        met = a.join(theirs, F.col("repo_id").eqNullSafe(F.col("_r")) & (F.col("path") == F.col("_p")) & (F.col("kind") == F.col("_k")), "full")
        return land(met.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(
            F.when(F.col("path").isNull(), F.col("_r")).otherwise(F.col("repo_id")).alias("repo_id"), F.coalesce("path", "_p").alias("path"),
            F.coalesce("kind", "_k").alias("kind"), "_old", "_new"), "snapshot-diff")

    found, depth, differing = [], 0, None
    while True:
        here = level(depth, differing)
        found.append(here.filter("kind = 'file'"))
        dirs = here.filter("kind = 'dir'")
        if dirs.isEmpty():
            break
        differing, depth = dirs.select("repo_id", F.col("path").alias("parent")), depth + 1
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("modified")
    return reduce(DataFrame.unionByName, found).select("repo_id", "path", change.alias("change"))
