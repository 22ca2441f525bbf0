"""History of single lines: which commits touched a line, followed back through the diffs.

Every commit's diff of a file is a piecewise shift of line numbers: between two change blocks new and old numbers differ
by a constant, and inside a block the line was changed (the block has old lines) or made (it has none).  A request
(file, line) starts at the newest commit and is mapped through one commit after the other, newest first; the
commits whose blocks it meets are its history, and it ends at the block that made it.

Requests and change blocks of a file meet by a shuffle on (repository, file) and are sorted, requests first, then
commits newest first.  One pass holds the open requests of a file and one commit's blocks, and maps all requests
through a commit at once.  A file with many requests is dealt over several tasks, each with its own requests and all of
the file's blocks.  No file's history is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.history import change_type, evolution_chain
from strata.operators.positions import null_safe_join

# A hunk's header: old start[,length], new start[,length].
HUNK_RE = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
# Requests of one file that a task follows.
REQUESTS_AT_ONCE = 20_000

FILE = ["repo_id", "file_path"]
_TOUCHES = "repo_id string, file_path string, line_number long, step int, commit string, ts timestamp, line_at long, made boolean"


def change_blocks(diffs: DataFrame) -> DataFrame:
    """Diff texts ``(repo_id, file_path, commit, ts, diff)`` -> one row per stretch of changed lines.

    ``old_start`` / ``new_start`` are the first line of the stretch on either side, or for an empty side the line
    it would stand before; context lines belong to no stretch.
    """
    commit = [*FILE, "commit", "ts"]
    lines = diffs.select(*commit, F.posexplode(F.split("diff", "\n")).alias("_pos", "_line")).select(
        *commit, "_pos", F.col("_line").rlike(HUNK_RE).alias("_head"), F.substring("_line", 1, 1).alias("_sign"), "_line")
    along = Window.partitionBy(*commit).orderBy("_pos")
    hunks = lines.withColumn("_hunk", F.sum(F.col("_head").cast("int")).over(along)).filter("_hunk > 0")

    def number(group: int) -> F.Column:
        return F.regexp_extract("_line", HUNK_RE, group)

    def begin(group: int) -> F.Column:  # an empty side names the line before it
        return F.when(F.col("_head"), number(group).cast("long") + F.when(number(group + 1) == "0", 1).otherwise(0))

    inside = Window.partitionBy(*commit, "_hunk").orderBy("_pos")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    body = (hunks.withColumn("_old", F.first(begin(1), ignorenulls=True).over(inside)
                             + F.coalesce(F.count_if(~F.col("_head") & F.col("_sign").isin(" ", "-")).over(before), F.lit(0)))
            .withColumn("_new", F.first(begin(3), ignorenulls=True).over(inside)
                        + F.coalesce(F.count_if(~F.col("_head") & F.col("_sign").isin(" ", "+")).over(before), F.lit(0)))
            .withColumn("_island", F.count_if(F.col("_sign") == " ").over(inside))
            .filter(~F.col("_head") & F.col("_sign").isin("+", "-")))
    return body.groupBy(*commit, "_hunk", "_island").agg(
        F.min("_old").alias("old_start"), F.count_if(F.col("_sign") == "-").alias("old_len"),
        F.min("_new").alias("new_start"), F.count_if(F.col("_sign") == "+").alias("new_len")).drop("_hunk", "_island")


class _OpenLines:
    """The requested lines of one file that still have a history to follow."""

    def __init__(self, key: tuple) -> None:
        self.key = key
        self.asked = np.empty(0, np.int64)
        self.at = np.empty(0, np.int64)
        self.steps = np.empty(0, np.int64)

    def ask(self, lines: np.ndarray) -> None:
        self.asked = np.concatenate([self.asked, lines])
        self.at, self.steps = self.asked.copy(), np.zeros(len(self.asked), np.int64)

    def through(self, blocks: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
        """Map the lines through a commit; ``blocks``: old_start, old_len, new_start, new_len by new_start.
        Returns (asked line, step, line in the commit, made) of the lines the commit touched."""
        old_start, old_len, new_start, new_len = blocks.T
        block = np.searchsorted(new_start, self.at, "right") - 1
        near = np.maximum(block, 0)
        hit = (block >= 0) & (self.at < new_start[near] + new_len[near])
        shift = np.concatenate([[0], np.cumsum(old_len - new_len)])[block + 1]
        self.steps += hit
        found = (self.asked[hit], self.steps[hit], self.at[hit], old_len[near][hit] == 0)
        changed = old_start[near] + np.minimum(self.at - new_start[near], old_len[near] - 1)
        self.at = np.where(hit, changed, self.at + shift)
        goes_on = ~(hit & (old_len[near] == 0)) & (self.steps < most)
        self.asked, self.at, self.steps = self.asked[goes_on], self.at[goes_on], self.steps[goes_on]
        return found


def line_touches(requests: DataFrame, blocks: DataFrame, max_commits: int = 20) -> DataFrame:
    """The commits that touched each requested line, newest first (``step`` from 1), at most ``max_commits``.

    ``made`` marks the commit that made the line; ``line_at`` is its number after the commit.
    """
    asked = requests.select(*FILE, F.col("line_number").cast("long").alias("line_number")).distinct()
    pieces = asked.groupBy(*FILE).agg(F.ceil(F.count(F.lit(1)) / REQUESTS_AT_ONCE).alias("_pieces"))
    none = F.lit(None).cast("long")
    left = null_safe_join(asked, pieces, FILE).select(
        *FILE, F.pmod(F.xxhash64("line_number"), F.col("_pieces")).alias("_piece"), F.lit(None).cast("timestamp").alias("ts"),
        F.lit(None).cast("string").alias("commit"), F.col("line_number").alias("a"), none.alias("b"), none.alias("c"), none.alias("d"))
    right = null_safe_join(blocks, pieces, FILE).select(
        *FILE, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)).alias("_piece"), F.col("ts").cast("timestamp").alias("ts"),
        "commit", F.col("old_start").alias("a"), F.col("old_len").alias("b"), F.col("new_start").alias("c"), F.col("new_len").alias("d"))
    dealt = (left.union(right).repartition(*FILE, "_piece")
             .sortWithinPartitions(*FILE, "_piece", F.col("b").isNotNull(), F.col("ts").desc(), F.col("commit").desc(), "c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file: _OpenLines | None = None
        commit, held = None, []  # the commit whose blocks are still coming

        def close() -> Iterator[pd.DataFrame]:
            nonlocal commit, held
            if commit is not None and len(file.asked):
                asked, steps, at, made = file.through(np.concatenate(held), max_commits)
                if len(asked):
                    yield pd.DataFrame({"repo_id": file.key[0], "file_path": file.key[1], "line_number": asked, "step": steps.astype("int32"),
                                        "commit": commit[1], "ts": commit[0], "line_at": at, "made": made})
            commit, held = None, []

        for pdf in batches:
            keys = pdf[[*FILE, "_piece", "ts", "commit"]].astype(object).where(pdf[[*FILE, "_piece", "ts", "commit"]].notna(), None)
            numbers = pdf[["a", "b", "c", "d"]]
            is_block = numbers["b"].notna().to_numpy()
            rows = list(zip(*(keys[c] for c in keys.columns), is_block))
            starts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
            for lo, hi in zip(starts, starts[1:]):
                repo, path, piece, ts, name, block = rows[lo]
                if file is None or file.key != (repo, path, piece):
                    yield from close()
                    file = _OpenLines((repo, path, piece))
                part = numbers.iloc[lo:hi]
                if not block:
                    file.ask(part["a"].to_numpy().astype(np.int64))
                else:
                    if commit != (ts, name):
                        yield from close()
                        commit = (ts, name)
                    held.append(part.to_numpy().astype(np.int64))
        if file is not None:
            yield from close()

    return dealt.mapInPandas(run, _TOUCHES)


def line_history(requests: DataFrame, diffs: DataFrame, commits: DataFrame, max_commits: int = 20) -> DataFrame:
    """Evolution of each requested line ``(repo_id, file_path, line_number)``, newest first.

    The last row is the introduction; a message with refactor / rename / move (so also 'remove') is a refactor.  A
    request that no diff touches (no diffs, or a line the file does not have) gets the file's history instead, as
    ``source`` says.
    """
    touches = line_touches(requests, change_blocks(diffs), max_commits)
    own = null_safe_join(touches, commits.select(*FILE, "commit", "author", "message"), [*FILE, "commit"])
    last = Window.partitionBy(*FILE, "line_number")
    by_line = own.select(
        *FILE, "line_number", "step", F.substring("commit", 1, 8).alias("commit_hash"), "author",
        F.split(F.trim("message"), "\n").getItem(0).alias("message"),
        change_type(F.col("step") == F.max("step").over(last)).alias("change_type"), F.lit("line").alias("source"), "line_at")
    asked = requests.select(*FILE, F.col("line_number").cast("long").alias("line_number")).distinct()
    rest = null_safe_join(asked, by_line.select(*FILE, "line_number").distinct(), [*FILE, "line_number"], "left_anti")
    by_file = null_safe_join(rest, evolution_chain(commits, max_commits), FILE).select(
        *FILE, "line_number", "step", "commit_hash", "author", "message", "change_type", F.lit("file").alias("source"),
        F.lit(None).cast("long").alias("line_at"))
    return by_line.union(by_file)
