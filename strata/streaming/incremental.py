"""Incremental scan as a Structured Streaming job.

New file versions (and deletions) arrive as a stream.  Each micro-batch
(``foreachBatch``) is hashed and compared with the stored snapshot; only added or
modified files are scanned, and issues of modified and deleted files go.  State lives in a
``DeltaLog`` under the shared checkpoint directory: a batch writes the files it changes and no
others, a replayed batch gives the same state, and a job reopened on the same root goes on where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.operators.positions import null_safe_join
from strata.session import checkpoint_dir
from strata.streaming.delta_log import SEED_EPOCH, DeltaLog

FILE = ["repo_id", "path"]
SNAPSHOT = "repo_id string, path string, h string"


class IncrementalScan:
    def __init__(self, spark: SparkSession, scan, issues_schema: str, root: str | None = None,
                 order_col: str | None = None):
        """``scan(files_df) -> issues_df`` is the (batch) scan applied to changed files.

        ``order_col`` tells which of several versions of a path in one batch is the last;
        without it the choice is by content hash, which is at least repeatable.
        """
        self.spark, self.scan, self.issues_schema, self.order_col = spark, scan, issues_schema, order_col
        self.root = root or f"{checkpoint_dir(spark).rstrip('/')}/incremental-{uuid.uuid4().hex}"
        self.state = DeltaLog(spark, self.root, "repo_id string, path string",
                              {"snapshot": (SNAPSHOT, FILE), "issues": (issues_schema, ["repo_id", "file_path"])})

    def seed(self, files: DataFrame, issues: DataFrame) -> None:
        snapshot = files.select("repo_id", "path", F.sha2("content", 256).alias("h"))
        self.state.append(SEED_EPOCH, None, snapshot, {"snapshot": snapshot, "issues": issues})

    def snapshot(self) -> DataFrame:
        return self.state.read("snapshot", self.state.newest())

    def issues(self) -> DataFrame:
        return self.state.read("issues", self.state.newest())

    def _batch(self, batch: DataFrame, epoch: int) -> None:
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        new = batch.select("repo_id", "path", "content", "size", "language", "lines",
                           F.when(~deleted, F.sha2("content", 256)).alias("h"),
                           *([self.order_col] if self.order_col else []))
        order = [F.col(self.order_col).desc()] if self.order_col else []
        last = Window.partitionBy("repo_id", "path").orderBy(*order, F.col("h").desc_nulls_last())
        new = new.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
        base = self.state.newest(before=epoch)
        old = self.state.read("snapshot", base, batch.select(*FILE).distinct()).withColumnRenamed("h", "_oh")
        changed = (null_safe_join(new, old, FILE, "left").filter(~F.col("_oh").eqNullSafe(F.col("h"))).persist())
        try:
            alive = changed.filter(F.col("h").isNotNull())
            issues = self.scan(alive.select("repo_id", "path", "content", "size", "language", "lines"))
            self.state.append(epoch, base, changed.select(*FILE), {"snapshot": alive.select("repo_id", "path", "h"), "issues": issues})
        finally:
            changed.unpersist()

    def run(self, stream: DataFrame) -> DataFrame:
        q = (stream.writeStream.foreachBatch(self._batch)
             .option("checkpointLocation", f"{self.root}/_checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
        return self.issues()
