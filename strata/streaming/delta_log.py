"""State tables of a ``foreachBatch`` job as a log of deltas, merged level by level.

A batch writes one delta: the keys it decides about and their rows in each table.  A key without rows is deleted.  What a
table holds for a key is what the newest delta that names the key has for it.  Bytes written by a batch follow its
change, not the state.

Deltas of one level are merged into one of the next when there are ``fanout`` of them; each keeps only its newest
rows, and the merge that includes the oldest delta forgets deleted keys.  So a row is written again once for each
level, and at most ``fanout`` deltas of each level are in use.

Every delta and merge is a new folder; a batch publishes last, by the manifest of its epoch: the deltas in use (a
few rows).  A crash before that leaves folders that no manifest names.  A reopened job reads the newest whole manifest;
a replayed batch starts from the newest one *before* its epoch, so running it again gives the same state.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strata.operators.positions import null_safe_join

SEED_EPOCH = -1
FANOUT = 8
_MANIFEST = "first long, last long, level int, folder string"


class DeltaLog:
    """``keys``: DDL of the key columns; ``tables``: name -> (DDL of its rows, its columns that hold the key)."""

    def __init__(self, spark: SparkSession, root: str, keys: str, tables: dict[str, tuple[str, list[str]]], fanout: int = FANOUT):
        self.spark, self.root, self.key_ddl, self.tables, self.fanout = spark, root.rstrip("/"), keys, tables, fanout
        self.keys = spark.createDataFrame([], keys).columns

    # -- manifests

    def _epochs(self) -> list[int]:
        """Epochs whose manifest is whole."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        fs = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(folder):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(folder)]
        return [int(n.split("=")[1]) for n in found if n.startswith("epoch=")
                and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/{n}/_SUCCESS"))]

    def newest(self, before: int | None = None) -> list[Row] | None:
        """Deltas of the newest published state (below epoch ``before``), oldest first; None if there is none."""
        epochs = [e for e in self._epochs() if before is None or e < before]
        if not epochs:
            return None
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/epoch={max(epochs)}").collect()
        return sorted(rows, key=lambda r: r["first"])

    # -- reading

    def _part(self, delta: Row, name: str) -> DataFrame:
        ddl = self.key_ddl if name == "keys" else self.tables[name][0]
        return self.spark.read.schema(ddl).parquet(f"{delta['folder']}/{name}").withColumn("_delta", F.lit(delta["last"]).cast("long"))

    def read(self, name: str, deltas: list[Row] | None, only: DataFrame | None = None) -> DataFrame:
        """Current rows of a table, or those of the keys ``only``."""
        ddl, columns = self.tables[name]
        if not deltas:
            return self.spark.createDataFrame([], ddl)
        rows = reduce(DataFrame.unionByName, (self._part(d, name) for d in deltas))
        if len(deltas) > 1 or only is not None:
            named = reduce(DataFrame.unionByName, (self._part(d, "keys") for d in deltas))
            if only is not None:
                named = null_safe_join(named, only, self.keys, "left_semi")
            owner = named.groupBy(*self.keys).agg(F.max("_delta").alias("_delta"))
            rows = null_safe_join(rows, owner.withColumnsRenamed(dict(zip(self.keys, columns))), [*columns, "_delta"], "left_semi")
        return rows.drop("_delta")

    # -- writing

    def _write(self, level: int, first: int, last: int, keys: DataFrame, tables: dict[str, DataFrame]) -> Row:
        folder = f"{self.root}/level={level}/{first}-{last}-{uuid.uuid4().hex}"
        keys.select(*self.keys).distinct().write.parquet(f"{folder}/keys")
        for name, table in tables.items():
            table.write.parquet(f"{folder}/{name}")
        return Row(first=first, last=last, level=level, folder=folder)

    def _merged(self, deltas: list[Row], oldest: bool) -> Row:
        tables = {name: self.read(name, deltas) for name in self.tables}
        if oldest:  # nothing older is hidden by a deleted key
            keys = reduce(DataFrame.union, (t.select(*self.tables[n][1]) for n, t in tables.items())).toDF(*self.keys)
        else:
            keys = reduce(DataFrame.unionByName, (self._part(d, "keys") for d in deltas))
        return self._write(deltas[0]["level"] + 1, deltas[0]["first"], deltas[-1]["last"], keys, tables)

    def append(self, epoch: int, base: list[Row] | None, keys: DataFrame, tables: dict[str, DataFrame]) -> None:
        """Publishes ``base`` and a delta: ``keys`` now have just the rows of ``tables``."""
        deltas = [*(base or []), self._write(0, epoch, epoch, keys, tables)]
        level = 0
        while len(full := [d for d in deltas if d["level"] == level]) >= self.fanout:
            rest = [d for d in deltas if d["level"] != level]
            deltas = sorted([*rest, self._merged(full, full[0] == deltas[0])], key=lambda d: d["first"])
            level += 1
        self.spark.createDataFrame([tuple(d) for d in deltas], _MANIFEST).coalesce(1).write.mode("overwrite") \
            .parquet(f"{self.root}/manifest/epoch={epoch}")
