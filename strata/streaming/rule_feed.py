"""Rule change feed as a stream: each micro-batch is folded into the catalogue.

``apply_rule_changes`` composes across batches (last value wins per field,
toggle parity restarts at a set value, delete is final), so folding batch by
batch with ``foreachBatch`` gives the same catalogue as folding the whole
feed at once.  The catalogue lives in a ``DeltaLog`` under the shared
checkpoint directory: a batch writes the rules it changes, and a replayed batch or a
reopened job gives the same catalogue.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strata.operators.catalogue import apply_rule_changes
from strata.session import checkpoint_dir
from strata.streaming.delta_log import SEED_EPOCH, DeltaLog


class RuleFeed:
    def __init__(self, spark: SparkSession, catalogue: DataFrame, root: str | None = None):
        """``catalogue`` seeds a new root; on a root that has one published, that one goes on."""
        self.spark = spark
        self.root = root or f"{checkpoint_dir(spark).rstrip('/')}/rule-feed-{uuid.uuid4().hex}"
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in catalogue.schema)
        self.state = DeltaLog(spark, self.root, "rule_id string", {"catalogue": (schema, ["rule_id"])})
        if self.state.newest() is None:
            self.state.append(SEED_EPOCH, None, catalogue, {"catalogue": catalogue})

    def catalogue(self, before: int | None = None) -> DataFrame:
        return self.state.read("catalogue", self.state.newest(before))

    def _batch(self, changes: DataFrame, epoch: int) -> None:
        base, touched = self.state.newest(before=epoch), changes.select("rule_id").distinct()
        changed = apply_rule_changes(self.state.read("catalogue", base, touched), changes)
        self.state.append(epoch, base, touched, {"catalogue": changed.join(touched, "rule_id", "left_semi")})

    def run(self, stream: DataFrame) -> DataFrame:
        q = (stream.writeStream.foreachBatch(self._batch)
             .option("checkpointLocation", f"{self.root}/_checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
        return self.catalogue()
