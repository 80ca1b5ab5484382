"""Keeping counts up to date from rows added and removed, in batch or from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltab.operators.marginals import StatModule
from veiltab.session import Workspace

CELL = ["workload_id", "cell"]


def apply_changes(counts: DataFrame, module: StatModule, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Counts after a change, without reading the unchanged rows; equals a recount."""
    gone = module.counts(removed).withColumn("cnt", -F.col("cnt"))
    parts = counts.select(*CELL, "cnt").unionByName(module.counts(added)).unionByName(gone)
    return parts.groupBy(*CELL).agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")


class MaintainedCounts:
    """``foreachBatch`` target: a stream of encoded rows with a ``removed`` flag updates the counts.

    The counts after each batch are a table of their own under ``path``, named by the batch. A new
    object on the same path goes on from the last complete one, and a batch that is delivered again,
    also after a restart, is recognised by its number. A ``counts`` frame can be read until ``KEEP``
    more batches have come.
    """

    KEEP = 2

    def __init__(self, counts: DataFrame, module: StatModule, path: str | None = None):
        self.module, self.spark = module, counts.sparkSession
        self.path = path or Workspace(self.spark, "counts").path
        self._root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = self._done()
        self.last_batch = max(done, default=-1)
        if not done:
            counts.select(*CELL, "cnt").write.mode("overwrite").parquet(self._folder(-1))

    def _folder(self, batch_id: int) -> str:
        return f"{self.path}/after-{batch_id + 1:012d}"

    def _done(self) -> list[int]:
        """Batches whose table is complete."""
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        return [int(n[6:]) - 1 for n in names if n.startswith("after-") and self._fs.exists(at(f"{self.path}/{n}/_SUCCESS"))]

    @property
    def counts(self) -> DataFrame:
        return self.spark.read.schema("workload_id int, cell long, cnt long").parquet(self._folder(self.last_batch))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last_batch:
            return
        batch = batch.persist()
        added, removed = batch.where(~F.col("removed")), batch.where("removed")
        changed = apply_changes(self.counts, self.module, added, removed)
        changed.write.mode("overwrite").parquet(self._folder(batch_id))
        self.last_batch = batch_id
        batch.unpersist()
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        for old in sorted(self._done())[: -self.KEEP - 1]:
            self._fs.delete(at(self._folder(old)), True)
