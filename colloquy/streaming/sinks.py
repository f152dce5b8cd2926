"""Sinks for ``foreachBatch`` that a repeated batch can't change: what is written carries the number of its batch.

A query that stops between two writes runs its last batch again from the
checkpoint, with the same number; it then replaces what it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def append_once(batch: DataFrame, number: int, path: str) -> None:
    """Appends a batch in a folder of its own; the same number replaces it, and other batches stay as they are."""
    rows = batch.withColumn("_batch", F.lit(number))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)


class LatestTable:
    """Rows by key of which the last written counts: batches are appended, and a reader takes the newest row of each key.

    An upsert costs its batch and not the table. ``compact`` folds all batches up to now into a new base, in a
    folder of its own that counts from the moment it is complete (Spark's mark of success); what it replaces
    goes one compaction later, so that readers under way keep their files. A row with ``_deleted`` removes its key.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, order: str | None = None):
        self.spark, self.path, self.keys, self.schema, self.order = spark, path.rstrip("/"), keys, schema, order

    def _files(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, folder: str, name: str, complete: bool) -> list[int]:
        fs, path = self._files(), self.spark._jvm.org.apache.hadoop.fs.Path
        if not fs.exists(path(f"{self.path}/{folder}")):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/{folder}"))]
        return sorted(int(f.split("=")[1]) for f in found if f.startswith(f"{name}=") and (not complete or fs.exists(path(f"{self.path}/{folder}/{f}/_SUCCESS"))))

    def write(self, batch: DataFrame, number: int) -> None:
        """Upserts a batch; of rows with one key, the last by ``order`` counts."""
        marked = batch if "_deleted" in batch.columns else batch.withColumn("_deleted", F.lit(False))
        if self.order:
            rest = F.struct(*(c for c in marked.columns if c not in self.keys))
            marked = marked.groupBy(*self.keys).agg(F.max_by(rest, self.order).alias("_r")).select(*self.keys, "_r.*")
        append_once(marked, number, f"{self.path}/batches")

    def rows(self) -> DataFrame:
        """The table as it is now."""
        return self._newest().filter(~F.col("_deleted")).drop("_deleted", "_batch")

    def _newest(self) -> DataFrame:
        bases, names = self._numbers("bases", "base", True), T.StructType.fromDDL(self.schema).names
        parts, whole = [], f"{self.schema}, _deleted boolean, _batch long"
        if bases:
            parts.append(self.spark.read.schema(whole).parquet(f"{self.path}/bases/base={bases[-1]}"))
        if self._numbers("batches", "_batch", False):
            found = self.spark.read.schema(whole).parquet(f"{self.path}/batches")
            parts.append(found.filter(F.col("_batch") > bases[-1]) if bases else found)
        if not parts:
            return self.spark.createDataFrame([], whole)
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        rest = [c for c in names if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest, "_deleted", "_batch"), "_batch").alias("_r")).select(*self.keys, *(f"_r.{c}" for c in [*rest, "_deleted", "_batch"]))

    def compact(self) -> None:
        batches, bases = self._numbers("batches", "_batch", False), self._numbers("bases", "base", True)
        if not batches or (bases and batches[-1] <= bases[-1]):
            return
        # rows keep the number of their batch, deleted keys go
        self._newest().filter(~F.col("_deleted")).write.mode("overwrite").parquet(f"{self.path}/bases/base={batches[-1]}")
        fs, path = self._files(), self.spark._jvm.org.apache.hadoop.fs.Path
        if bases:
            for number in [b for b in batches if b <= bases[-1]]:
                fs.delete(path(f"{self.path}/batches/_batch={number}"), True)
            for number in bases[:-1]:
                fs.delete(path(f"{self.path}/bases/base={number}"), True)


def each_batch(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = 15, mode: str = "append") -> StreamingQuery:
    """Starts a stream whose batches go to ``write`` with their numbers: every so many seconds, or (None) what is there now."""
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def upsert_all(*targets: tuple[LatestTable, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A ``write`` that sends each batch to several tables, one after the other: a stop between them is mended by the repeated batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for table, rows in targets:
                table.write(rows(batch), number)
        finally:
            batch.unpersist()

    return write
