"""Append-only tables for micro-batches.

Every batch writes its own partition and may overwrite only that one, so a batch repeated after a failure leaves the
same rows. A batch reads what earlier batches wrote, never its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sightline.scale import latest

BATCH = "batch"


class BatchTable:
    """A Parquet folder with one partition per micro-batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType):
        self.spark, self.path = spark, path
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those before a batch id (partition-pruned)."""
        full = T.StructType([*self.schema.fields, T.StructField(BATCH, T.LongType())])
        if not self._exists():
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).parquet(self.path)
        return rows if before is None else rows.where(F.col(BATCH) < before)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        rows.select(*columns, F.lit(batch_id).cast("bigint").alias(BATCH)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(BATCH).parquet(self.path)

    def current(self, keys: Sequence[str], before: int | None = None, order: Sequence[str] = (BATCH,)) -> DataFrame:
        """The last row per key."""
        return latest(self.read(before), list(keys), list(order))

    def compact(self, path: str, keys: Sequence[str], order: Sequence[str] = (BATCH,)) -> "BatchTable":
        """The last row per key as a new table; readers move over once it is complete."""
        out = BatchTable(self.spark, path, self.schema)
        self.current(keys, order=order).write.mode("overwrite").partitionBy(BATCH).parquet(path)
        return out


def poll(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, interval_seconds: int | None = None,
    name: str | None = None, output_mode: str = "append",
) -> StreamingQuery:
    """Starts a feed loop: every interval (at least a minute) new files go through ``handle(batch, batch_id)``.

    Without an interval everything available is processed and the query ends.
    """
    writer = stream.writeStream.outputMode(output_mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if interval_seconds is None:
        return writer.trigger(availableNow=True).start()
    if interval_seconds < 60:
        raise ValueError("a feed is polled at most once a minute")
    return writer.trigger(processingTime=f"{interval_seconds} seconds").start()
