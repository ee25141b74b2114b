"""Running streams: bounded drains and idempotent batch sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..session import work_dir


def drain(stream: DataFrame, name: str, mode: str = "append", **options) -> DataFrame:
    """Run a finite stream to its end into a table and read the table back."""
    spark = stream.sparkSession
    path, checkpoint = work_dir(spark, name), work_dir(spark, f"{name}-progress")
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .options(**options)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, name: str, handle) -> None:
    """Run a finite stream to its end through ``handle(batch, batch_id)``."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", work_dir(stream.sparkSession, f"{name}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


class BatchTable:
    """A table written one folder per micro-batch.

    A batch that is run again after a failure overwrites its own folder, so every row is
    kept exactly once and no micro-batch rewrites what earlier ones stored.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch handler: append."""
        self._put(batch, batch_id)

    def upsert_sink(self, key: str, version: list[str]):
        """foreachBatch handler: the newest row per key of the batch."""

        def handle(batch: DataFrame, batch_id: int) -> None:
            self._put(newest_per_key(batch, key, version), batch_id)

        return handle

    def _put(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, batches: list[int] | None = None) -> DataFrame:
        """All rows, or those of some batches, with the ``batch`` they came in."""
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        if batches is None:
            return self.spark.read.schema(schema).parquet(self.path)
        if not batches:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/batch={b}" for b in batches]
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders)

    def stream(self, **options) -> DataFrame:
        """The rows of each micro-batch as they come."""
        return self.spark.readStream.schema(self.schema).options(recursiveFileLookup="true", **options).parquet(self.path)

    def current(self, key: str, version: list[str]) -> DataFrame:
        """Merge on read: per key the newest row, of equals the one that came last."""
        return newest_per_key(self.read(), key, [*version, "batch"]).drop("batch")

    def compact(self, key: str, version: list[str], path: str) -> "BatchTable":
        """The current rows as a fresh table in ``path``, to be continued at a later batch."""
        self.current(key, version).write.mode("overwrite").parquet(f"{path}/batch=-1")
        return BatchTable(self.spark, path, self.schema)


def newest_per_key(rows: DataFrame, key: str, version: list[str]) -> DataFrame:
    columns = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*columns), F.struct(*version))
    return rows.groupBy(key).agg(best.alias("row")).select(key, "row.*").select(*rows.columns)
