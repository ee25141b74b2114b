"""Tables of micro-batches whose folders merge as digits carry when one counts.

After every ``fan`` folders of a level, one folder of the next level holds their rows; a reader opens at most
``fan - 1`` folders a level, so at most ``(fan - 1) * (1 + log(batches))`` of them, and each row is written again once a level.
Which folders stand for the batches up to one follows from its number alone: nothing has to be published, a batch that
comes again writes the same folders, and what was merged stays readable for it.  Batch numbers follow one another from
0, as those of a stream do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

Folder = tuple[int, int]  # level, last batch


def standing(batch_id: int, fan: int) -> list[Folder]:
    """The folders that together hold the batches up to ``batch_id``, each batch once."""
    left, size, level = batch_id + 1, 1, 0
    while size * fan <= left:
        size, level = size * fan, level + 1
    found, done = [], 0
    while level >= 0:
        while left - done >= size:
            done += size
            found.append((level, done - 1))
        size, level = size // fan, level - 1
    return found


def parts_of(folder: Folder, fan: int) -> list[Folder]:
    """The folders that were merged into this one."""
    level, last = folder
    size = fan ** (level - 1)
    return [(level - 1, last - size * k) for k in range(fan - 1, -1, -1)]


def batches_of(folder: Folder, fan: int) -> range:
    level, last = folder
    return range(last - fan**level + 1, last + 1)


class TieredTable:
    """``merge`` says what a merged folder keeps of its parts' rows (all, if it isn't given).

    With ``key``, folders are cut into ``buckets`` by the key's hash, so a lookup of some keys reads their buckets only.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, fan: int = 8,
        merge: Callable[[DataFrame], DataFrame] | None = None, key: str | None = None, buckets: int = 16,
    ):
        self.spark, self.path, self.schema, self.fan = spark, path, schema, fan
        self.merge, self.key, self.buckets = merge, key, buckets

    def sink(self, rows: DataFrame, batch_id: int) -> None:
        """foreachBatch handler: append, and merge what has become complete."""
        self._put(rows, (0, batch_id))
        level = 1
        while (batch_id + 1) % self.fan**level == 0:
            whole = self.folders(parts_of((level, batch_id), self.fan))
            self._put(self.merge(whole) if self.merge else whole, (level, batch_id))
            level += 1

    def read(self, batch_id: int) -> DataFrame:
        """The rows of the batches up to ``batch_id``, merged as far as they are."""
        return self.folders(standing(batch_id, self.fan))

    def own(self, batch_id: int) -> DataFrame:
        """The rows that one batch brought."""
        return self.folders([(0, batch_id)])

    def lookup(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """Rows up to ``batch_id`` whose key is one of ``keys``' (same column name)."""
        # At most as many numbers as there are buckets.
        hit = [r[0] for r in keys.select(self._bucket().alias("bucket")).distinct().collect()]
        near = self._load(standing(batch_id, self.fan)).where(F.col("bucket").isin(hit)).select(*self.schema.names)
        found = near.join(keys.select(self.key).distinct(), self.key, "left_semi")
        return self.merge(found) if self.merge else found

    def folders(self, chosen: Iterable[Folder]) -> DataFrame:
        return self._load(chosen).select(*self.schema.names)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _place(self, folder: Folder) -> str:
        return f"{self.path}/level={folder[0]}/last={folder[1]}"

    def _load(self, chosen: Iterable[Folder]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())]) if self.key else self.schema
        places = [self._place(f) for f in chosen]
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*places)

    def _put(self, rows: DataFrame, folder: Folder) -> None:
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        if self.key is None:
            rows.write.mode("overwrite").parquet(self._place(folder))
        else:
            rows = rows.withColumn("bucket", self._bucket()).repartition(self.buckets, "bucket")
            rows.write.mode("overwrite").partitionBy("bucket").parquet(self._place(folder))
