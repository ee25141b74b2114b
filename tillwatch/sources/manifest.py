"""Tables by manifest: a version names the folders of every table, and is published by one file.

Writers put new folders beside the old ones and publish a version that names them; readers take the newest version, or one
they hold on to, and see its folders whatever is written meanwhile.  A version is a folder with a single file, which the
write either shows or doesn't; two writers of the same version can't both succeed.  Folders that no version in use
names may be removed by whoever runs the store: that needs a file system's own tools and isn't done here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..operators.history import RECEIVER
from ..operators.maintenance import clear_senders
from ..streaming.runs import newest_per_key

ENTRY = T.StructType(
    [T.StructField("table", T.StringType()), T.StructField("folder", T.StringType()), T.StructField("batch", T.LongType())]
)


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def create(self) -> None:
        self._write([], 0)

    def versions(self) -> DataFrame:
        schema = T.StructType([*ENTRY.fields, T.StructField("version", T.LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/manifest")

    def current(self) -> int:
        return self.versions().agg(F.max("version")).first()[0]

    def entries(self, version: int) -> list[tuple[str, str, int]]:
        """(table, folder, batch) of a version: as many rows as there are folders in use."""
        found = self.versions().where((F.col("version") == version) & F.col("table").isNotNull())
        return [(r["table"], r["folder"], r["batch"]) for r in found.orderBy("batch").collect()]

    def publish(self, entries: list[tuple[str, str, int]], after: int) -> int:
        """The version that follows ``after``; fails if another writer was first."""
        self._write(entries, after + 1)
        return after + 1

    def _write(self, entries: list, version: int) -> None:
        # An empty version has a row without a table, so that its file tells its number.
        rows = self.spark.createDataFrame(entries or [(None, None, None)], ENTRY).coalesce(1)
        rows.write.mode("errorifexists").parquet(f"{self.root}/manifest/version={version}")

    def stage(self, rows: DataFrame, table: str) -> str:
        folder = f"{self.root}/{table}/{uuid.uuid4().hex[:12]}"
        rows.write.parquet(folder)
        return folder


class CompactingTable:
    """A sink of micro-batches whose folders are merged into one snapshot after every ``every`` of them.

    A batch that comes again after it was published is left out; one that was written but not published is written anew.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, version: list[str], every: int = 16):
        self.manifest, self.schema = Manifest(spark, root), schema
        self.key, self.order, self.every = key, version, every

    def create(self) -> None:
        self.manifest.create()

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch handler."""
        at = self.manifest.current()
        entries = self.manifest.entries(at)
        if any(b >= batch_id for _, _, b in entries):
            return
        rows = newest_per_key(batch.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]), self.key, self.order)
        entries.append(("rows", self.manifest.stage(rows.withColumn("batch", F.lit(batch_id).cast("long")), "batches"), batch_id))
        at = self.manifest.publish(entries, at)
        if len(entries) > self.every:
            whole = newest_per_key(self.rows(at), self.key, [*self.order, "batch"])
            self.manifest.publish([("rows", self.manifest.stage(whole, "snapshots"), batch_id)], at)

    def rows(self, version: int) -> DataFrame:
        """What the folders of a version hold, with the ``batch`` each row came in."""
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        folders = [folder for _, folder, _ in self.manifest.entries(version)]
        spark = self.manifest.spark
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def current(self, version: int | None = None) -> DataFrame:
        """The newest row per key as of a version; the newest version if none is named."""
        at = self.manifest.current() if version is None else version
        return newest_per_key(self.rows(at), self.key, [*self.order, "batch"]).drop("batch")


class LedgerStore:
    """Accounts and transactions that change together: a statement publishes one version of both or none."""

    def __init__(self, spark: SparkSession, root: str, accounts: T.StructType, transactions: T.StructType):
        self.manifest = Manifest(spark, root)
        self.schemas = {"accounts": accounts, "transactions": transactions}

    def create(self, accounts: DataFrame, transactions: DataFrame) -> None:
        self.manifest.create()
        self._publish(0, accounts=accounts, transactions=transactions)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        at = self.manifest.current() if version is None else version
        folder = next(f for t, f, _ in self.manifest.entries(at) if t == table)
        return self.manifest.spark.read.schema(self.schemas[table]).parquet(folder)

    def delete_users(self, doomed: Column) -> bool:
        """Users go with all their accounts, and what those sent loses its sender.

        ``doomed`` says which accounts' users go.  If one of the accounts has received money, which keeps it, the whole
        statement is refused and nothing changes.
        """
        at = self.manifest.current()
        accounts, transactions = self.read("accounts", at), self.read("transactions", at)
        gone = accounts.where(F.coalesce(doomed, F.lit(False))).select("id")
        if not transactions.join(gone, F.col(RECEIVER) == gone["id"], "left_semi").isEmpty():
            return False
        self._publish(at, accounts=accounts.join(gone, "id", "left_anti").select(*accounts.columns), transactions=clear_senders(transactions, gone))
        return True

    def delete_received(self, doomed: Column) -> bool:
        """The transactions that the accounts ``doomed`` names have received go."""
        at = self.manifest.current()
        transactions = self.read("transactions", at)
        to = self.read("accounts", at).where(F.coalesce(doomed, F.lit(False))).select(F.col("id").alias(RECEIVER))
        self._publish(at, transactions=transactions.join(to, RECEIVER, "left_anti").select(*transactions.columns))
        return True

    def _publish(self, at: int, **tables: DataFrame) -> None:
        kept = [e for e in self.manifest.entries(at) if e[0] not in tables]
        self.manifest.publish([*kept, *[(t, self.manifest.stage(rows, t), 0) for t, rows in tables.items()]], at)
