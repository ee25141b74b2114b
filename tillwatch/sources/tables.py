"""Reading and writing ledger tables, feature files and message topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..schemas import FEATURE_ROW

# The columns the profile job reads from the two tables.
TRANSACTION_COLUMNS = [
    "id",
    "amount",
    "sender_account_id",
    "receiver_account_id",
    "latitude",
    "longitude",
    "created_at",
    "is_fraud",
    "fraud_type",
]
ACCOUNT_COLUMNS = ["id", "account_number", "created_at"]


def read_table(
    spark: SparkSession, source: str, schema: T.StructType | None = None, fmt: str = "parquet", **options
) -> DataFrame:
    """A file table (parquet, orc, json, csv) with a declared schema."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(source)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 64,
    **options,
) -> DataFrame:
    """A database table, read in parallel ranges of ``partition_column``."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column is not None:
        low, high = bounds
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(low))
            .option("upperBound", str(high))
            .option("numPartitions", str(partitions))
        )
    return reader.load()


def transactions(table: DataFrame) -> DataFrame:
    return table.select(*TRANSACTION_COLUMNS)


def accounts(table: DataFrame) -> DataFrame:
    return table.select(*ACCOUNT_COLUMNS)


def by_time(df: DataFrame, column: str = "created_at") -> DataFrame:
    """Global time order for output; a range shuffle, so only asked for when writing."""
    return df.orderBy(column)


def read_feature_csv(spark: SparkSession, path: str, schema: T.StructType = FEATURE_ROW) -> DataFrame:
    """The labelled feature file, with its schema declared rather than inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def as_feature_rows(features: DataFrame) -> DataFrame:
    """A profile cast to the declared feature-row schema, as written to files and tables."""
    return features.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FEATURE_ROW])


def write_feature_table(features: DataFrame, path: str) -> None:
    """Replace the feature table."""
    as_feature_rows(features).write.mode("overwrite").parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 20_000, **options) -> None:
    """Replace a database table, ``batch`` rows per insert on every writer."""
    (
        df.write.format("jdbc")
        .mode("overwrite")
        .option("url", url)
        .option("dbtable", table)
        .option("batchsize", str(batch))
        .options(**options)
        .save()
    )


def write_feature_csv(features: DataFrame, path: str) -> None:
    as_feature_rows(features).write.mode("overwrite").option("header", True).csv(path)


def write_metrics_json(scores: DataFrame, path: str) -> None:
    """One line per model: {"model": ..., "roc_auc": ..., "pr_auc": ...}; a few rows."""
    scores.coalesce(1).write.mode("overwrite").json(path)


def write_threshold_csv(table: DataFrame, path: str) -> None:
    """The threshold table in ascending order, as ordered part files."""
    ordered = table.orderBy("position").drop("position")
    ordered.write.mode("overwrite").option("header", True).csv(path)


# --- message topics ----------------------------------------------------------------


def topic_stream(
    spark: SparkSession, servers: str, topic: str, starting: str = "earliest", **options
) -> DataFrame:
    """A Kafka topic as (key, value) text; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .options(**options)
        .load()
    )
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"))


def line_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None, **options) -> DataFrame:
    """A folder of JSON lines as a stream of (value); stands in for a topic."""
    reader = spark.readStream.format("text").options(**options)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def topic_writer(messages: DataFrame, servers: str, topic: str, checkpoint: str):
    """Stream (key, value) to a Kafka topic, acknowledged by all replicas."""
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("kafka.retries", "3")
        .option("kafka.linger.ms", "10")
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )


def upsert_messages(rows: DataFrame, key: str) -> DataFrame:
    """Keyed JSON messages: the key object and the whole row."""
    return rows.select(
        F.to_json(F.struct(key)).alias("key"),
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"),
    )
