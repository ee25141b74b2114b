"""Adapters that present the benchmark tables as a ledger.

``tx_events``  - the main ledger (from ``events``)
``tx_orders``  - a tie-heavy ledger (from ``orders``)
``accounts``   - bank accounts (from ``customer``)

The same mappings are written as SQL text below for the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import ACCOUNT, ACCOUNT_TYPES, FRAUD_TYPES, MONEY, TRANSACTION
from ..session import use_utc
from .cdc import change_lines


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    fraud = (F.col("value") + (F.col("event_id") * 7919) % 60) >= 120
    return e.select(
        F.col("event_id").alias("id"),
        (F.floor(F.col("value") / 10) * 10).cast(MONEY).alias("amount"),
        F.lit("USD").alias("currency"),
        F.concat(F.lit("REF"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("reference"),
        F.col("event_type").alias("description"),
        (F.lit(10.5) + ((F.col("event_id") * 7) % 40).cast("double") / 10).alias("latitude"),
        (F.lit(102.5) + ((F.col("event_id") * 13) % 50).cast("double") / 10).alias("longitude"),
        fraud.alias("is_fraud"),
        F.when(fraud, _pick(FRAUD_TYPES, F.col("event_id") % 6)).alias("fraud_type"),
        ((F.col("event_id") * 31) % 101).cast("int").alias("risk_score"),
        F.col("user_id").alias("sender_account_id"),
        F.get_json_object("props", "$.k").cast("long").alias("receiver_account_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def tx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.floor(F.col("o_totalprice") / 50000) * 50000).cast(MONEY).alias("amount"),
        (F.col("o_custkey") % 50).alias("sender_account_id"),
        (F.col("o_orderkey") % 97).alias("receiver_account_id"),
        F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
        F.lit(False).alias("is_fraud"),
        F.lit(None).cast("string").alias("fraud_type"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    opened = F.timestamp_micros(
        F.lit(1696118400000000) + ((key * 37) % 100) * F.lit(86400000000)
    )
    return c.select(
        key.alias("id"),
        F.concat(F.lit("100000"), F.lpad(key.cast("string"), 8, "0")).alias("account_number"),
        F.col("c_name").alias("account_name"),
        _pick(ACCOUNT_TYPES, key % 4).alias("account_type"),
        F.when(key % 11 == 0, "CLOSED")
        .when(key % 7 == 0, "SUSPENDED")
        .otherwise("ACTIVE")
        .alias("status"),
        F.col("c_acctbal").cast(MONEY).alias("balance"),
        F.lit("USD").alias("currency"),
        F.col("c_nationkey").cast("long").alias("user_id"),
        opened.alias("created_at"),
        opened.alias("updated_at"),
    )


TX_SQL = """tx AS (
  SELECT event_id AS id,
    CAST(floor(value / 10) * 10 AS DECIMAL(18,2)) AS amount,
    'USD' AS currency,
    'REF' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS reference,
    event_type AS description,
    CAST(10.5 AS DOUBLE) + CAST((event_id * 7) % 40 AS DOUBLE) / 10 AS latitude,
    CAST(102.5 AS DOUBLE) + CAST((event_id * 13) % 50 AS DOUBLE) / 10 AS longitude,
    value + (event_id * 7919) % 60 >= 120 AS is_fraud,
    CASE WHEN value + (event_id * 7919) % 60 >= 120 THEN
      CASE event_id % 6 WHEN 0 THEN 'IMMEDIATE_LARGE_TRANSFER'
        WHEN 1 THEN 'MANY_TO_ONE_CONSOLIDATION' WHEN 2 THEN 'MULTIPLE_SAME_AMOUNT'
        WHEN 3 THEN 'VELOCITY_SPIKE' WHEN 4 THEN 'LOCATION_JUMP'
        ELSE 'SLEEP_AND_WAKE' END END AS fraud_type,
    CAST((event_id * 31) % 101 AS INTEGER) AS risk_score,
    user_id AS sender_account_id,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS receiver_account_id,
    ts AS created_at,
    epoch_us(ts) AS us
  FROM events)"""

ORDERS_SQL = """tx AS (
  SELECT o_orderkey AS id,
    CAST(floor(o_totalprice / 50000) * 50000 AS DECIMAL(18,2)) AS amount,
    o_custkey % 50 AS sender_account_id,
    o_orderkey % 97 AS receiver_account_id,
    o_orderdate AS created_at,
    epoch_us(o_orderdate) AS us
  FROM orders)"""

ACC_SQL = """acc AS (
  SELECT c_custkey AS id,
    '100000' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS account_number,
    c_name AS account_name,
    CASE c_custkey % 4 WHEN 0 THEN 'SAVINGS' WHEN 1 THEN 'CHECKING'
      WHEN 2 THEN 'CREDIT' ELSE 'LOAN' END AS account_type,
    CASE WHEN c_custkey % 11 = 0 THEN 'CLOSED' WHEN c_custkey % 7 = 0 THEN 'SUSPENDED'
      ELSE 'ACTIVE' END AS status,
    CAST(c_acctbal AS DECIMAL(18,2)) AS balance,
    'USD' AS currency,
    CAST(c_nationkey AS BIGINT) AS user_id,
    1696118400000000 + ((c_custkey * 37) % 100) * 86400000000 AS us
  FROM customer)"""


# A third of the ledger pays one hub, another third is paid by it; nine in ten of these rows fall into one hour.
HUB = 7
RUSH_US = 1705320000000000


def tx_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tx_events`` with a hub that owns two thirds of the rows, most of them within an hour."""
    turn = F.col("id") % 3
    rush = (turn < 2) & (F.col("id") % 10 != 0)
    at = F.timestamp_micros(F.lit(RUSH_US) + (F.col("id") * 7919000) % F.lit(3_600_000_000))
    return tx_events(spark, sf_dir).withColumns(
        {
            "receiver_account_id": F.when(turn == 0, F.lit(HUB)).otherwise(F.col("receiver_account_id")).cast("long"),
            "sender_account_id": F.when(turn == 1, F.lit(HUB)).otherwise(F.col("sender_account_id")).cast("long"),
            "created_at": F.when(rush, at).otherwise(F.col("created_at")),
        }
    )


SKEWED_SQL = TX_SQL.replace("tx AS", "even_tx AS", 1) + f""", tx AS (SELECT * REPLACE (
    CASE WHEN id % 3 = 0 THEN {HUB} ELSE receiver_account_id END AS receiver_account_id,
    CASE WHEN id % 3 = 1 THEN {HUB} ELSE sender_account_id END AS sender_account_id,
    CASE WHEN id % 3 < 2 AND id % 10 <> 0 THEN {RUSH_US} + (id * 7919000) % 3600000000 ELSE us END AS us)
  FROM even_tx)"""


# --- change logs derived from the two ledgers ----------------------------------------


def _damaged(lines: DataFrame) -> DataFrame:
    """What a topic also carries: cut-off messages and messages without a row."""
    cut = lines.select(F.left("value", F.lit(60)).alias("value"))
    empty = lines.select(
        F.lit('{"before":null,"after":null,"op":"u","ts_ms":1,"ts_us":1000,"ts_ns":1000000}').alias("value")
    )
    return cut.unionByName(empty)


def account_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account created; every fifth later updated to a new balance."""
    rows = accounts(spark, sf_dir)
    never = F.lit(False)
    created = change_lines(rows, ACCOUNT, F.lit("c"), F.lit(0), never)
    some = rows.where(F.col("id") % 5 == 0).withColumn("balance", (F.col("balance") + 1).cast(MONEY))
    updated = change_lines(some, ACCOUNT, F.lit("u"), F.lit(1000), never)
    broken = change_lines(rows.where(F.col("id") % 300 == 0), ACCOUNT, F.lit("c"), F.lit(0), never)
    return created.unionByName(updated).unionByName(_damaged(broken))


def transaction_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transaction created; every 50th updated; every 97th deleted."""
    rows = tx_events(spark, sf_dir)
    never = F.lit(False)
    created = change_lines(rows, TRANSACTION, F.lit("c"), F.lit(0), never)
    some = rows.where(F.col("id") % 50 == 0).withColumn("risk_score", F.lit(99))
    updated = change_lines(some, TRANSACTION, F.lit("u"), F.lit(1000), never)
    gone = change_lines(
        rows.where(F.col("id") % 97 == 0), TRANSACTION, F.lit("d"), F.lit(2000), F.lit(True)
    )
    broken = change_lines(rows.where(F.col("id") % 500 == 0), TRANSACTION, F.lit("c"), F.lit(0), never)
    return created.unionByName(updated).unionByName(gone).unionByName(_damaged(broken))


# Corrections: of the transactions that are corrected at all, one kind of change each.
def corrected(rows: DataFrame) -> DataFrame:
    """The ledger after its corrections: new amounts, receivers and labels."""
    turn = F.col("id") % 50
    flipped = turn == 20
    fraud = F.when(flipped, ~F.col("is_fraud")).otherwise(F.col("is_fraud"))
    return rows.withColumns(
        {
            "amount": F.when(turn == 0, F.col("amount") + 500).otherwise(F.col("amount")).cast(MONEY),
            "receiver_account_id": F.when(turn == 10, (F.col("receiver_account_id") + 1) % 100).otherwise(F.col("receiver_account_id")),
            "is_fraud": fraud,
            "fraud_type": F.when(flipped, F.when(fraud, "VELOCITY_SPIKE")).otherwise(F.col("fraud_type")),
        }
    )


CORRECTED_SQL = """tx AS (SELECT * REPLACE (
    CAST(CASE WHEN id % 50 = 0 THEN amount + 500 ELSE amount END AS DECIMAL(18,2)) AS amount,
    CASE WHEN id % 50 = 10 THEN (receiver_account_id + 1) % 100 ELSE receiver_account_id END AS receiver_account_id,
    CASE WHEN id % 50 = 20 THEN NOT is_fraud ELSE is_fraud END AS is_fraud,
    CASE WHEN id % 50 <> 20 THEN fraud_type WHEN is_fraud THEN NULL ELSE 'VELOCITY_SPIKE' END AS fraud_type)
  FROM first_tx)"""


def creations(rows: DataFrame) -> DataFrame:
    return change_lines(rows, TRANSACTION, F.lit("c"), F.lit(0), F.lit(False))


def corrections(rows: DataFrame) -> DataFrame:
    """A day after its creation, the correction of every transaction that has one; before it, an older one that it outdoes."""
    some = rows.where(F.col("id") % 50 % 10 == 0)
    last = change_lines(corrected(some), TRANSACTION, F.lit("u"), F.lit(86_400_000), F.lit(False))
    outdone = some.where(F.col("id") % 50 == 0).withColumn("amount", (F.col("amount") + 7).cast(MONEY))
    return last.unionByName(change_lines(outdone, TRANSACTION, F.lit("u"), F.lit(1000), F.lit(False)))


def broken_changes(rows: DataFrame) -> DataFrame:
    return _damaged(creations(rows.where(F.col("id") % 500 == 0)))


def far_future_change(spark: SparkSession) -> DataFrame:
    """One transaction a year later, of accounts nobody uses: it moves the watermark past
    every real row so that a finite stream drains."""
    row = spark.range(1).select(
        F.lit("sentinel").alias("id"),
        F.lit(0).cast(MONEY).alias("amount"),
        F.lit("USD").alias("currency"),
        *[F.lit(None).cast("string").alias(c) for c in ("reference", "description", "latitude", "longitude")],
        F.lit(False).alias("is_fraud"),
        F.lit(None).cast("string").alias("fraud_type"),
        F.lit(0).alias("risk_score"),
        F.lit("sentinel").alias("sender_account_id"),
        F.lit("sentinel").alias("receiver_account_id"),
        F.timestamp_micros(F.lit(1738368000000000)).alias("created_at"),
    )
    return change_lines(row, TRANSACTION, F.lit("c"), F.lit(0), F.lit(False))
