"""Sources, sinks and streams.

Streams run to their end over message files that are derived from the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.times import DAY, HOUR
from ..operators import metrics
from ..operators.history import RECEIVER, SENDER
from ..plans import scoring
from ..plans import features as plan
from ..plans.training import MODEL_VERSION
from ..schemas import ACCOUNT, FEATURE_ROW, FRAUD_TYPES, PROFILE, TRANSACTION
from ..session import work_dir
from ..sources import cdc, tables
from ..sources.fixtures import (
    ACC_SQL,
    CORRECTED_SQL,
    TX_SQL,
    account_changes,
    accounts,
    broken_changes,
    corrections,
    creations,
    far_future_change,
    transaction_changes,
    tx_events,
)
from ..sources.manifest import CompactingTable
from ..streaming import pipeline
from ..streaming.reconcile import VERSION, reconcile_sink
from ..streaming.runs import BatchTable, drain, drain_batches
from .features import PROFILE_OUT, PROFILE_SQL, profile, profile_out
from .learning import SCORED_SQL, TABLE_SQL, THREE_SQL, fitted, points, rounded, three_models
from .registry import query
from .rules import SCALED, _alert_sql
from .ledger import _reasons_sql

# Change events carry milliseconds, so the streamed ledger is the tables' at that grain.
MS_PROFILE_SQL = PROFILE_SQL.replace("epoch_us(ts) AS us", "epoch_us(ts) // 1000 * 1000 AS us")


# Spans of whole milliseconds are compared as such: in hours or days many of them lie
# exactly between two rounded values.
MS_OUT = """SELECT transaction_id, round(trans_amount, 2) AS trans_amount,
  CAST(round(age_hours_open_acc * 3600000) AS BIGINT) AS age_ms,
  receiver_txn_count_last_3d, unique_senders_last_3d, multi_same_amt_count_2d,
  sender_txn_count_last_1h, round(sender_volume_last_1h, 2) AS sender_volume_last_1h,
  CAST(round(days_since_last_trans * 86400000) AS BIGINT) AS gap_ms,
  round(geo_speed_kmh, 4) AS geo_speed_kmh, is_fraud, fraud_type FROM profile"""


def ms_out(df):
    return df.select(
        F.col("transaction_id").cast("long").alias("transaction_id"),
        F.round(F.col("trans_amount").cast("double"), 2).alias("trans_amount"),
        F.round(F.col("age_hours_open_acc") * 3600000).cast("long").alias("age_ms"),
        "receiver_txn_count_last_3d",
        "unique_senders_last_3d",
        "multi_same_amt_count_2d",
        "sender_txn_count_last_1h",
        F.round(F.col("sender_volume_last_1h").cast("double"), 2).alias("sender_volume_last_1h"),
        F.round(F.col("days_since_last_trans") * 86400000).cast("long").alias("gap_ms"),
        F.round("geo_speed_kmh", 4).alias("geo_speed_kmh"),
        "is_fraud",
        "fraud_type",
    )


def published(spark, lines, name):
    """Messages as a folder of JSON lines."""
    path = work_dir(spark, name)
    lines.write.text(path)
    return path


def arriving(spark, lines, name, batches=3):
    """Messages as a stream that takes them in so many micro-batches, in no order.

    Every writer deals its messages out to the batches, so that no task has a batch's share of all to write.
    """
    path = work_dir(spark, name)
    turn = F.pmod(F.xxhash64("value"), F.lit(batches)).alias("turn")
    lines.select("value", turn).write.partitionBy("turn").text(path)
    files = len(spark.read.option("recursiveFileLookup", "true").text(path).inputFiles())
    return tables.line_stream(spark, path, files_per_batch=max(1, -(-files // batches)), recursiveFileLookup="true")


def transaction_lines(spark, d):
    lines = transaction_changes(spark, d).unionByName(far_future_change(spark))
    return tables.line_stream(spark, published(spark, lines, "transaction-changes"))


# --- A: batch sources and sinks ----------------------------------------------------


@query(
    "A1_src_transactions",
    f"""WITH {TX_SQL} SELECT id, CAST(amount AS DOUBLE) AS amount, sender_account_id, receiver_account_id,
  latitude, longitude, us AS created_us, is_fraud, fraud_type FROM tx""",
)
def src_transactions(spark, d):
    t = tables.transactions(tx_events(spark, d))
    return t.select(
        "id",
        F.col("amount").cast("double").alias("amount"),
        SENDER,
        RECEIVER,
        "latitude",
        "longitude",
        F.unix_micros("created_at").alias("created_us"),
        "is_fraud",
        "fraud_type",
    )


@query(
    "A2_src_accounts", f"WITH {ACC_SQL} SELECT id, account_number, us AS created_us FROM acc"
)
def src_accounts(spark, d):
    a = tables.accounts(accounts(spark, d))
    return a.select("id", "account_number", F.unix_micros("created_at").alias("created_us"))


@query(
    "A3_src_cdc_accounts",
    f"""WITH {ACC_SQL} SELECT id, 'c' AS op, us // 1000 AS ts_ms, CAST(balance AS DOUBLE) AS balance FROM acc
UNION ALL SELECT id, 'u', us // 1000 + 1000, CAST(balance + 1 AS DOUBLE) FROM acc WHERE id % 5 = 0""",
)
def src_cdc_accounts(spark, d):
    path = published(spark, account_changes(spark, d), "account-changes")
    events = cdc.readable(cdc.parse(tables.line_stream(spark, path), ACCOUNT))
    rows = events.where(F.col("after.id").isNotNull()).select(
        F.col("after.id").cast("long").alias("id"),
        "op",
        "ts_ms",
        F.col("after.balance").cast("double").alias("balance"),
    )
    return drain(rows, "accounts")


@query(
    "A4_src_cdc_transactions",
    f"""WITH {TX_SQL}, e AS (SELECT id, 'c' AS op, epoch_us(created_at) // 1000 AS ts_ms, latitude FROM tx
  UNION ALL SELECT id, 'u', epoch_us(created_at) // 1000 + 1000, latitude FROM tx WHERE id % 50 = 0
  UNION ALL SELECT id, 'd', epoch_us(created_at) // 1000 + 2000, latitude FROM tx WHERE id % 97 = 0)
SELECT id, op, ts_ms, round(latitude, 4) AS latitude FROM e""",
)
def src_cdc_transactions(spark, d):
    path = published(spark, transaction_changes(spark, d), "transaction-changes")
    events = cdc.readable(cdc.parse(tables.line_stream(spark, path), TRANSACTION))
    image = F.coalesce("after", "before")
    rows = events.where(image.isNotNull()).select(
        image["id"].cast("long").alias("id"),
        "op",
        "ts_ms",
        F.round(image["latitude"].try_cast("double"), 4).alias("latitude"),
    )
    return drain(rows, "transactions")


@query(
    "A5_cdc_unwrap",
    f"""WITH {TX_SQL}, e AS (SELECT *, risk_score AS score FROM tx
  UNION ALL SELECT *, 99 FROM tx WHERE id % 50 = 0)
SELECT id, CAST(amount AS DOUBLE) AS trans_amount, sender_account_id, receiver_account_id,
  epoch_us(created_at) // 1000 * 1000 AS trans_us, score AS risk_score FROM e""",
)
def cdc_unwrap(spark, d):
    rows = cdc.transactions(transaction_changes(spark, d))
    return rows.select(
        F.col("id").cast("long").alias("id"),
        F.col("amount").cast("double").alias("trans_amount"),
        F.col(SENDER).cast("long").alias(SENDER),
        F.col(RECEIVER).cast("long").alias(RECEIVER),
        F.unix_micros("created_at").alias("trans_us"),
        "risk_score",
    )


@query(
    "A6_cdc_latest_state",
    f"""WITH {TX_SQL} SELECT id, CAST(amount AS DOUBLE) AS amount,
  CASE WHEN id % 50 = 0 THEN 99 ELSE risk_score END AS risk_score FROM tx WHERE id % 97 <> 0""",
)
def cdc_latest_state(spark, d):
    rows = cdc.latest_state(cdc.parse(transaction_changes(spark, d), TRANSACTION), TRANSACTION)
    return rows.select(
        F.col("id").cast("long").alias("id"),
        F.col("amount").cast("double").alias("amount"),
        "risk_score",
    )


@query(
    "A7_json_corrupt_filter",
    f"""WITH {TX_SQL} SELECT 'readable' AS kind, count(*) + count(*) FILTER (WHERE id % 50 = 0)
  + count(*) FILTER (WHERE id % 97 = 0) + count(*) FILTER (WHERE id % 500 = 0) AS n FROM tx
UNION ALL SELECT 'unreadable', count(*) FROM tx WHERE id % 500 = 0""",
)
def json_corrupt_filter(spark, d):
    parsed = cdc.parse(transaction_changes(spark, d), TRANSACTION)
    good = cdc.readable(parsed).agg(F.count(F.lit(1)).alias("n"))
    bad = cdc.unreadable(parsed).agg(F.count(F.lit(1)).alias("n"))
    return good.select(F.lit("readable").alias("kind"), "n").unionByName(
        bad.select(F.lit("unreadable").alias("kind"), "n")
    )


def numbered(df):
    return profile_out(df).withColumn("transaction_id", F.col("transaction_id").cast("long"))


@query("A8_src_features_csv", f"{PROFILE_SQL} {PROFILE_OUT}")
def src_features_csv(spark, d):
    path = work_dir(spark, "features-csv")
    tables.write_feature_csv(profile(spark, d), path)
    return numbered(tables.read_feature_csv(spark, path))


@query("A9_sink_features_table", f"{PROFILE_SQL} {PROFILE_OUT}")
def sink_features_table(spark, d):
    path = work_dir(spark, "features")
    tables.write_feature_table(profile(spark, d), path)
    return numbered(tables.read_table(spark, path, FEATURE_ROW))


@query(
    "A10_sink_features_csv",
    PROFILE_SQL
    + """ SELECT count(*) AS n, round(sum(geo_speed_kmh), 2) AS speed,
  count(*) FILTER (WHERE fraud_type IS NULL) AS untyped FROM profile""",
)
def sink_features_csv(spark, d):
    path = work_dir(spark, "features-csv")
    tables.write_feature_csv(tables.by_time(
        plan.fraud_features(tx_events(spark, d), accounts(spark, d), keep=("us",)), "us"
    ), path)
    return tables.read_feature_csv(spark, path).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("geo_speed_kmh"), 2).alias("speed"),
        F.count_if(F.col("fraud_type").isNull()).alias("untyped"),
    )


@query(
    "A11_sink_upsert_stream",
    f"""WITH {ACC_SQL} SELECT id, CAST(CASE WHEN id % 5 = 0 THEN balance + 1 ELSE balance END AS DOUBLE)
  AS balance, us // 1000 + CASE WHEN id % 5 = 0 THEN 1000 ELSE 0 END AS ts_ms FROM acc""",
)
def sink_upsert_stream(spark, d):
    """Account changes upserted by id, several micro-batches, newest change wins."""
    path = published(spark, account_changes(spark, d), "account-changes")
    stream = cdc.unwrap(
        cdc.parse(tables.line_stream(spark, path, files_per_batch=2), ACCOUNT), ACCOUNT, "ts_ms"
    ).select("id", "balance", "ts_ms")
    table = BatchTable(spark, work_dir(spark, "upserts"), stream.schema)
    drain_batches(stream, "upserts", table.upsert_sink("id", ["ts_ms"]))
    return table.current("id", ["ts_ms"]).select(
        F.col("id").cast("long").alias("id"), F.col("balance").cast("double").alias("balance"), "ts_ms"
    )


@query(
    "A11_sink_compacted",
    f"""WITH {ACC_SQL} SELECT id, CAST(CASE WHEN id % 5 = 0 THEN balance + 1 ELSE balance END AS DOUBLE)
  AS balance, us // 1000 + CASE WHEN id % 5 = 0 THEN 1000 ELSE 0 END AS ts_ms FROM acc""",
)
def sink_compacted(spark, d):
    """The same upserts into a table that merges its folders while the stream runs."""
    path = published(spark, account_changes(spark, d).repartition(5), "account-changes")
    stream = cdc.unwrap(
        cdc.parse(tables.line_stream(spark, path, files_per_batch=1), ACCOUNT), ACCOUNT, "ts_ms"
    ).select("id", "balance", "ts_ms")
    table = CompactingTable(spark, work_dir(spark, "compacting"), stream.schema, "id", ["ts_ms"], every=2)
    table.create()
    drain_batches(stream, "compacting", table.sink)
    return table.current().select(
        F.col("id").cast("long").alias("id"), F.col("balance").cast("double").alias("balance"), "ts_ms"
    )


@query(
    "A11_upsert_messages",
    f"""WITH {ACC_SQL} SELECT id, '{{"id":' || id || '}}' AS key, status FROM acc""",
)
def upsert_messages(spark, d):
    rows = accounts(spark, d).select("id", "status")
    out = tables.upsert_messages(rows, "id")
    parsed = F.from_json("value", "id bigint, status string")
    return out.select(parsed["id"].alias("id"), "key", parsed["status"].alias("status"))


# --- predictions -------------------------------------------------------------------


def judged(spark, d):
    """The profile with a fixed score instead of a model, so that events can be checked."""
    rows = plan.fraud_features(
        tx_events(spark, d), accounts(spark, d), keep=("us", SENDER, RECEIVER)
    ).drop("is_fraud", "fraud_type")
    key = F.col("transaction_id")
    score = ((key * 7919) % 1000) / 1000.0
    names = F.array(*[F.lit(n) for n in FRAUD_TYPES])
    flag = metrics.predicted(score) == 1
    return rows.select(
        "*",
        flag.alias("is_fraud"),
        score.alias("fraud_probability"),
        F.when(flag, F.element_at(names, (key % 6 + 1).cast("int"))).alias("fraud_type"),
        F.lit(MODEL_VERSION).alias("model_version"),
    )


def prediction_lines(spark, d):
    return scoring.prediction_events(judged(spark, d), F.timestamp_micros("us"))


JUDGED_SQL = f"""{PROFILE_SQL}, judged AS (SELECT *, ((transaction_id * 7919) % 1000) / 1000.0 AS score
  FROM profile)"""


def flat_events(events):
    shown = {"trans_amount": 2, "age_hours_open_acc": 4, "days_since_last_trans": 4, "geo_speed_kmh": 4,
             "sender_volume_last_1h": 2}
    feats = [
        (F.round(F.col(f"prediction.features.{c}"), shown[c]) if c in shown
         else F.col(f"prediction.features.{c}")).alias(c)
        for c in PROFILE
    ]
    return events.select(
        F.col("transaction_id").cast("long").alias("transaction_id"),
        "event_type",
        "event_version",
        "event_time",
        F.col(f"prediction.{SENDER}").cast("long").alias(SENDER),
        F.col("prediction.is_fraud").alias("is_fraud"),
        F.col("prediction.fraud_probability").alias("fraud_probability"),
        F.col("prediction.fraud_type").alias("fraud_type"),
        F.col("prediction.model_version").alias("model_version"),
        *feats,
    )


EVENT_SQL = f"""{JUDGED_SQL} SELECT transaction_id, 'FRAUD_PREDICTION' AS event_type, '1.0' AS event_version,
  strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS event_time, sender_account_id,
  score > 0.5 AS is_fraud, CAST(score AS DOUBLE) AS fraud_probability,
  CASE WHEN score > 0.5 THEN CASE transaction_id % 6 WHEN 0 THEN 'IMMEDIATE_LARGE_TRANSFER'
    WHEN 1 THEN 'MANY_TO_ONE_CONSOLIDATION' WHEN 2 THEN 'MULTIPLE_SAME_AMOUNT' WHEN 3 THEN 'VELOCITY_SPIKE'
    WHEN 4 THEN 'LOCATION_JUMP' ELSE 'SLEEP_AND_WAKE' END END AS fraud_type,
  'fraud-model-v1' AS model_version, round(trans_amount, 2) AS trans_amount,
  round(age_hours_open_acc, 4) AS age_hours_open_acc, receiver_txn_count_last_3d, unique_senders_last_3d,
  multi_same_amt_count_2d, sender_txn_count_last_1h, round(sender_volume_last_1h, 2) AS sender_volume_last_1h,
  round(days_since_last_trans, 4) AS days_since_last_trans, round(geo_speed_kmh, 4) AS geo_speed_kmh
FROM judged"""


@query("A12_sink_prediction_events", EVENT_SQL)
def sink_prediction_events(spark, d):
    """Envelopes written as messages, then parsed back field by field."""
    path = published(spark, prediction_lines(spark, d).select("value"), "predictions")
    return flat_events(pipeline.parse_predictions(spark.read.text(path)))


@query("A13_src_predictions_latest", EVENT_SQL)
def src_predictions_latest(spark, d):
    path = published(spark, prediction_lines(spark, d).select("value"), "predictions")
    return drain(flat_events(pipeline.parse_predictions(tables.line_stream(spark, path))), "parsed")


@query(
    "A14_sink_metrics_json",
    f"""{THREE_SQL} SELECT model, round(sum(neg * (tp - pos / 2)) / (max(p) * max(n)), 6) AS roc_auc,
  round(sum(pos * tp / (tp + fp)) / max(p), 6) AS pr_auc FROM q GROUP BY model""",
)
def sink_metrics_json(spark, d):
    path = work_dir(spark, "metrics")
    tables.write_metrics_json(rounded(three_models(spark, d)), path)
    return spark.read.schema("model string, roc_auc double, pr_auc double").json(path)


@query(
    "A14_sink_threshold_csv",
    f"{SCORED_SQL}, t AS ({TABLE_SQL}) SELECT threshold, precision, recall FROM t",
)
def sink_threshold_csv(spark, d):
    path = work_dir(spark, "thresholds")
    tables.write_threshold_csv(rounded(metrics.threshold_table(points(spark, d))), path)
    schema = "threshold double, precision double, recall double"
    return spark.read.schema(schema).option("header", True).csv(path)


# --- S: streams --------------------------------------------------------------------


@query(
    "S1_event_time_parse",
    f"""WITH {TX_SQL}, e AS (SELECT id, created_at FROM tx
  UNION ALL SELECT id, created_at FROM tx WHERE id % 50 = 0)
SELECT id, epoch_us(created_at) // 1000 * 1000 AS event_us FROM e""",
)
def event_time_parse(spark, d):
    path = published(spark, transaction_changes(spark, d), "transaction-changes")
    tx = pipeline.event_time(cdc.transactions(tables.line_stream(spark, path)))
    return drain(
        tx.select(F.col("id").cast("long").alias("id"), F.unix_micros("event_time").alias("event_us")),
        "event-times",
    )


# Rows held back until others two hours newer have come: of these, those of a first version are late.
HELD = 37
LATE_BY = 2 * HOUR
HELD_SQL = f"(SELECT id FROM first_tx WHERE id % {HELD} = 5 AND us < (SELECT max(us) FROM first_tx WHERE id % {HELD} <> 5) - {LATE_BY})"
FIRST_SQL = TX_SQL.replace("tx AS", "first_tx AS", 1).replace("epoch_us(ts) AS us", "epoch_us(ts) // 1000 * 1000 AS us")
# A correction of a late transaction is on time, so what counts is whether any version was.
NEWEST_SQL = CORRECTED_SQL.replace("FROM first_tx)", f"FROM first_tx WHERE id NOT IN {HELD_SQL} OR id % 10 = 0)")
NEWEST_PROFILE_SQL = PROFILE_SQL.replace(TX_SQL, f"{FIRST_SQL}, {NEWEST_SQL}")


def corrected_flow(spark, d, answers=True):
    """A ledger that arrives in two parts: the second has corrections, late rows and damage."""
    tx = tx_events(spark, d)
    path = work_dir(spark, "transaction-changes")
    newest = tx.where(F.col("id") % HELD != 5).agg(F.max(F.unix_millis("created_at"))).first()[0] * 1000
    held = (F.col("id") % HELD == 5) & (F.unix_millis("created_at") * 1000 < newest - LATE_BY)
    arrivals = [
        creations(tx.where(~held)),
        creations(tx.where(held)).unionByName(corrections(tx)).unionByName(broken_changes(tx)),
    ]
    flow = None
    for lines in arrivals:
        lines.write.mode("append").text(path)
        if flow is None:
            raw = tables.line_stream(spark, path)
            flow = pipeline.FeatureFlow(raw, work_dir(spark, "flow"), text_accounts(spark, d))
        flow.advance(answers)
    return flow


@query(
    "S2_stream_dedup",
    f"""WITH {FIRST_SQL}, {NEWEST_SQL} SELECT id, us AS event_us, CAST(amount AS DOUBLE) AS amount,
  receiver_account_id, is_fraud, fraud_type FROM tx""",
)
def stream_dedup(spark, d):
    """The newest version of each transaction, whichever came first."""
    return corrected_flow(spark, d, answers=False).newest().select(
        F.col("id").cast("long").alias("id"),
        F.col("us").alias("event_us"),
        F.col("amount").cast("double").alias("amount"),
        F.col(RECEIVER).cast("long").alias(RECEIVER),
        "is_fraud",
        "fraud_type",
    )


LEDGER_COLUMNS = [
    "id", "amount", SENDER, RECEIVER, "latitude", "longitude", "is_fraud", "fraud_type", "created_at",
]


def reconcile_tables(spark, stream):
    ledger = BatchTable(spark, work_dir(spark, "ledger"), stream.schema)
    late = BatchTable(spark, work_dir(spark, "late"), stream.schema)
    out = plan.fraud_features(
        spark.createDataFrame([], stream.schema).drop(*VERSION),
        spark.createDataFrame([], "id string, created_at timestamp"),
        keep=("us", SENDER),
    )
    return ledger, late, BatchTable(spark, work_dir(spark, "profiles"), out.schema)


def text_accounts(spark, d):
    return accounts(spark, d).withColumn("id", F.col("id").cast("string"))


CORRECTED_PROFILE_SQL = PROFILE_SQL.replace(TX_SQL, f"{FIRST_SQL}, {CORRECTED_SQL}")


@query("S3_stream_reconciled_features", f"{CORRECTED_PROFILE_SQL} {MS_OUT}")
def stream_reconciled_features(spark, d):
    """Micro-batches in arbitrary time order, corrections among them; every affected profile is recomputed."""
    tx = tx_events(spark, d)
    lines = creations(tx).unionByName(corrections(tx)).unionByName(broken_changes(tx))
    raw = arriving(spark, lines, "transaction-changes")
    stream = cdc.transactions(raw, *VERSION).select(*LEDGER_COLUMNS, *VERSION)
    ledger, _, profiles = reconcile_tables(spark, stream)
    drain_batches(stream, "reconcile", reconcile_sink(ledger, profiles, text_accounts(spark, d)))
    return ms_out(profiles.current("transaction_id", []))


@query("S4_stream_stateful_features", f"{NEWEST_PROFILE_SQL} {MS_OUT}")
def stream_stateful_features(spark, d):
    """Keyed state that answers again what a correction changes."""
    return ms_out(corrected_flow(spark, d).features())


@query(
    "S4_stream_outcomes",
    f"""WITH {FIRST_SQL}, held AS {HELD_SQL}, rows AS (
  SELECT id, 1 AS version FROM first_tx UNION ALL SELECT id, 3 FROM first_tx WHERE id % 10 = 0
  UNION ALL SELECT id, 2 FROM first_tx WHERE id % 50 = 0
), on_time AS (SELECT * FROM rows WHERE version > 1 OR id NOT IN (FROM held))
SELECT 'answered' AS outcome, count(DISTINCT id) AS n FROM on_time
UNION ALL SELECT 'outdone', count(*) - count(DISTINCT id) FROM on_time
UNION ALL SELECT 'late', count(*) FROM rows WHERE version = 1 AND id IN (FROM held)
UNION ALL SELECT 'quarantine', count(*) FROM first_tx WHERE id % 500 = 0""",
)
def stream_outcomes(spark, d):
    """Where each message went: every one is in exactly one place."""
    flow = corrected_flow(spark, d)
    answered = flow.features().select(F.lit("answered").alias("outcome"))
    outdone = flow.intake.accepted.read().groupBy("id").count().select(F.lit("outdone").alias("outcome"), (F.col("count") - 1).alias("n"))
    counted = answered.withColumn("n", F.lit(1).cast("long")).unionByName(outdone)
    for name, table in (("late", flow.intake.late), ("quarantine", flow.intake.quarantine)):
        counted = counted.unionByName(table.read().select(F.lit(name).alias("outcome"), F.lit(1).cast("long").alias("n")))
    return counted.groupBy("outcome").agg(F.sum("n").alias("n"))


def feature_lines(spark, d):
    rows = plan.fraud_features(tx_events(spark, d), accounts(spark, d), keep=(SENDER, RECEIVER))
    rows = rows.withColumn("computed_us", F.unix_micros(F.current_timestamp()))
    cast = rows.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in pipeline.FEATURE_MESSAGE]
    )
    return tables.upsert_messages(cast, "transaction_id").select("value")


def prediction_tables(spark):
    events = BatchTable(
        spark,
        work_dir(spark, "predictions"),
        spark.createDataFrame(
            [], "key string, value string, scenarios string, risk_score int, action string"
        ).schema,
    )
    refused = BatchTable(
        spark,
        work_dir(spark, "quarantine"),
        spark.createDataFrame([], "transaction_id string, reasons string, unreadable string").schema,
    )
    return events, refused


def streamed_predictions(spark, d):
    trained, types, _, _ = fitted(spark, d)
    path = published(spark, feature_lines(spark, d), "features")
    stream = pipeline.feature_stream(tables.line_stream(spark, path))
    events, refused = prediction_tables(spark)
    drain_batches(
        stream, "score", pipeline.scoring_sink(events, refused, trained.best_model, types, SCALED)
    )
    return events, refused


@query(
    "S5_stream_from_changes",
    _alert_sql()
    .replace(PROFILE_SQL, NEWEST_PROFILE_SQL)
    .replace("risk_score FROM profile)", f"risk_score FROM profile WHERE {_reasons_sql()} = '')"),
)
def stream_from_changes(spark, d):
    """From change messages to prediction events in one chain of streams; the newest event of each transaction."""
    trained, types, _, _ = fitted(spark, d)
    flow = corrected_flow(spark, d)
    events, refused = prediction_tables(spark)
    flow.start_scoring(events, refused, trained.best_model, types, SCALED, availableNow=True).awaitTermination()
    return events.current("key", ["batch"]).select(
        F.col("key").cast("long").alias("transaction_id"), "scenarios", "risk_score", "action"
    )


@query("S5_stream_score")
def stream_score(spark, d):
    """Feature messages to prediction events with model scores."""
    events, _ = streamed_predictions(spark, d)
    return flat_events(pipeline.parse_predictions(events.read()))


@query(
    "S5_stream_alerts",
    _alert_sql().replace("risk_score FROM profile)", f"risk_score FROM profile WHERE {_reasons_sql()} = '')"),
)
def stream_alerts(spark, d):
    """The rule outcome that travels with each event; refused rows have none."""
    events, _ = streamed_predictions(spark, d)
    return events.read().select(
        F.col("key").cast("long").alias("transaction_id"), "scenarios", "risk_score", "action"
    )


@query(
    "S6_stream_monitoring",
    f"""{JUDGED_SQL}, newest AS (SELECT * FROM judged ORDER BY us DESC LIMIT 30)
SELECT count(*) AS events, count(*) FILTER (WHERE score > 0.5) AS fraud_events,
  CAST(floor(100.0 * count(*) FILTER (WHERE score > 0.5) / count(*) + 0.5) AS BIGINT) AS review_rate,
  round(sum(trans_amount), 2) AS volume FROM newest""",
)
def stream_monitoring(spark, d):
    stream = pipeline.parse_predictions(arriving(spark, prediction_lines(spark, d).select("value"), "predictions"))
    feed = BatchTable(spark, work_dir(spark, "feed"), pipeline.FEED)
    drain_batches(stream, "monitor", pipeline.monitoring_sink(feed))
    return rounded(pipeline.live_kpis(feed), 2)


@query(
    "S7_state_expiry",
    f"""WITH {TX_SQL}, e AS (SELECT sender_account_id, epoch_us(created_at) // 1000 * 1000 AS us FROM tx),
g AS (SELECT *, lag(us) OVER (PARTITION BY sender_account_id ORDER BY us) AS p FROM e),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p >= {4 * DAY} THEN 1 ELSE 0 END)
  OVER (PARTITION BY sender_account_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT sender_account_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s
GROUP BY sender_account_id, k""",
)
def state_expiry(spark, d):
    """Activity of a sender up to four idle days, after which its state is gone."""
    tx = pipeline.transaction_stream(transaction_lines(spark, d))
    closed = drain(pipeline.idle_sessions(tx, SENDER), "idle")
    return closed.where(F.col(SENDER) != "sentinel").select(
        F.col(SENDER).cast("long").alias(SENDER),
        F.unix_micros("first_seen").alias("first_us"),
        F.unix_micros("last_seen").alias("last_us"),
        "n",
    )


# First the newer part of the ledger arrives, then the older part: of that, rows more
# than ten days behind the newest are too late.
NEWER_FROM = 1705881600000000
LATENESS = 10 * DAY
ON_TIME_SQL = re.sub(
    r"FROM events\)",
    f"""FROM events WHERE epoch_us(ts) >= {NEWER_FROM}
    OR epoch_us(ts) // 1000 * 1000 >= (SELECT max(epoch_us(ts) // 1000 * 1000) FROM events) - {LATENESS})""",
    MS_PROFILE_SQL,
)


@query(
    "S8_late_data",
    f"""{ON_TIME_SQL}, o AS ({MS_OUT})
SELECT transaction_id, 'on time' AS status, receiver_txn_count_last_3d, multi_same_amt_count_2d,
  gap_ms, geo_speed_kmh FROM o
UNION ALL SELECT event_id, 'late', -1, -1, -1, -1.0 FROM events
WHERE event_id NOT IN (SELECT transaction_id FROM o)""",
)
def late_data(spark, d):
    tx = tx_events(spark, d)
    newer = F.unix_micros("created_at") >= NEWER_FROM
    path = work_dir(spark, "arrivals")
    never = F.lit(False)

    def publish(rows):
        cdc.change_lines(rows, TRANSACTION, F.lit("c"), F.lit(0), never).write.mode("append").text(path)

    publish(tx.where(newer))
    stream = cdc.transactions(tables.line_stream(spark, path), *VERSION).select(*LEDGER_COLUMNS, *VERSION)
    ledger, late, profiles = reconcile_tables(spark, stream)
    handle = reconcile_sink(ledger, profiles, text_accounts(spark, d), LATENESS, late)
    progress = work_dir(spark, "late-progress")
    for rows in (None, tx.where(~newer)):
        if rows is not None:
            publish(rows)
        run = stream.writeStream.foreachBatch(handle).option("checkpointLocation", progress)
        run.trigger(availableNow=True).start().awaitTermination()
    shown = ["receiver_txn_count_last_3d", "multi_same_amt_count_2d", "gap_ms", "geo_speed_kmh"]
    on_time = ms_out(profiles.current("transaction_id", [])).select(
        "transaction_id", F.lit("on time").alias("status"), *shown
    )
    refused = late.read().select(
        F.col("id").cast("long").alias("transaction_id"),
        F.lit("late").alias("status"),
        *[F.lit(-1).cast("long").alias(c) for c in shown[:3]],
        F.lit(-1.0).alias("geo_speed_kmh"),
    )
    return on_time.unionByName(refused)
