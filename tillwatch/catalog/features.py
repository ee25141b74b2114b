"""Profile features, joins and windows over the whole ledger.

The Spark side uses sweeps and shared windows; the SQL side states the same
features as self-joins, so the two are independent.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import DAY, HOUR, days_between
from ..operators import joins
from ..operators.history import RECEIVER, SENDER, with_clock
from ..operators.hotkeys import Heat
from ..operators.trailing import trailing, trailing_terms
from ..operators import windows
from ..plans import features as plan
from ..sources.fixtures import ACC_SQL, ORDERS_SQL, SKEWED_SQL, TX_SQL, accounts, tx_events, tx_orders, tx_skewed
from .registry import query

WITH = f"WITH {TX_SQL},\n{ACC_SQL}"
H3D, H2D, H1H = 3 * DAY, 2 * DAY, HOUR

RECEIVER_CTE = f"""rcv AS (
  SELECT t.id, count(p.id) AS n, count(DISTINCT p.sender_account_id) AS u
  FROM tx t LEFT JOIN tx p ON p.receiver_account_id = t.receiver_account_id
    AND p.id <> t.id AND p.us >= t.us - {H3D} AND p.us < t.us
  GROUP BY t.id)"""
SAME_CTE = f"""same AS (
  SELECT t.id, count(p.id) AS n
  FROM tx t LEFT JOIN tx p ON p.sender_account_id = t.sender_account_id
    AND p.amount = t.amount AND p.id <> t.id
    AND p.us >= t.us - {H2D} AND p.us < t.us
  GROUP BY t.id)"""
PACE_CTE = f"""pace AS (
  SELECT t.id, count(p.id) AS n, coalesce(sum(p.amount), 0) AS v
  FROM tx t LEFT JOIN tx p ON p.sender_account_id = t.sender_account_id
    AND p.id <> t.id AND p.us >= t.us - {H1H} AND p.us < t.us
  GROUP BY t.id)"""
PREV_CTE = """prev AS (
  SELECT t.id, max(p.us) AS us, arg_max(p.latitude, p.us) AS lat, arg_max(p.longitude, p.us) AS lon
  FROM tx t LEFT JOIN tx p ON p.sender_account_id = t.sender_account_id
    AND p.id <> t.id AND p.us < t.us
  GROUP BY t.id)"""


def speed_sql(t: str, p: str) -> str:
    return f"""CASE WHEN {p}.lat IS NULL OR {p}.lon IS NULL OR {t}.us <= {p}.us THEN 0.0
      ELSE 2 * 6371.0 * asin(sqrt(least(1.0, greatest(0.0,
        pow(sin((radians({t}.latitude) - radians({p}.lat)) / 2), 2)
        + cos(radians({p}.lat)) * cos(radians({t}.latitude))
        * pow(sin((radians({t}.longitude) - radians({p}.lon)) / 2), 2)))))
        / (({t}.us - {p}.us) / 3600000000.0) END"""


PROFILE_SQL = f"""{WITH}, {RECEIVER_CTE}, {SAME_CTE}, {PACE_CTE}, {PREV_CTE},
profile AS (
  SELECT t.id AS transaction_id, t.us, t.sender_account_id, t.receiver_account_id,
    CAST(t.amount AS DOUBLE) AS trans_amount,
    (t.us - a.us) / 3600000000.0 AS age_hours_open_acc,
    rcv.n AS receiver_txn_count_last_3d, rcv.u AS unique_senders_last_3d,
    same.n AS multi_same_amt_count_2d, pace.n AS sender_txn_count_last_1h,
    CAST(pace.v AS DOUBLE) AS sender_volume_last_1h,
    coalesce((t.us - prev.us) / 86400000000.0, 9999.0) AS days_since_last_trans,
    {speed_sql('t', 'prev')} AS geo_speed_kmh,
    t.is_fraud, t.fraud_type
  FROM tx t LEFT JOIN acc a ON a.id = t.sender_account_id
    JOIN rcv ON rcv.id = t.id JOIN same ON same.id = t.id
    JOIN pace ON pace.id = t.id JOIN prev ON prev.id = t.id)"""

PROFILE_OUT = """SELECT transaction_id, round(trans_amount, 2) AS trans_amount,
  round(age_hours_open_acc, 4) AS age_hours_open_acc,
  receiver_txn_count_last_3d, unique_senders_last_3d, multi_same_amt_count_2d,
  sender_txn_count_last_1h, round(sender_volume_last_1h, 2) AS sender_volume_last_1h,
  round(days_since_last_trans, 4) AS days_since_last_trans,
  round(geo_speed_kmh, 4) AS geo_speed_kmh, is_fraud, fraud_type FROM profile"""


def profile_out(df):
    """The profile with reals rounded for comparison."""
    places = {
        "trans_amount": 2,
        "age_hours_open_acc": 4,
        "sender_volume_last_1h": 2,
        "days_since_last_trans": 4,
        "geo_speed_kmh": 4,
    }
    return df.select(
        *[
            F.round(F.col(c).cast("double"), places[c]).alias(c) if c in places else F.col(c)
            for c in df.columns
        ]
    )


def profile(spark, d):
    return plan.fraud_features(tx_events(spark, d), accounts(spark, d))


# --- B: features -------------------------------------------------------------------


@query(
    "B1_target_transactions",
    f"""{WITH} SELECT t.id, t.sender_account_id, t.receiver_account_id,
  s.account_number AS sender_account, r.account_number AS receiver_account,
  s.us AS sender_open_us, t.us AS trans_us, CAST(t.amount AS DOUBLE) AS trans_amount,
  round((t.us - s.us) / 3600000000.0, 4) AS age_hours_open_acc, t.is_fraud, t.fraud_type
FROM tx t LEFT JOIN acc s ON t.sender_account_id = s.id
  LEFT JOIN acc r ON t.receiver_account_id = r.id""",
)
def target_transactions(spark, d):
    t = plan.target_transactions(tx_events(spark, d), accounts(spark, d))
    return t.select(
        "id",
        SENDER,
        RECEIVER,
        "sender_account",
        "receiver_account",
        F.unix_micros("sender_open_acc_date").alias("sender_open_us"),
        F.unix_micros("trans_date").alias("trans_us"),
        F.col("trans_amount").cast("double").alias("trans_amount"),
        F.round("age_hours_open_acc", 4).alias("age_hours_open_acc"),
        "is_fraud",
        "fraud_type",
    )


@query(
    "B2_age_hours_open_acc",
    f"""{WITH} SELECT t.id AS transaction_id,
  round((t.us - a.us) / 3600000000.0, 4) AS age_hours_open_acc,
  round(trunc((t.us - a.us) / 1000000.0) / 3600.0, 4) AS age_hours_whole_seconds
FROM tx t LEFT JOIN acc a ON a.id = t.sender_account_id""",
)
def age_hours(spark, d):
    a = plan.account_age(tx_events(spark, d), accounts(spark, d))
    return a.select(
        "transaction_id",
        F.round("age_hours_open_acc", 4).alias("age_hours_open_acc"),
        F.round("age_hours_whole_seconds", 4).alias("age_hours_whole_seconds"),
    )


@query(
    "B3_receiver_txn_count_last_3d",
    f"WITH {TX_SQL}, {RECEIVER_CTE} SELECT id AS transaction_id, n AS receiver_txn_count_last_3d FROM rcv",
)
def receiver_count(spark, d):
    return plan.trailing_feature(
        tx_events(spark, d), [RECEIVER], H3D, "receiver_txn_count_last_3d", F.lit(1).cast("long")
    )


@query(
    "B4_unique_senders_last_3d",
    f"WITH {TX_SQL}, {RECEIVER_CTE} SELECT id AS transaction_id, u AS unique_senders_last_3d FROM rcv",
)
def unique_senders(spark, d):
    return plan.receiver_features(tx_events(spark, d)).select(
        "transaction_id", "unique_senders_last_3d"
    )


@query(
    "B5_multi_same_amt_count_2d",
    f"WITH {TX_SQL}, {SAME_CTE} SELECT id AS transaction_id, n AS multi_same_amt_count_2d FROM same",
)
def same_amount(spark, d):
    return plan.trailing_feature(
        tx_events(spark, d), [SENDER, "amount"], H2D, "multi_same_amt_count_2d", F.lit(1).cast("long")
    )


@query(
    "B6_sender_txn_count_last_1h",
    f"WITH {TX_SQL}, {PACE_CTE} SELECT id AS transaction_id, n AS sender_txn_count_last_1h FROM pace",
)
def sender_count(spark, d):
    return plan.trailing_feature(
        tx_events(spark, d), [SENDER], H1H, "sender_txn_count_last_1h", F.lit(1).cast("long")
    )


@query(
    "B7_sender_volume_last_1h",
    f"""WITH {TX_SQL}, {PACE_CTE} SELECT id AS transaction_id,
  round(CAST(v AS DOUBLE), 2) AS sender_volume_last_1h FROM pace""",
)
def sender_volume(spark, d):
    out = plan.trailing_feature(
        tx_events(spark, d), [SENDER], H1H, "sender_volume_last_1h", F.col("amount")
    )
    return out.withColumn(
        "sender_volume_last_1h", F.round(F.col("sender_volume_last_1h").cast("double"), 2)
    )


@query(
    "B8_days_since_last_trans",
    f"""WITH {TX_SQL}, {PREV_CTE} SELECT t.id AS transaction_id,
  round(coalesce((t.us - prev.us) / 86400000000.0, 9999.0), 4) AS days_since_last_trans
FROM tx t JOIN prev ON prev.id = t.id""",
)
def dormancy(spark, d):
    return plan.sender_features(tx_events(spark, d)).select(
        "transaction_id", F.round("days_since_last_trans", 4).alias("days_since_last_trans")
    )


@query(
    "B9_geo_speed_kmh",
    f"""WITH {TX_SQL}, {PREV_CTE} SELECT t.id AS transaction_id,
  round({speed_sql('t', 'prev')}, 4) AS geo_speed_kmh
FROM tx t JOIN prev ON prev.id = t.id""",
)
def geo_speed(spark, d):
    return plan.sender_features(tx_events(spark, d)).select(
        "transaction_id", F.round("geo_speed_kmh", 4).alias("geo_speed_kmh")
    )


@query("B10_fraud_features", f"{PROFILE_SQL} {PROFILE_OUT}")
def fraud_features(spark, d):
    return profile_out(profile(spark, d))


# The three conditions of the stream's self-join, each as pairs of a transaction and an earlier one.
PAIRS = f"""pairs AS (
  SELECT x.id AS id, y.id AS other, 'receiver' AS rule FROM tx x JOIN tx y USING (receiver_account_id)
  WHERE x.us - y.us BETWEEN 1 AND {H3D}
  UNION ALL SELECT x.id, y.id, 'amount' FROM tx x JOIN tx y USING (sender_account_id, amount)
  WHERE x.us - y.us BETWEEN 1 AND {H2D}
  UNION ALL SELECT x.id, y.id, 'pace' FROM tx x JOIN tx y USING (sender_account_id)
  WHERE x.us - y.us BETWEEN 1 AND {H1H})"""


@query(
    "B11_stream_feature_row",
    f"""{WITH}, {RECEIVER_CTE}, {SAME_CTE}, {PACE_CTE}
SELECT id AS transaction_id, CAST(tx.amount AS DOUBLE) AS trans_amount,
  round(trunc((tx.us - acc.us) / 1000000.0) / 3600.0, 4) AS age_hours_open_acc,
  rcv.n AS receiver_txn_count_last_3d, rcv.u AS unique_senders_last_3d, same.n AS multi_same_amt_count_2d,
  pace.n AS sender_txn_count_last_1h, round(CAST(pace.v AS DOUBLE), 2) AS sender_volume_last_1h
FROM tx JOIN rcv USING (id) JOIN same USING (id) JOIN pace USING (id)
  LEFT JOIN acc ON acc.id = tx.sender_account_id""",
)
def stream_feature_row(spark, d):
    row = plan.stream_feature_row(tx_events(spark, d), accounts(spark, d))
    return row.withColumn("age_hours_open_acc", F.round("age_hours_open_acc", 4)).withColumn(
        "sender_volume_last_1h", F.round("sender_volume_last_1h", 2)
    )


@query(
    "B12_conditional_agg",
    f"""WITH {TX_SQL} SELECT receiver_account_id,
  count(CASE WHEN amount >= 100 THEN id END) AS large_count,
  count(DISTINCT CASE WHEN amount >= 100 THEN sender_account_id END) AS large_senders,
  CAST(sum(CASE WHEN is_fraud THEN amount END) AS DOUBLE) AS fraud_amount,
  count(*) FILTER (WHERE amount = 0) AS zero_count
FROM tx GROUP BY receiver_account_id""",
)
def conditional_agg(spark, d):
    tx = tx_events(spark, d)
    large = F.col("amount") >= 100
    return tx.groupBy(RECEIVER).agg(
        F.count(F.when(large, F.col("id"))).alias("large_count"),
        F.count_distinct(F.when(large, F.col(SENDER))).alias("large_senders"),
        F.sum(F.when(F.col("is_fraud"), F.col("amount"))).cast("double").alias("fraud_amount"),
        F.count_if(F.col("amount") == 0).alias("zero_count"),
    )


# --- C: joins ----------------------------------------------------------------------


@query(
    "C1_join_left_equi",
    f"""{WITH} SELECT t.id, s.account_number AS sender_account, s.account_type AS sender_type,
  r.account_number AS receiver_account
FROM tx t LEFT JOIN acc s ON s.id = t.sender_account_id
  LEFT JOIN acc r ON r.id = t.receiver_account_id""",
)
def join_left_equi(spark, d):
    return joins.enrich_accounts(tx_events(spark, d), accounts(spark, d)).select(
        "id", "sender_account", "sender_type", "receiver_account"
    )


@query(
    "C2_join_range_self",
    f"""WITH {TX_SQL} SELECT t.id, count(p.id) AS earlier_rows,
  CAST(coalesce(sum(p.amount), 0) AS DOUBLE) AS earlier_amount
FROM tx t LEFT JOIN tx p ON p.receiver_account_id = t.receiver_account_id AND p.id <> t.id
  AND p.us >= t.us - {DAY} AND p.us < t.us
GROUP BY t.id""",
)
def join_range_self(spark, d):
    out = trailing(
        with_clock(tx_events(spark, d)).select("id", "us", RECEIVER, "amount"),
        [RECEIVER],
        DAY,
        {"earlier_rows": F.lit(1).cast("long"), "earlier_amount": F.col("amount")},
    )
    return out.select(
        "id", "earlier_rows", F.col("earlier_amount").cast("double").alias("earlier_amount")
    )


@query(
    "C3_join_or_theta_self",
    f"""WITH {TX_SQL}, {PAIRS}
SELECT tx.id, count(DISTINCT other) AS matched_rows,
  count(*) FILTER (WHERE rule = 'receiver') AS by_receiver,
  count(*) FILTER (WHERE rule = 'amount') AS by_amount,
  count(*) FILTER (WHERE rule = 'pace') AS by_pace
FROM tx LEFT JOIN pairs ON pairs.id = tx.id GROUP BY tx.id""",
)
def join_or_theta_self(spark, d):
    return joins.or_theta_counts(with_clock(tx_events(spark, d)))


@query(
    "C4_join_asof_previous",
    f"""WITH {TX_SQL} SELECT t.id, p.us AS previous_us, p.id AS previous_id
FROM tx t ASOF LEFT JOIN tx p
  ON p.sender_account_id = t.sender_account_id AND p.us < t.us""",
)
def join_asof_previous(spark, d):
    return joins.previous_of_sender(plan.ledger_rows(tx_events(spark, d))).select(
        "id", F.col("previous.us").alias("previous_us"), F.col("previous.id").alias("previous_id")
    )


@query("C5_join_feature_assembly", f"{PROFILE_SQL} {PROFILE_OUT}")
def join_feature_assembly(spark, d):
    tx = tx_events(spark, d)
    parts = [
        plan.account_age(tx, accounts(spark, d)).drop("age_hours_whole_seconds"),
        plan.receiver_features(tx),
        plan.sender_features(tx),
    ]
    return profile_out(joins.assemble(tx, parts))


@query(
    "C6_join_anti_orphans",
    f"""{WITH}, open_acc AS (SELECT * FROM acc WHERE status = 'ACTIVE')
SELECT t.id, 'sender' AS side, t.sender_account_id AS account_id FROM tx t
  WHERE t.sender_account_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM open_acc a WHERE a.id = t.sender_account_id)
UNION ALL
SELECT t.id, 'receiver', t.receiver_account_id FROM tx t
  WHERE NOT EXISTS (SELECT 1 FROM open_acc a WHERE a.id = t.receiver_account_id)""",
)
def join_anti_orphans(spark, d):
    # Accounts that are not ACTIVE stand in for missing ones: every id exists here.
    open_accounts = accounts(spark, d).where(F.col("status") == "ACTIVE")
    return joins.orphans(tx_events(spark, d), open_accounts)


@query(
    "C7_join_semi_membership",
    f"""{WITH} SELECT id, sender_account_id, receiver_account_id FROM tx
WHERE sender_account_id IN (SELECT id FROM acc WHERE user_id = 3)
   OR receiver_account_id IN (SELECT id FROM acc WHERE user_id = 3)""",
)
def join_semi_membership(spark, d):
    mine = accounts(spark, d).where(F.col("user_id") == 3).select("id")
    return joins.touching(tx_events(spark, d), mine).select("id", SENDER, RECEIVER)


@query(
    "C8_join_include_projection",
    f"""{WITH} SELECT t.id, CAST(t.amount AS DOUBLE) AS amount, s.id AS sender_id,
  s.account_name AS sender_name, s.account_number AS sender_number,
  r.id AS receiver_id, r.account_name AS receiver_name, r.account_number AS receiver_number
FROM tx t LEFT JOIN acc s ON s.id = t.sender_account_id
  JOIN acc r ON r.id = t.receiver_account_id""",
)
def join_include_projection(spark, d):
    rows = joins.with_account_structs(tx_events(spark, d), accounts(spark, d))
    return rows.select(
        "id",
        F.col("amount").cast("double").alias("amount"),
        F.col("sender_account.id").alias("sender_id"),
        F.col("sender_account.account_name").alias("sender_name"),
        F.col("sender_account.account_number").alias("sender_number"),
        F.col("receiver_account.id").alias("receiver_id"),
        F.col("receiver_account.account_name").alias("receiver_name"),
        F.col("receiver_account.account_number").alias("receiver_number"),
    )


@query(
    "C9_join_relation_quantifiers",
    f"""{WITH} SELECT a.id,
  EXISTS (SELECT 1 FROM tx t WHERE t.sender_account_id = a.id AND t.amount >= 200) AS some_match,
  NOT EXISTS (SELECT 1 FROM tx t WHERE t.sender_account_id = a.id AND t.amount >= 200) AS none_match,
  NOT EXISTS (SELECT 1 FROM tx t WHERE t.sender_account_id = a.id AND NOT (t.amount >= 200))
    AS every_match
FROM acc a""",
)
def join_relation_quantifiers(spark, d):
    return joins.relation_quantifiers(
        accounts(spark, d), tx_events(spark, d), SENDER, F.col("amount") >= 200
    )


@query(
    "C9_join_single_relation",
    f"""{WITH} SELECT t.id, s.status = 'SUSPENDED' AS sender_is_suspended,
  r.status IS NULL OR r.status <> 'CLOSED' AS receiver_is_not_closed
FROM tx t LEFT JOIN acc s ON s.id = t.sender_account_id
  LEFT JOIN acc r ON r.id = t.receiver_account_id""",
)
def join_single_relation(spark, d):
    return joins.single_relation(tx_events(spark, d), accounts(spark, d))


# --- W: windows --------------------------------------------------------------------


@query(
    "W1_rolling_time_left_closed",
    f"""WITH {ORDERS_SQL} SELECT t.id,
  (SELECT count(*) FROM tx p WHERE p.receiver_account_id = t.receiver_account_id
    AND p.us >= t.us - {H3D} AND p.us < t.us) AS received_3d,
  (SELECT count(*) FROM tx p WHERE p.sender_account_id = t.sender_account_id
    AND p.amount = t.amount AND p.us >= t.us - {H2D} AND p.us < t.us) AS same_amount_2d,
  (SELECT count(*) FROM tx p WHERE p.sender_account_id = t.sender_account_id
    AND p.us >= t.us - {H1H} AND p.us < t.us) AS sent_1h
FROM tx t""",
)
def rolling_left_closed(spark, d):
    """Three widths on the tie-heavy ledger."""
    one = F.lit(1).cast("long")
    t = with_clock(tx_orders(spark, d)).select("id", "us", SENDER, RECEIVER, "amount")
    t = trailing(t, [RECEIVER], H3D, {"received_3d": one})
    t = trailing_terms(
        t,
        [([SENDER], H1H, {"sent_1h": one}), ([SENDER, "amount"], H2D, {"same_amount_2d": one})],
    )
    return t.select("id", "received_3d", "same_amount_2d", "sent_1h")


@query(
    "W1_rolling_count_and_sum",
    f"""WITH {TX_SQL} SELECT t.id, count(p.id) AS sent_1h,
  CAST(coalesce(sum(p.amount), 0) AS DOUBLE) AS volume_1h
FROM tx t LEFT JOIN tx p ON p.sender_account_id = t.sender_account_id
  AND p.us >= t.us - {H1H} AND p.us < t.us GROUP BY t.id""",
)
def rolling_count_sum(spark, d):
    t = with_clock(tx_events(spark, d)).select("id", "us", SENDER, "amount")
    w = trailing(
        t, [SENDER], H1H, {"sent_1h": F.lit(1).cast("long"), "volume_1h": F.col("amount")}
    )
    return w.select("id", "sent_1h", F.col("volume_1h").cast("double").alias("volume_1h"))


@query(
    "W2_rolling_distinct",
    f"""WITH {ORDERS_SQL} SELECT t.id, count(DISTINCT p.sender_account_id) AS senders_3d
FROM tx t LEFT JOIN tx p ON p.receiver_account_id = t.receiver_account_id
  AND p.us >= t.us - {H3D} AND p.us < t.us GROUP BY t.id""",
)
def rolling_distinct(spark, d):
    return plan.receiver_features(tx_orders(spark, d)).select(
        F.col("transaction_id").alias("id"), F.col("unique_senders_last_3d").alias("senders_3d")
    )


@query(
    "W3_lag_by_key",
    f"""WITH {ORDERS_SQL} SELECT id, lag(us) OVER w AS previous_us, lag(id) OVER w AS previous_id,
  round(coalesce((us - lag(us) OVER w) / 86400000000.0, 9999.0), 4) AS days_since
FROM tx WINDOW w AS (PARTITION BY sender_account_id ORDER BY us, id)""",
)
def lag_by_key(spark, d):
    t = with_clock(tx_orders(spark, d)).select("id", "us", SENDER)
    lagged = windows.lag_by_key(t, SENDER)
    gap = days_between(F.col("us"), F.col("previous.us"))
    return lagged.select(
        "id",
        F.col("previous.us").alias("previous_us"),
        F.col("previous.id").alias("previous_id"),
        F.round(F.coalesce(gap, F.lit(9999.0)), 4).alias("days_since"),
    )


@query(
    "W4_first_per_group",
    f"""WITH {TX_SQL} SELECT DISTINCT ON (sender_account_id) sender_account_id, id, us,
  CAST(amount AS DOUBLE) AS amount
FROM tx ORDER BY sender_account_id, us DESC, id DESC""",
)
def first_per_group(spark, d):
    t = with_clock(tx_events(spark, d))
    top = windows.first_per_group(t, [SENDER], ["us", "id"], ["amount"])
    return top.select(SENDER, "id", "us", F.col("amount").cast("double").alias("amount"))


@query(
    "W4_distinct_rows",
    f"WITH {TX_SQL} SELECT DISTINCT sender_account_id, receiver_account_id FROM tx",
)
def distinct_rows(spark, d):
    return tx_events(spark, d).select(SENDER, RECEIVER).distinct()


# --- a ledger with a hub --------------------------------------------------------------

# The hub is hot at every scale of the tables, and its rush hour holds many lanes.
HUB_HEAT = Heat(min_rows=100, max_keys=1000, lane_rows=100)


@query("B10_fraud_features_skewed", f"{PROFILE_SQL.replace(TX_SQL, SKEWED_SQL)} {PROFILE_OUT}")
def fraud_features_skewed(spark, d):
    return profile_out(plan.fraud_features(tx_skewed(spark, d), accounts(spark, d), HUB_HEAT))


@query(
    "C1_join_left_equi_skewed",
    f"""WITH {SKEWED_SQL}, {ACC_SQL} SELECT t.id, s.account_number AS sender_account, s.account_type AS sender_type,
  r.account_number AS receiver_account
FROM tx t LEFT JOIN acc s ON s.id = t.sender_account_id LEFT JOIN acc r ON r.id = t.receiver_account_id""",
)
def join_left_equi_skewed(spark, d):
    return joins.enrich_accounts(tx_skewed(spark, d), accounts(spark, d), HUB_HEAT).select(
        "id", "sender_account", "sender_type", "receiver_account"
    )


@query(
    "C3_join_or_theta_self_skewed",
    f"""WITH {SKEWED_SQL}, {PAIRS}
SELECT tx.id, count(DISTINCT other) AS matched_rows,
  count(*) FILTER (WHERE rule = 'receiver') AS by_receiver,
  count(*) FILTER (WHERE rule = 'amount') AS by_amount,
  count(*) FILTER (WHERE rule = 'pace') AS by_pace
FROM tx LEFT JOIN pairs ON pairs.id = tx.id GROUP BY tx.id""",
)
def join_or_theta_self_skewed(spark, d):
    return joins.or_theta_counts(with_clock(tx_skewed(spark, d)), HUB_HEAT)


@query(
    "W3_lag_by_key_skewed",
    f"""WITH {SKEWED_SQL} SELECT id, lag(us) OVER w AS previous_us, lag(id) OVER w AS previous_id,
  round(coalesce((us - lag(us) OVER w) / 86400000000.0, 9999.0), 4) AS days_since
FROM tx WINDOW w AS (PARTITION BY sender_account_id ORDER BY us, id)""",
)
def lag_by_key_skewed(spark, d):
    lagged = windows.lag_by_key(with_clock(tx_skewed(spark, d)).select("id", "us", SENDER), SENDER, HUB_HEAT)
    gap = days_between(F.col("us"), F.col("previous.us"))
    return lagged.select(
        "id",
        F.col("previous.us").alias("previous_us"),
        F.col("previous.id").alias("previous_id"),
        F.round(F.coalesce(gap, F.lit(9999.0)), 4).alias("days_since"),
    )
