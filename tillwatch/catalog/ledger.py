"""Ledger searches, aggregates, paging, maintenance and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import PROVINCES
from ..functions.predicates import order, where
from ..functions.text import location_label, masked_number
from ..operators import aggregates as agg
from ..operators import ledger, maintenance as upkeep, quality
from ..operators.history import RECEIVER, SENDER, with_clock
from ..operators.hotkeys import lookup
from ..schemas import ACCOUNT_STATUSES, ACCOUNT_TYPES, PROFILE
from ..session import materialise, work_dir
from ..sources.fixtures import ACC_SQL, TX_SQL, accounts, tx_events
from ..sources.manifest import LedgerStore
from .features import PROFILE_SQL, profile
from .registry import query

WITH = f"WITH {TX_SQL},\n{ACC_SQL}"
ME = 3
OWN_SQL = f"own AS (SELECT id FROM acc WHERE user_id = {ME})"
MINE_SQL = f"""{OWN_SQL}, mine AS (SELECT * FROM tx
  WHERE sender_account_id IN (SELECT id FROM own) OR receiver_account_id IN (SELECT id FROM own))"""

ACCOUNT_OUT = """id, account_number, account_name, account_type, status,
  CAST(balance AS DOUBLE) AS balance, currency, us AS created_us"""


def account_out(df, *extra):
    return df.select(
        "id",
        "account_number",
        "account_name",
        "account_type",
        "status",
        F.col("balance").cast("double").alias("balance"),
        "currency",
        F.unix_micros("created_at").alias("created_us"),
        *extra,
    )


def own_ids(spark, d):
    return accounts(spark, d).where(F.col("user_id") == ME).select("id")


# --- E: filters and projections ----------------------------------------------------


@query(
    "E1_account_search",
    f"""{WITH} SELECT {ACCOUNT_OUT} FROM acc
WHERE (lower(account_name) LIKE '%omer#00000001%' OR account_number LIKE '%OMER#00000001%')
  AND account_type = 'SAVINGS' AND status = 'ACTIVE'""",
)
def account_search(spark, d):
    return account_out(
        ledger.account_search(accounts(spark, d), "OMER#00000001", "SAVINGS", "ACTIVE")
    )


@query(
    "E2_transfer_candidates",
    f"""{WITH} SELECT {ACCOUNT_OUT},
  CASE WHEN user_id = {ME} THEN 'source' ELSE 'destination' END AS role
FROM acc WHERE status = 'ACTIVE'""",
)
def transfer_candidates(spark, d):
    return account_out(ledger.transfer_candidates(accounts(spark, d), ME), "role")


@query("E3_user_accounts", f"{WITH} SELECT {ACCOUNT_OUT} FROM acc WHERE user_id = {ME}")
def user_accounts(spark, d):
    return account_out(ledger.user_accounts(accounts(spark, d), ME))


@query(
    "E4_transfer_eligibility",
    f"""{WITH}, checked AS (SELECT t.id, t.sender_account_id, t.receiver_account_id, t.amount,
  concat_ws(',', CASE WHEN t.sender_account_id IS NULL OR t.receiver_account_id IS NULL
      THEN 'ACCOUNT_MISSING' END,
    CASE WHEN t.amount <= 0 THEN 'AMOUNT_NOT_POSITIVE' END,
    CASE WHEN t.sender_account_id = t.receiver_account_id THEN 'SAME_ACCOUNT' END,
    CASE WHEN coalesce(a.balance, 0) < t.amount THEN 'INSUFFICIENT_BALANCE' END) AS reasons
  FROM tx t LEFT JOIN acc a ON a.id = t.sender_account_id)
SELECT id, sender_account_id, receiver_account_id, CAST(amount AS DOUBLE) AS amount, reasons,
  reasons = '' AS eligible FROM checked""",
)
def transfer_eligibility(spark, d):
    checked = ledger.transfer_eligibility(tx_events(spark, d), accounts(spark, d))
    return checked.withColumn("amount", F.col("amount").cast("double"))


@query(
    "E5_flow_direction",
    f"""{WITH}, {OWN_SQL} SELECT t.id, t.sender_account_id IN (SELECT id FROM own) AS is_debit,
  t.receiver_account_id IN (SELECT id FROM own) AS receiver_is_own,
  CAST(CASE WHEN t.sender_account_id IN (SELECT id FROM own) THEN -t.amount ELSE t.amount END
    AS DOUBLE) AS signed_amount,
  CASE WHEN t.sender_account_id IN (SELECT id FROM own) THEN '-' ELSE '+' END
    || '$' || printf('%.2f', CAST(t.amount AS DOUBLE)) AS amount_label,
  substr(coalesce(nullif(s.account_name, ''), nullif(s.account_number, ''), 'External / Top-up'), 1, 8)
    AS sender_label,
  substr(coalesce(nullif(r.account_name, ''), nullif(r.account_number, ''),
    CAST(t.receiver_account_id AS VARCHAR)), 1, 8) AS receiver_label
FROM tx t LEFT JOIN acc s ON s.id = t.sender_account_id
  LEFT JOIN acc r ON r.id = t.receiver_account_id""",
)
def flow_direction(spark, d):
    rows = ledger.flow_direction(tx_events(spark, d), accounts(spark, d), own_ids(spark, d))
    return rows.withColumn("signed_amount", F.col("signed_amount").cast("double"))


@query(
    "E6_history_text_search",
    f"""WITH {TX_SQL} SELECT id, reference, description, CAST(amount AS DOUBLE) AS amount FROM tx
WHERE contains(lower(reference), '17') OR contains(lower(description), '17')
  OR contains(CAST(CAST(amount AS BIGINT) AS VARCHAR), '17')""",
)
def history_text_search(spark, d):
    hits = ledger.history_text_search(tx_events(spark, d), "17")
    return hits.select("id", "reference", "description", F.col("amount").cast("double").alias("amount"))


@query(
    "E7_account_label",
    f"""{WITH} SELECT t.id, '•••• ' || right(a.account_number, 4) AS masked_number,
  CASE WHEN t.latitude IS NULL OR t.longitude IS NULL THEN '—'
    ELSE printf('%.3f', t.latitude) || ', ' || printf('%.3f', t.longitude) END AS location
FROM tx t LEFT JOIN acc a ON a.id = t.receiver_account_id""",
)
def account_label(spark, d):
    numbers = accounts(spark, d).select(F.col("id").alias("account_key"), "account_number")
    rows = lookup(tx_events(spark, d), numbers, RECEIVER, "account_key")
    return rows.select(
        "id",
        masked_number(F.col("account_number")).alias("masked_number"),
        location_label(F.col("latitude"), F.col("longitude")).alias("location"),
    )


@query(
    "E8_field_predicates",
    f"""WITH {TX_SQL} SELECT id, description, fraud_type FROM tx
WHERE amount >= 20 AND amount < 150 AND currency IN ('USD', 'KHR')
  AND (lower(description) LIKE lower('CL%') OR reference LIKE '%7' OR fraud_type IS NULL)
  AND fraud_type NOT IN ('VELOCITY_SPIKE', 'LOCATION_JUMP')
  AND NOT (lower(description) LIKE '%err%' AND risk_score > 50)
  AND risk_score <= 90 AND receiver_account_id <> 5 AND sender_account_id IS NOT NULL""",
)
def field_predicates(spark, d):
    wanted = {
        "amount": {"gte": 20, "lt": 150},
        "currency": {"in": ["USD", "KHR"]},
        "OR": [
            {"description": {"startsWith": "CL", "mode": "insensitive"}},
            {"reference": {"endsWith": "7"}},
            {"fraud_type": {"equals": None}},
        ],
        "AND": [{"fraud_type": {"notIn": ["VELOCITY_SPIKE", "LOCATION_JUMP"]}}],
        "NOT": {"description": {"contains": "ERR", "mode": "insensitive"}, "risk_score": {"gt": 50}},
        "risk_score": {"lte": 90},
        RECEIVER: {"not": 5},
        SENDER: {"not": None},
    }
    return tx_events(spark, d).where(where(wanted)).select("id", "description", "fraud_type")


def _province_sql() -> str:
    rows = ", ".join(f"({i}, '{n}', {a}, {o})" for i, n, a, o in PROVINCES)
    return f"""place AS (SELECT * FROM (VALUES {rows}) v(pid, province, plat, plon)),
near AS (SELECT t.id, p.pid, p.province,
    2 * 6371.0 * asin(sqrt(pow(sin((radians(CAST(p.plat AS DOUBLE)) - radians(t.latitude)) / 2), 2)
      + cos(radians(t.latitude)) * cos(radians(CAST(p.plat AS DOUBLE)))
      * pow(sin((radians(CAST(p.plon AS DOUBLE)) - radians(t.longitude)) / 2), 2))) AS km
  FROM tx t, place p)"""


@query(
    "E9_nearest_province",
    f"""WITH {TX_SQL}, {_province_sql()}
SELECT id, arg_min(province, km) AS province, round(min(km), 4) AS km FROM near GROUP BY id""",
)
def nearest_province(spark, d):
    return ledger.with_province(tx_events(spark, d)).select(
        "id", "nearest.province", F.round("nearest.km", 4).alias("km")
    )


# --- F: aggregates -----------------------------------------------------------------


@query(
    "F1_account_summary",
    f"""{WITH} SELECT
  CAST(coalesce(sum(CASE WHEN balance > 0 THEN balance END), 0) AS DOUBLE) AS total_balance,
  CAST(coalesce(sum(CASE WHEN balance < 0 THEN -balance END), 0) AS DOUBLE) AS total_liabilities,
  count(*) FILTER (WHERE status = 'ACTIVE') AS active_count, count(*) AS total_count,
  count(*) FILTER (WHERE (lower(account_name) LIKE '%77%' OR account_number LIKE '%77%')
    AND account_type = 'CREDIT') AS shown_count
FROM acc""",
)
def account_summary(spark, d):
    cards = ledger.account_summary(accounts(spark, d), ledger.search_match("77", "CREDIT"))
    return cards.select(
        F.col("total_balance").cast("double").alias("total_balance"),
        F.col("total_liabilities").cast("double").alias("total_liabilities"),
        "active_count",
        "total_count",
        "shown_count",
    )


KPI_SQL = f"""WITH {TX_SQL},
newest AS (SELECT * FROM tx ORDER BY created_at DESC, id DESC LIMIT 30)
SELECT count(*) AS events, count(*) FILTER (WHERE is_fraud) AS fraud_events,
  CAST(floor(100.0 * count(*) FILTER (WHERE is_fraud) / count(*) + 0.5) AS BIGINT) AS review_rate,
  CAST(sum(amount) AS DOUBLE) AS volume FROM newest"""


@query("F2_monitoring_kpis", KPI_SQL)
def monitoring_kpis(spark, d):
    kpis = agg.monitoring_kpis(tx_events(spark, d))
    return kpis.withColumn("volume", F.col("volume").cast("double"))


@query(
    "F3_ledger_counts",
    f"""WITH {TX_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE is_fraud) AS fraud,
  count(*) FILTER (WHERE NOT is_fraud) AS normal,
  round(100.0 * count(*) FILTER (WHERE is_fraud) / count(*), 2) AS fraud_percentage FROM tx""",
)
def ledger_counts(spark, d):
    return agg.ledger_counts(tx_events(spark, d))


@query(
    "F4_class_balance",
    f"""WITH {TX_SQL} SELECT CAST(is_fraud AS INTEGER) AS label, count(*) AS n,
  round(count(*) / (SELECT count(*) FROM tx), 6) AS share FROM tx GROUP BY is_fraud""",
)
def class_balance(spark, d):
    return agg.class_balance(tx_events(spark, d)).withColumn("share", F.round("share", 6))


@query(
    "F5_fraud_type_breakdown",
    f"WITH {TX_SQL} SELECT fraud_type, count(*) AS n FROM tx WHERE is_fraud GROUP BY fraud_type",
)
def fraud_type_breakdown(spark, d):
    return agg.fraud_type_breakdown(tx_events(spark, d))


MISSING = ["transaction_id", *PROFILE, "is_fraud", "fraud_type"]


@query(
    "F6_missing_values",
    PROFILE_SQL
    + " UNION ALL ".join(
        f" SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM profile"
        for c in MISSING
    ),
)
def missing_values(spark, d):
    return agg.missing_values(profile(spark, d).select(*MISSING))


CORRELATED = [*PROFILE, "is_fraud"]


@query(
    "F7_correlation_matrix",
    PROFILE_SQL.replace("profile AS (", "profile AS MATERIALIZED (")
    + " UNION ALL ".join(
        f" SELECT '{a}' AS column_a, '{b}' AS column_b, "
        f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS correlation FROM profile"
        for a in CORRELATED
        for b in CORRELATED
    ),
)
def correlation_matrix(spark, d):
    m = agg.correlation_matrix(
        profile(spark, d).withColumn("is_fraud", F.col("is_fraud").cast("int")), CORRELATED
    )
    return m.withColumn("correlation", F.round("correlation", 6))


BINS = {
    "trans_amount": 20.0,
    "age_hours_open_acc": 240.0,
    "receiver_txn_count_last_3d": 2.0,
    "unique_senders_last_3d": 2.0,
    "multi_same_amt_count_2d": 1.0,
    "sender_txn_count_last_1h": 1.0,
    "sender_volume_last_1h": 20.0,
    "days_since_last_trans": 0.5,
    "geo_speed_kmh": 250.0,
}


@query(
    "F8_feature_distribution",
    PROFILE_SQL.replace("profile AS (", "profile AS MATERIALIZED (")
    + ", long AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(is_fraud AS INTEGER) AS label, "
        f"CAST({c} AS DOUBLE) AS value, CAST({w} AS DOUBLE) AS w FROM profile"
        for c, w in BINS.items()
    )
    + """) SELECT feature, label, CAST(floor(value / w) AS BIGINT) AS bin, count(*) AS n,
  round(min(value), 4) AS lowest, round(max(value), 4) AS highest
FROM long WHERE value IS NOT NULL GROUP BY 1, 2, 3""",
)
def feature_distribution(spark, d):
    h = agg.feature_histogram(profile(spark, d), BINS, "is_fraud")
    return h.withColumn("lowest", F.round("lowest", 4)).withColumn("highest", F.round("highest", 4))


QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query(
    "F8_feature_quantiles",
    PROFILE_SQL.replace("profile AS (", "profile AS MATERIALIZED (")
    + ", long AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(is_fraud AS INTEGER) AS label, CAST({c} AS DOUBLE) AS value FROM profile" for c in PROFILE
    )
    + "), found AS ("
    + " UNION ALL ".join(
        f"SELECT label, feature, CAST({p} AS DOUBLE) AS probability, quantile_cont(value, {p}) AS value FROM long GROUP BY 1, 2" for p in QUANTILES
    )
    + ") SELECT label, feature, probability, round(value, 6) AS value FROM found WHERE value IS NOT NULL",
)
def feature_quantiles(spark, d):
    rows = materialise(profile(spark, d), "profile")
    found = agg.feature_quantiles(rows, PROFILE, "is_fraud", QUANTILES)
    return found.withColumn("value", F.round("value", 6))


@query(
    "F9_tx_aggregate",
    f"""WITH {TX_SQL} SELECT count(*) AS count_all, count(amount) AS count_value,
  round(avg(CAST(amount AS DOUBLE)), 4) AS avg_value, CAST(sum(amount) AS DOUBLE) AS sum_value,
  CAST(min(amount) AS DOUBLE) AS min_value, CAST(max(amount) AS DOUBLE) AS max_value
FROM tx WHERE NOT is_fraud AND amount > 0""",
)
def tx_aggregate(spark, d):
    out = agg.tx_aggregate(tx_events(spark, d), ~F.col("is_fraud") & (F.col("amount") > 0))
    return out.select(
        "count_all",
        "count_value",
        F.round(F.col("avg_value").cast("double"), 4).alias("avg_value"),
        *[F.col(c).cast("double").alias(c) for c in ("sum_value", "min_value", "max_value")],
    )


@query(
    "F10_tx_group_by_having",
    f"""WITH {TX_SQL} SELECT receiver_account_id, description, count(*) AS n,
  CAST(sum(amount) AS DOUBLE) AS sum_amount, round(avg(CAST(amount AS DOUBLE)), 4) AS avg_amount,
  CAST(min(amount) AS DOUBLE) AS min_amount, CAST(max(amount) AS DOUBLE) AS max_amount
FROM tx GROUP BY ALL HAVING count(*) >= 15 AND sum(amount) > 500
ORDER BY sum_amount DESC, receiver_account_id, description LIMIT 40 OFFSET 5""",
)
def tx_group_by_having(spark, d):
    out = agg.tx_group_by(
        tx_events(spark, d),
        [RECEIVER, "description"],
        having=(F.col("n") >= 15) & (F.col("sum_amount") > 500),
        order_by=[F.desc("sum_amount"), F.col(RECEIVER), F.col("description")],
        take=40,
        skip=5,
    )
    return out.select(
        RECEIVER,
        "description",
        "n",
        F.col("sum_amount").cast("double").alias("sum_amount"),
        F.round(F.col("avg_amount").cast("double"), 4).alias("avg_amount"),
        F.col("min_amount").cast("double").alias("min_amount"),
        F.col("max_amount").cast("double").alias("max_amount"),
    )


@query(
    "F11_active_currencies",
    f"""WITH {TX_SQL} SELECT coalesce(string_agg(currency, ', ' ORDER BY currency), 'None') AS currencies
FROM (SELECT DISTINCT currency FROM tx)""",
)
def active_currencies(spark, d):
    return agg.active_currencies(tx_events(spark, d))


LEGS_SQL = """legs AS (
  SELECT id, sender_account_id AS account_id, 'debit' AS leg, -amount AS signed_amount FROM tx
    WHERE sender_account_id IS NOT NULL
  UNION ALL SELECT id, receiver_account_id, 'credit', amount FROM tx
    WHERE receiver_account_id IS NOT NULL)"""


@query(
    "F12_account_net_flow",
    f"""{WITH}, {LEGS_SQL}, moved AS (SELECT account_id,
  sum(CASE WHEN leg = 'debit' THEN -signed_amount END) AS debits,
  sum(CASE WHEN leg = 'credit' THEN signed_amount END) AS credits FROM legs GROUP BY account_id)
SELECT a.id, CAST(a.balance AS DOUBLE) AS opening_balance,
  CAST(coalesce(m.debits, 0) AS DOUBLE) AS debits, CAST(coalesce(m.credits, 0) AS DOUBLE) AS credits,
  CAST(a.balance - coalesce(m.debits, 0) + coalesce(m.credits, 0) AS DOUBLE) AS closing_balance
FROM acc a LEFT JOIN moved m ON m.account_id = a.id""",
)
def account_net_flow(spark, d):
    flow = ledger.account_net_flow(accounts(spark, d), tx_events(spark, d))
    return flow.select("id", *[F.col(c).cast("double").alias(c) for c in flow.columns if c != "id"])


# --- G: order, pages, unions -------------------------------------------------------


@query(
    "G1_history_page",
    f"""{WITH}, {MINE_SQL},
page AS (SELECT * FROM mine ORDER BY created_at DESC, id DESC LIMIT 5 OFFSET 5)
SELECT p.id, p.us AS created_us, CAST(p.amount AS DOUBLE) AS amount,
  s.account_number AS sender_number, r.account_number AS receiver_number
FROM page p LEFT JOIN acc s ON s.id = p.sender_account_id JOIN acc r ON r.id = p.receiver_account_id""",
)
def history_page(spark, d):
    page = ledger.history_page(
        tx_events(spark, d), accounts(spark, d), own_ids(spark, d), page=2, limit=10
    )
    return page.select(
        "id",
        F.unix_micros("created_at").alias("created_us"),
        F.col("amount").cast("double").alias("amount"),
        F.col("sender_account.account_number").alias("sender_number"),
        F.col("receiver_account.account_number").alias("receiver_number"),
    )


@query(
    "G1_history_totals",
    f"""{WITH}, {MINE_SQL},
page AS (SELECT * FROM mine ORDER BY created_at DESC, id DESC LIMIT 5 OFFSET 5)
SELECT (SELECT count(*) FROM mine) AS total_count,
  (SELECT CAST(sum(amount) AS DOUBLE) FROM page) AS total_volume,
  CAST(2 AS BIGINT) AS page, CAST(5 AS BIGINT) AS page_size,
  (SELECT greatest(1, CAST(ceil(count(*) / 5.0) AS BIGINT)) FROM mine) AS total_pages,
  (SELECT 2 < greatest(1, ceil(count(*) / 5.0)) FROM mine) AS has_next_page,
  true AS has_prev_page""",
)
def history_totals(spark, d):
    totals = ledger.history_totals(tx_events(spark, d), own_ids(spark, d), page=2, limit=10)
    return totals.withColumn("total_volume", F.col("total_volume").cast("double"))


@query(
    "G2_latest_30",
    f"""WITH {TX_SQL} SELECT id, us AS created_us, CAST(amount AS DOUBLE) AS amount, is_fraud
FROM tx ORDER BY created_at DESC, id DESC LIMIT 30""",
)
def latest_30(spark, d):
    return ledger.latest(tx_events(spark, d)).select(
        "id",
        F.unix_micros("created_at").alias("created_us"),
        F.col("amount").cast("double").alias("amount"),
        "is_fraud",
    )


@query(
    "G3_order_by_nulls",
    f"""{WITH} SELECT t.id, t.fraud_type, CAST(t.amount AS DOUBLE) AS amount, a.account_name
FROM tx t LEFT JOIN acc a ON a.id = t.sender_account_id
ORDER BY t.fraud_type DESC NULLS LAST, a.account_name ASC NULLS FIRST, t.amount DESC, t.id LIMIT 200""",
)
def order_by_nulls(spark, d):
    names = accounts(spark, d).select(F.col("id").alias("account_key"), "account_name")
    rows = lookup(tx_events(spark, d), names, SENDER, "account_key")
    spec = [
        {"fraud_type": {"sort": "desc", "nulls": "last"}},
        {"account_name": {"sort": "asc", "nulls": "first"}},
        {"amount": "desc"},
        {"id": "asc"},
    ]
    return rows.orderBy(*order(spec)).limit(200).select(
        "id", "fraud_type", F.col("amount").cast("double").alias("amount"), "account_name"
    )


@query(
    "G3_order_by_relation_count",
    f"""{WITH}, sent AS (SELECT sender_account_id AS id, count(*) AS n FROM tx GROUP BY 1)
SELECT a.id, coalesce(s.n, 0) AS sent_count FROM acc a LEFT JOIN sent s ON s.id = a.id
ORDER BY sent_count DESC, a.id LIMIT 25""",
)
def order_by_relation_count(spark, d):
    sent = tx_events(spark, d).groupBy(F.col(SENDER).alias("id")).agg(
        F.count(F.lit(1)).alias("sent_count")
    )
    ranked = accounts(spark, d).select("id").join(sent, "id", "left").fillna(0, ["sent_count"])
    return ranked.orderBy(*order([{"sent_count": "desc"}, {"id": "asc"}])).limit(25)


@query(
    "G4_keyset_page",
    f"""WITH {TX_SQL} SELECT id, us FROM tx WHERE us < 1705314600000000
  OR (us = 1705314600000000 AND id < 500000) ORDER BY us DESC, id DESC LIMIT 20 OFFSET 3""",
)
def keyset_page(spark, d):
    t = with_clock(tx_events(spark, d)).select("id", "us")
    return ledger.keyset_page(t, (1705314600000000, 500000), take=20, skip=3)


@query(
    "G6_union_legs",
    f"WITH {TX_SQL}, {LEGS_SQL} SELECT id, account_id, leg, CAST(signed_amount AS DOUBLE) AS signed_amount FROM legs",
)
def union_legs(spark, d):
    out = ledger.legs(tx_events(spark, d))
    return out.withColumn("signed_amount", F.col("signed_amount").cast("double"))


# --- H: maintenance ----------------------------------------------------------------

# The ledger as loaded up to one day, and a later delivery that overlaps it and
# repeats itself.
LOADED_UNTIL = 1705708800000000
DELIVERED_FROM = 1705276800000000


@query(
    "H1_append_skip_duplicates",
    f"""WITH {TX_SQL}, loaded AS (SELECT id, us, amount FROM tx WHERE us < {LOADED_UNTIL}),
delivery AS (SELECT id, us, amount + 1 AS amount FROM tx WHERE us >= {DELIVERED_FROM})
SELECT id, us, CAST(amount AS DOUBLE) AS amount FROM loaded
UNION ALL SELECT id, us, CAST(amount AS DOUBLE) FROM delivery
  WHERE id NOT IN (SELECT id FROM loaded)""",
)
def append_skip_duplicates(spark, d):
    t = with_clock(tx_events(spark, d)).select("id", "us", "amount")
    loaded = t.where(F.col("us") < LOADED_UNTIL)
    once = t.where(F.col("us") >= DELIVERED_FROM)
    delivery = once.withColumn("amount", (F.col("amount") + 1).cast("decimal(18,2)"))
    again = once.withColumn("amount", (F.col("amount") + 2).cast("decimal(18,2)"))
    out = upkeep.append_skip_duplicates(loaded, delivery.unionByName(again), ["id"], ["amount"])
    return out.withColumn("amount", F.col("amount").cast("double"))


@query(
    "H2_upsert_latest",
    f"""{WITH} SELECT id, CASE WHEN balance < 0 THEN 'CLOSED' ELSE status END AS status,
  CAST(CASE WHEN balance < 0 THEN balance + 10 ELSE balance END AS DOUBLE) AS balance,
  CASE WHEN balance < 0 THEN us + 2000 ELSE us END AS version FROM acc
UNION ALL SELECT id + 1000000, 'ACTIVE', 0.0, us FROM acc WHERE balance < 0""",
)
def upsert_latest(spark, d):
    base = accounts(spark, d).select(
        "id", "status", "balance", F.unix_micros("created_at").alias("version")
    )
    touched = base.where(F.col("balance") < 0)
    newer = touched.select(
        "id", F.lit("CLOSED").alias("status"), (F.col("balance") + 10).cast("decimal(18,2)").alias("balance"),
        (F.col("version") + 2000).alias("version"),
    )
    stale = touched.select(
        "id", F.lit("SUSPENDED").alias("status"), "balance", (F.col("version") + 1000).alias("version")
    )
    added = touched.select(
        (F.col("id") + 1000000).alias("id"), F.lit("ACTIVE").alias("status"),
        F.lit(0).cast("decimal(18,2)").alias("balance"), "version",
    )
    changes = newer.unionByName(stale).unionByName(added)
    out = upkeep.upsert_latest(base, changes, ["id"], ["version"])
    return out.withColumn("balance", F.col("balance").cast("double"))


@query(
    "H3_update_where",
    f"""{WITH} SELECT id, CASE WHEN status = 'SUSPENDED' THEN 'ACTIVE' ELSE status END AS status,
  CAST(CASE WHEN status = 'SUSPENDED' THEN balance * 2 + 5 ELSE balance END AS DOUBLE) AS balance
FROM acc""",
)
def update_where(spark, d):
    base = accounts(spark, d).select("id", "status", "balance")
    hit = F.col("status") == "SUSPENDED"
    doubled = upkeep.update_where(base, hit, {"balance": upkeep.multiply("balance", 2)})
    raised = upkeep.update_where(doubled, hit, {"balance": upkeep.increment("balance", 5)})
    out = upkeep.update_where(raised, hit, {"status": F.lit("ACTIVE")})
    return out.withColumn("balance", F.col("balance").cast("double"))


CLOSED_GONE = """gone AS (SELECT id FROM acc WHERE status = 'CLOSED'
  AND id NOT IN (SELECT receiver_account_id FROM tx))"""


@query(
    "H4_delete_where",
    f"""{WITH}, {CLOSED_GONE} SELECT id, receiver_account_id,
  CASE WHEN sender_account_id IN (SELECT id FROM gone) THEN NULL ELSE sender_account_id END
    AS sender_account_id FROM tx WHERE amount > 0""",
)
def delete_where(spark, d):
    tx = tx_events(spark, d).select("id", SENDER, RECEIVER, "amount")
    _, rows = upkeep.delete_accounts(accounts(spark, d), tx, F.col("status") == "CLOSED")
    return upkeep.delete_where(rows, ~(F.col("amount") > 0)).select("id", SENDER, RECEIVER)


@query(
    "H4_delete_accounts",
    f"{WITH}, {CLOSED_GONE} SELECT id, status FROM acc WHERE id NOT IN (SELECT id FROM gone)",
)
def delete_accounts(spark, d):
    left, _ = upkeep.delete_accounts(
        accounts(spark, d), tx_events(spark, d), F.col("status") == "CLOSED"
    )
    return left.select("id", "status")


@query(
    "H4_delete_user_cascade",
    f"""{WITH} SELECT id, CASE WHEN id IN (SELECT receiver_account_id FROM tx)
  THEN 'restricted' ELSE 'deleted' END AS outcome FROM acc WHERE user_id = {ME}""",
)
def delete_user_cascade(spark, d):
    return upkeep.account_deletion(
        accounts(spark, d), tx_events(spark, d), F.col("user_id") == ME
    )


def after_user_deletion(spark, d):
    """A user who has received money can't go; once those payments are gone, user and accounts do."""
    acc, tx = accounts(spark, d), tx_events(spark, d)
    store = LedgerStore(spark, work_dir(spark, "ledger-store"), acc.schema, tx.schema)
    store.create(acc, tx)
    me = F.col("user_id") == ME
    done = [store.delete_users(me), store.delete_received(me), store.delete_users(me)]
    return store, done


MY_ACCOUNTS = f"(SELECT id FROM acc WHERE user_id = {ME})"


@query("H4_delete_user_accounts", f"{WITH} SELECT id, status, user_id FROM acc WHERE user_id IS NULL OR user_id <> {ME}")
def delete_user_accounts(spark, d):
    store, _ = after_user_deletion(spark, d)
    return store.read("accounts").select("id", "status", "user_id")


@query(
    "H4_delete_user_transactions",
    f"""{WITH} SELECT id, CASE WHEN sender_account_id IN {MY_ACCOUNTS} THEN NULL ELSE sender_account_id END AS sender_account_id,
  receiver_account_id, CAST(amount AS DOUBLE) AS amount FROM tx WHERE receiver_account_id NOT IN {MY_ACCOUNTS}""",
)
def delete_user_transactions(spark, d):
    store, _ = after_user_deletion(spark, d)
    return store.read("transactions").select("id", SENDER, RECEIVER, F.col("amount").cast("double").alias("amount"))


@query(
    "H4_delete_user_versions",
    f"""{WITH}, t AS (SELECT count(*) AS n, count(sender_account_id) AS sent FROM tx),
k AS (SELECT count(*) AS n, count(CASE WHEN sender_account_id NOT IN {MY_ACCOUNTS} THEN 1 END) AS sent,
  count(sender_account_id) AS before FROM tx WHERE receiver_account_id NOT IN {MY_ACCOUNTS}),
a AS (SELECT count(*) AS n, count(*) FILTER (WHERE user_id IS NULL OR user_id <> {ME}) AS kept FROM acc),
r AS (SELECT count(*) > 0 AS refused FROM tx WHERE receiver_account_id IN {MY_ACCOUNTS})
SELECT 'first' AS version, a.n AS accounts, t.n AS transactions, t.sent AS with_sender, r.refused FROM a, t, r
UNION ALL SELECT 'payments gone', a.n, k.n, k.before, false FROM a, k
UNION ALL SELECT 'user gone', a.kept, k.n, k.sent, false FROM a, k""",
)
def delete_user_versions(spark, d):
    """Every version holds both tables as of one statement."""
    store, done = after_user_deletion(spark, d)
    rows = []
    for version, (name, refused) in enumerate([("first", not done[0]), ("payments gone", False), ("user gone", False)], 1):
        tx = store.read("transactions", version).agg(F.count(F.lit(1)).alias("transactions"), F.count(SENDER).alias("with_sender"))
        n = store.read("accounts", version).agg(F.count(F.lit(1)).alias("accounts")).first()[0]
        rows.append(tx.select(F.lit(name).alias("version"), F.lit(n).cast("long").alias("accounts"), "transactions", "with_sender", F.lit(refused).alias("refused")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- Q: quality --------------------------------------------------------------------

NOW_US = 1706486400000000


@query(
    "Q1_dq_tx_rules",
    f"""{WITH}, j AS (SELECT t.id, t.us, s.us AS s_us, r.us AS r_us FROM tx t
  LEFT JOIN acc s ON s.id = t.sender_account_id LEFT JOIN acc r ON r.id = t.receiver_account_id)
SELECT id AS key, 'RECEIVER_NOT_FOUND' AS rule FROM j WHERE r_us IS NULL
UNION ALL SELECT id, 'BEFORE_SENDER_ACCOUNT' FROM j WHERE us < s_us
UNION ALL SELECT id, 'BEFORE_RECEIVER_ACCOUNT' FROM j WHERE us < r_us
UNION ALL SELECT id, 'IN_FUTURE' FROM j WHERE us > {NOW_US}""",
)
def dq_tx_rules(spark, d):
    return quality.tx_rules(tx_events(spark, d), accounts(spark, d), NOW_US)


@query(
    "Q2_dq_expected_counts",
    f"""WITH {TX_SQL}, a AS (SELECT count(*) AS total, count(*) FILTER (WHERE is_fraud) AS fraud,
  count(*) FILTER (WHERE NOT is_fraud) AS normal FROM tx)
SELECT 'total' AS measure, total AS actual, CAST(10000 AS BIGINT) AS expected, total = 10000 AS passed FROM a
UNION ALL SELECT 'fraud', fraud, CAST(3000 AS BIGINT), fraud = 3000 FROM a
UNION ALL SELECT 'normal', normal, CAST(7000 AS BIGINT), normal = 7000 FROM a""",
)
def dq_expected_counts(spark, d):
    return quality.expected_counts(
        tx_events(spark, d), {"total": 10000, "fraud": 3000, "normal": 7000}
    )


def _reasons_sql() -> str:
    parts = [
        "CASE WHEN trans_amount IS NULL THEN 'trans_amount:required' "
        "WHEN NOT (trans_amount > 0) THEN 'trans_amount:not_positive' END"
    ]
    parts += [
        f"CASE WHEN {c} IS NULL THEN '{c}:required' WHEN NOT ({c} >= 0) THEN '{c}:negative' END"
        for c in quality.NON_NEGATIVE
    ]
    return "concat_ws(',', " + ", ".join(parts) + ")"


@query(
    "Q3_dq_feature_request",
    f"""{PROFILE_SQL}, checked AS (SELECT transaction_id, {_reasons_sql()} AS reasons FROM profile)
SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, reasons, reasons = '' AS valid,
  'unknown' AS sender_account_id FROM checked""",
)
def dq_feature_request(spark, d):
    rows = quality.with_request_defaults(profile(spark, d))
    return quality.check_requests(rows).select("transaction_id", "reasons", "valid", SENDER)


@query(
    "Q4_dq_uniqueness",
    f"""{WITH}, found AS (
  SELECT 'tx_id' AS rule, CAST(id AS VARCHAR) AS key, count(*) AS n FROM tx GROUP BY id
  UNION ALL SELECT 'tx_reference', reference, count(*) FROM tx GROUP BY reference
  UNION ALL SELECT 'account_number', account_number, count(*) FROM acc GROUP BY account_number
  UNION ALL SELECT 'line_item', l_orderkey || '|' || l_linenumber, count(*)
    FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT * FROM found WHERE n > 1""",
)
def dq_uniqueness(spark, d):
    tx, acc = tx_events(spark, d), accounts(spark, d)
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    checks = [
        quality.duplicates(tx, ["id"], "tx_id"),
        quality.duplicates(tx, ["reference"], "tx_reference"),
        quality.duplicates(acc, ["account_number"], "account_number"),
        quality.duplicates(lines, ["l_orderkey", "l_linenumber"], "line_item"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


@query(
    "Q5_dq_domain",
    f"""{WITH} SELECT id AS key, 'ACCOUNT_TYPE' AS rule FROM acc
  WHERE account_type NOT IN ('SAVINGS', 'CHECKING', 'CREDIT')
UNION ALL SELECT id, 'STATUS' FROM acc WHERE status NOT IN ('ACTIVE', 'SUSPENDED', 'CLOSED')
UNION ALL SELECT id, 'CURRENCY_LENGTH' FROM acc WHERE length(currency) <> 3
UNION ALL SELECT id, 'MONEY_SCALE' FROM acc WHERE round(balance, 1) <> balance""",
)
def dq_domain(spark, d):
    # One allowed type and one decimal place fewer than the schema, so that rows fail.
    return quality.domain_rules(accounts(spark, d), ACCOUNT_TYPES[:3], ACCOUNT_STATUSES, scale=1)
