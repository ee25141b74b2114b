"""Registered queries against their SQL at the smallest scale, one per kind of operator."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import TINY
from tools.check_oracle import TABLES, table

SAMPLE = [
    "B1_target_transactions", "B10_fraud_features", "B11_stream_feature_row", "B12_conditional_agg",
    "C6_join_anti_orphans", "C7_join_semi_membership", "C9_join_relation_quantifiers",
    "E4_transfer_eligibility", "E5_flow_direction", "E8_field_predicates", "E9_nearest_province",
    "F1_account_summary", "F7_correlation_matrix", "F12_account_net_flow", "G1_history_totals",
    "H1_append_skip_duplicates", "H2_upsert_latest", "M12_classification_report", "M15_threshold_table",
    "Q1_dq_tx_rules", "Q5_dq_domain", "R6_rule_sleep_wake", "R7_risk_score_alerts", "W3_lag_by_key",
]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, TINY)
    want = sql.sql(entry.oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(want.columns, want.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())
