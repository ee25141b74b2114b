"""The transaction profile: nine features per transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import coordinate, speed_kmh
from ..functions.times import (
    NO_HISTORY_DAYS,
    days_between,
    hours_between,
    micros,
    whole_second_hours,
)
from ..operators.history import (
    RECEIVER,
    SENDER,
    attach_hot_receivers,
    finish_receivers,
    receiver_history,
    sender_history,
    with_clock,
)
from ..operators.hotkeys import DEFAULT_HEAT, Heat, hot_sets, lookup
from ..operators.trailing import trailing


def ledger_rows(tx: DataFrame) -> DataFrame:
    """The columns the profile needs, coordinates as numbers, with the clock."""
    return with_clock(tx).select(
        "id",
        "us",
        "amount",
        SENDER,
        RECEIVER,
        coordinate(F.col("latitude")).alias("latitude"),
        coordinate(F.col("longitude")).alias("longitude"),
        "is_fraud",
        "fraud_type",
    )


def target_transactions(tx: DataFrame, accounts: DataFrame, heat: Heat = DEFAULT_HEAT) -> DataFrame:
    """B1: both account numbers, the sender's opening date and the account age."""
    senders = accounts.select(
        F.col("id").alias("account_key"),
        F.col("account_number").alias("sender_account"),
        F.col("created_at").alias("sender_open_acc_date"),
    )
    receivers = accounts.select(
        F.col("id").alias("account_key"), F.col("account_number").alias("receiver_account")
    )
    both = lookup(tx, senders, SENDER, "account_key", heat)
    both = lookup(both, receivers, RECEIVER, "account_key", heat, tx)
    return both.select(
        "id",
        SENDER,
        RECEIVER,
        "sender_account",
        "receiver_account",
        "sender_open_acc_date",
        F.col("created_at").alias("trans_date"),
        F.col("amount").alias("trans_amount"),
        F.col("latitude").alias("trans_lat"),
        F.col("longitude").alias("trans_lon"),
        hours_between(micros("created_at"), micros("sender_open_acc_date")).alias(
            "age_hours_open_acc"
        ),
        "is_fraud",
        "fraud_type",
    )


def account_age(tx: DataFrame, accounts: DataFrame, heat: Heat = DEFAULT_HEAT) -> DataFrame:
    """B2: exact and whole-second account age in hours."""
    opened = accounts.select(F.col("id").alias("account_key"), micros("created_at").alias("opened_us"))
    rows = lookup(with_clock(tx).select("id", "us", SENDER), opened, SENDER, "account_key", heat)
    return rows.select(
        F.col("id").alias("transaction_id"),
        hours_between(F.col("us"), F.col("opened_us")).alias("age_hours_open_acc"),
        whole_second_hours(F.col("us"), F.col("opened_us")).alias("age_hours_whole_seconds"),
    )


def days_since(previous: Column, us: Column) -> Column:
    return F.coalesce(days_between(us, previous["us"]), F.lit(NO_HISTORY_DAYS))


def travel_speed(previous: Column) -> Column:
    return speed_kmh(
        F.col("us"),
        F.col("latitude"),
        F.col("longitude"),
        previous["us"],
        previous["latitude"],
        previous["longitude"],
    )


def receiver_features(tx: DataFrame, heat: Heat = DEFAULT_HEAT) -> DataFrame:
    """B3 and B4."""
    rows = with_clock(tx).select("id", "us", SENDER, RECEIVER)
    return receiver_history(rows, heat).select(
        F.col("id").alias("transaction_id"), "receiver_txn_count_last_3d", "unique_senders_last_3d"
    )


def sender_features(tx: DataFrame, heat: Heat = DEFAULT_HEAT) -> DataFrame:
    """B5 to B9."""
    previous = F.col("previous")
    return sender_history(ledger_rows(tx), heat).select(
        F.col("id").alias("transaction_id"),
        "multi_same_amt_count_2d",
        "sender_txn_count_last_1h",
        "sender_volume_last_1h",
        days_since(previous, F.col("us")).alias("days_since_last_trans"),
        travel_speed(previous).alias("geo_speed_kmh"),
    )


def trailing_feature(
    tx: DataFrame, keys: list[str], width: int, name: str, value: Column, heat: Heat = DEFAULT_HEAT
) -> DataFrame:
    """One trailing sum on its own (B3, B5, B6, B7 when only one is wanted)."""
    rows = with_clock(tx).select("id", "us", "amount", SENDER, RECEIVER)
    return trailing(rows, keys, width, {name: value}, heat).select(
        F.col("id").alias("transaction_id"), name
    )


def fraud_features(
    tx: DataFrame,
    accounts: DataFrame,
    heat: Heat = DEFAULT_HEAT,
    keep: tuple[str, ...] = (),
    whole_seconds: bool = False,
) -> DataFrame:
    """B10: the whole profile in one plan, without joining features back by id.

    Hot receivers are answered on the raw ledger, then the sender side runs, then
    the ordinary receivers: two shuffles of the ledger for ordinary keys.
    ``keep`` names extra columns to carry (``us`` and the account ids).
    """
    rows = ledger_rows(tx)
    hot = hot_sets(rows, [RECEIVER, SENDER], heat)
    rows = attach_hot_receivers(rows, hot[RECEIVER])
    profiled = finish_receivers(sender_history(rows, heat, accounts, hot[SENDER]), hot[RECEIVER])
    previous = F.col("previous")
    age = whole_second_hours if whole_seconds else hours_between
    return profiled.select(
        F.col("id").alias("transaction_id"),
        *keep,
        F.col("amount").alias("trans_amount"),
        age(F.col("us"), F.col("opened_us")).alias("age_hours_open_acc"),
        "receiver_txn_count_last_3d",
        "unique_senders_last_3d",
        "multi_same_amt_count_2d",
        "sender_txn_count_last_1h",
        "sender_volume_last_1h",
        days_since(previous, F.col("us")).alias("days_since_last_trans"),
        travel_speed(previous).alias("geo_speed_kmh"),
        "is_fraud",
        "fraud_type",
    )


def stream_feature_row(tx: DataFrame, accounts: DataFrame, heat: Heat = DEFAULT_HEAT) -> DataFrame:
    """B11: the seven-feature row of the streaming statement, in its own units."""
    full = fraud_features(tx, accounts, heat, whole_seconds=True)
    return full.select(
        "transaction_id",
        F.col("trans_amount").cast("double").alias("trans_amount"),
        "age_hours_open_acc",
        "receiver_txn_count_last_3d",
        "unique_senders_last_3d",
        "multi_same_amt_count_2d",
        "sender_txn_count_last_1h",
        F.col("sender_volume_last_1h").cast("double").alias("sender_volume_last_1h"),
    )
