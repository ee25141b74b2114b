"""Joins of the ledger with accounts and with itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import DAY, HOUR
from .history import RECEIVER, SENDER, sender_history
from .hotkeys import DEFAULT_HEAT, Heat, hot_sets, lookup
from .trailing import trailing_terms


def enrich_accounts(tx: DataFrame, accounts: DataFrame, heat: Heat = DEFAULT_HEAT) -> DataFrame:
    senders = accounts.select(
        F.col("id").alias("account_key"),
        F.col("account_number").alias("sender_account"),
        F.col("account_type").alias("sender_type"),
    )
    receivers = accounts.select(
        F.col("id").alias("account_key"), F.col("account_number").alias("receiver_account")
    )
    both = lookup(tx, senders, SENDER, "account_key", heat)
    return lookup(both, receivers, RECEIVER, "account_key", heat, tx)


def or_theta_counts(tx: DataFrame, heat: Heat = DEFAULT_HEAT) -> DataFrame:
    """Row counts of a left self-join on a three-way OR, without forming the pairs.

    Each branch of the OR, and each overlap of branches, is itself an equality on some
    keys over a trailing range; inclusion and exclusion of their counts gives the size
    of the union.  Where two branches overlap the shorter range applies.
    """
    one = F.lit(1).cast("long")
    t = tx.select("id", "us", SENDER, RECEIVER, "amount")
    terms = [
        ("by_receiver", [RECEIVER], 3 * DAY),
        ("receiver_amount", [RECEIVER, SENDER, "amount"], 2 * DAY),
        ("receiver_pace", [RECEIVER, SENDER], HOUR),
        ("all_three", [RECEIVER, SENDER, "amount"], HOUR),
        ("by_amount", [SENDER, "amount"], 2 * DAY),
        ("by_pace", [SENDER], HOUR),
        ("amount_pace", [SENDER, "amount"], HOUR),
    ]
    hot = hot_sets(t, [RECEIVER, SENDER], heat)
    for lead in (RECEIVER, SENDER):
        led = [(keys, width, {name: one}) for name, keys, width in terms if keys[0] == lead]
        t = trailing_terms(t, led, heat, hot[lead])
    union = (
        F.col("by_receiver") + F.col("by_amount") + F.col("by_pace")
        - F.col("receiver_amount") - F.col("receiver_pace") - F.col("amount_pace")
        + F.col("all_three")
    )
    return t.select("id", union.alias("matched_rows"), "by_receiver", "by_amount", "by_pace")


def previous_of_sender(rows: DataFrame, heat: Heat = DEFAULT_HEAT) -> DataFrame:
    """As-of join: each row with the latest strictly earlier row of its sender."""
    return sender_history(rows, heat)


def assemble(tx: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Join separately computed feature sets by transaction id, with the defaults.

    For features that arrive late; the one-plan profile needs no such joins.
    """
    base = tx.select(
        F.col("id").alias("transaction_id"), F.col("amount").alias("trans_amount"), "is_fraud", "fraud_type"
    )
    whole = reduce(lambda left, right: left.join(right, "transaction_id", "left"), parts, base)
    counts = [
        "receiver_txn_count_last_3d",
        "unique_senders_last_3d",
        "multi_same_amt_count_2d",
        "sender_txn_count_last_1h",
        "sender_volume_last_1h",
        "geo_speed_kmh",
    ]
    return whole.fillna(0, counts).fillna(9999.0, ["days_since_last_trans"])


def orphans(tx: DataFrame, accounts: DataFrame, heat: Heat = DEFAULT_HEAT) -> DataFrame:
    """Transaction sides whose account does not exist, as (id, side, account_id)."""
    sides = tx.select(
        "id",
        F.inline(
            F.array(
                F.struct(F.lit("sender").alias("side"), F.col(SENDER).alias("account_id")),
                F.struct(F.lit("receiver").alias("side"), F.col(RECEIVER).alias("account_id")),
            )
        ),
    )
    # The distinct account ids are checked, not every row: a hub account is looked up once.
    used = sides.select("account_id").where(F.col("account_id").isNotNull()).distinct()
    missing = used.join(accounts.select(F.col("id").alias("account_id")), "account_id", "left_anti")
    flagged = lookup(
        sides, missing.withColumn("gone", F.lit(True)), "account_id", "account_id", heat
    )
    no_receiver = (F.col("side") == "receiver") & F.col("account_id").isNull()
    return flagged.where(F.col("gone") | no_receiver).drop("gone")


def touching(tx: DataFrame, own: DataFrame, heat: Heat = DEFAULT_HEAT) -> DataFrame:
    """Transactions whose sender or receiver is one of ``own`` (ids), each once.

    Two equality lookups and an OR of their flags, rather than an OR join.
    """
    sent = own.select(F.col("id").alias("account_key"), F.lit(True).alias("sends"))
    got = own.select(F.col("id").alias("account_key"), F.lit(True).alias("receives"))
    flagged = lookup(tx, sent, SENDER, "account_key", heat)
    flagged = lookup(flagged, got, RECEIVER, "account_key", heat, tx)
    return flagged.where(F.col("sends") | F.col("receives")).drop("sends", "receives")


def with_account_structs(tx: DataFrame, accounts: DataFrame, heat: Heat = DEFAULT_HEAT) -> DataFrame:
    """Rows with a nullable ``sender_account`` struct and a required ``receiver_account``."""
    brief = F.struct("id", "account_name", "account_number")
    senders = accounts.select(F.col("id").alias("account_key"), brief.alias("sender_account"))
    receivers = accounts.select(F.col("id").alias("account_key"), brief.alias("receiver_account"))
    both = lookup(tx, senders, SENDER, "account_key", heat)
    both = lookup(both, receivers, RECEIVER, "account_key", heat, tx)
    return both.where(F.col("receiver_account").isNotNull())


def relation_quantifiers(
    accounts: DataFrame, related: DataFrame, key: str, predicate: Column
) -> DataFrame:
    """Per account: does some / none / every related row satisfy the predicate?

    One pre-aggregated pass over the related rows; NULL predicates count as not
    satisfied for ``some`` and are ignored by ``every``, as EXISTS does.
    """
    verdict = (
        related.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("id"))
        .agg(
            F.bool_or(F.coalesce(predicate, F.lit(False))).alias("hit"),
            F.bool_or(F.coalesce(~predicate, F.lit(False))).alias("miss"),
        )
    )
    hit, miss = (F.coalesce(F.col(c), F.lit(False)) for c in ("hit", "miss"))
    return accounts.select("id").join(verdict, "id", "left").select(
        "id",
        hit.alias("some_match"),
        (~hit).alias("none_match"),
        (~miss).alias("every_match"),
    )


def single_relation(tx: DataFrame, accounts: DataFrame, heat: Heat = DEFAULT_HEAT) -> DataFrame:
    """``is`` / ``isNot`` on the one related account of each side."""
    senders = accounts.select(F.col("id").alias("account_key"), F.col("status").alias("s_status"))
    receivers = accounts.select(F.col("id").alias("account_key"), F.col("status").alias("r_status"))
    both = lookup(tx, senders, SENDER, "account_key", heat)
    both = lookup(both, receivers, RECEIVER, "account_key", heat, tx)
    return both.select(
        "id",
        (F.col("s_status") == "SUSPENDED").alias("sender_is_suspended"),
        (F.col("r_status").isNull() | (F.col("r_status") != "CLOSED")).alias("receiver_is_not_closed"),
    )
