"""Snapshot rewrites: append, upsert, update and delete as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .history import RECEIVER, SENDER
from .hotkeys import lookup


def append_skip_duplicates(
    existing: DataFrame, incoming: DataFrame, keys: list[str], first_by: list[str]
) -> DataFrame:
    """``existing`` plus the incoming rows whose key is new; of repeated new keys the
    first in ``first_by`` order is taken."""
    columns = [c for c in incoming.columns if c not in keys]
    one_each = (
        incoming.groupBy(*keys)
        .agg(F.min_by(F.struct(*columns), F.struct(*first_by)).alias("row"))
        .select(*keys, "row.*")
    )
    fresh = one_each.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh)


def upsert_latest(
    snapshot: DataFrame, changes: DataFrame, keys: list[str], version: list[str]
) -> DataFrame:
    """Insert or replace by key; the highest version of a key wins, changes win ties."""
    columns = [c for c in snapshot.columns if c not in keys]
    both = snapshot.select("*", F.lit(0).alias("__side")).unionByName(
        changes.select(*snapshot.columns, F.lit(1).alias("__side"))
    )
    best = F.max_by(F.struct(*columns), F.struct(*version, "__side"))
    return both.groupBy(*keys).agg(best.alias("row")).select(*keys, "row.*").select(*snapshot.columns)


def increment(column: str, by) -> Column:
    return F.col(column) + F.lit(by)


def multiply(column: str, by) -> Column:
    return F.col(column) * F.lit(by)


def divide(column: str, by) -> Column:
    return F.col(column) / F.lit(by)


def update_where(df: DataFrame, predicate: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns on the rows that match; types and all other rows stay."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.withColumns(
        {
            name: F.when(hit, value.cast(df.schema[name].dataType)).otherwise(F.col(name))
            for name, value in values.items()
        }
    )


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(~F.coalesce(predicate, F.lit(False)))


def account_deletion(accounts: DataFrame, tx: DataFrame, doomed: Column) -> DataFrame:
    """Per account asked to be deleted: ``deleted``, or kept because it received money."""
    used = tx.select(F.col(RECEIVER).alias("id")).distinct().withColumn("used", F.lit(True))
    return (
        accounts.where(F.coalesce(doomed, F.lit(False)))
        .select("id")
        .join(used, "id", "left")
        .select("id", F.when(F.col("used"), "restricted").otherwise("deleted").alias("outcome"))
    )


def delete_accounts(
    accounts: DataFrame, tx: DataFrame, doomed: Column
) -> tuple[DataFrame, DataFrame]:
    """New accounts and transactions after a deletion.

    Accounts that received money cannot go; the sender of a deleted account's
    transactions becomes NULL.  A user's deletion is ``doomed`` on ``user_id``.
    """
    gone = account_deletion(accounts, tx, doomed).where(F.col("outcome") == "deleted").select("id")
    return accounts.join(gone, "id", "left_anti"), clear_senders(tx, gone)


def clear_senders(tx: DataFrame, gone: DataFrame) -> DataFrame:
    """``tx`` with NULL for senders whose ``id`` is among ``gone``."""
    senders = tx.select(F.col(SENDER).alias("id")).where(F.col("id").isNotNull()).distinct()
    cleared = senders.join(gone, "id", "left_semi").select(F.col("id").alias(SENDER), F.lit(True).alias("__gone"))
    marked = lookup(tx, cleared, SENDER, SENDER)
    rows = marked.withColumn(SENDER, F.when(F.col("__gone").isNull(), F.col(SENDER))).drop("__gone")
    return rows.select(*tx.columns)
