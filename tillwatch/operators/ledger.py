"""Ledger pages: searches, transfer checks, history rows and account summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import first_filled, money_label, plain_number
from ..functions.geo import coordinate, nearest_province
from .history import RECEIVER, SENDER
from .hotkeys import DEFAULT_HEAT, Heat, lookup
from .joins import touching, with_account_structs


def account_search(
    accounts: DataFrame, text: str = "", account_type: str = "ALL", status: str = "ALL"
) -> DataFrame:
    """Name contains (any case) or number contains; type and status filters, ``ALL`` passes."""
    return accounts.where(search_match(text, account_type, status))


def search_match(text: str, account_type: str = "ALL", status: str = "ALL") -> Column:
    hit = F.lower("account_name").contains(text.lower()) | F.col("account_number").contains(text)
    if account_type != "ALL":
        hit = hit & (F.col("account_type") == account_type)
    if status != "ALL":
        hit = hit & (F.col("status") == status)
    return hit


def newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def user_accounts(accounts: DataFrame, user_id) -> DataFrame:
    return accounts.where(F.col("user_id") == user_id).orderBy(*newest_first())


def transfer_candidates(accounts: DataFrame, user_id) -> DataFrame:
    """ACTIVE accounts with the role they can play for this user, newest first."""
    own = F.col("user_id") == user_id
    return (
        accounts.where((F.col("status") == "ACTIVE") & F.col("user_id").isNotNull())
        .withColumn("role", F.when(own, F.lit("source")).otherwise(F.lit("destination")))
        .orderBy(*newest_first())
    )


def transfer_eligibility(
    proposals: DataFrame, accounts: DataFrame, heat: Heat = DEFAULT_HEAT
) -> DataFrame:
    """Per proposed transfer: may it run, and if not, why."""
    balances = accounts.select(F.col("id").alias("account_key"), "balance")
    rows = lookup(proposals, balances, SENDER, "account_key", heat)
    available = F.coalesce(F.col("balance"), F.lit(0))
    reasons = F.concat_ws(
        ",",
        F.when(F.col(SENDER).isNull() | F.col(RECEIVER).isNull(), "ACCOUNT_MISSING"),
        F.when(F.col("amount") <= 0, "AMOUNT_NOT_POSITIVE"),
        F.when(F.col(SENDER) == F.col(RECEIVER), "SAME_ACCOUNT"),
        F.when(available < F.col("amount"), "INSUFFICIENT_BALANCE"),
    )
    return rows.select(
        "id", SENDER, RECEIVER, "amount", reasons.alias("reasons"), (reasons == "").alias("eligible")
    )


def flow_direction(
    tx: DataFrame, accounts: DataFrame, own: DataFrame, heat: Heat = DEFAULT_HEAT
) -> DataFrame:
    """History rows seen from the owner of ``own`` (account ids): debit or credit, names.

    Money leaving an own account is a debit, also when it arrives at another one.
    """
    flagged = accounts.join(
        own.select(F.col("id"), F.lit(True).alias("mine")), "id", "left"
    ).select(F.col("id").alias("account_key"), "account_name", "account_number", "mine")

    def side(prefix):
        return flagged.select(
            "account_key",
            F.struct("account_name", "account_number", "mine").alias(prefix),
        )

    rows = lookup(tx, side("s"), SENDER, "account_key", heat)
    rows = lookup(rows, side("r"), RECEIVER, "account_key", heat, tx)
    debit = F.coalesce(F.col("s.mine"), F.lit(False))
    sender = F.coalesce(
        first_filled(F.col("s.account_name"), F.col("s.account_number")), F.lit("External / Top-up")
    )
    receiver = first_filled(
        F.col("r.account_name"), F.col("r.account_number"), F.col(RECEIVER).cast("string")
    )
    label = money_label(F.col("amount"), F.col("currency"))
    return rows.select(
        "id",
        debit.alias("is_debit"),
        F.coalesce(F.col("r.mine"), F.lit(False)).alias("receiver_is_own"),
        F.when(debit, -F.col("amount")).otherwise(F.col("amount")).alias("signed_amount"),
        F.concat(F.when(debit, F.lit("-")).otherwise(F.lit("+")), label).alias("amount_label"),
        F.substring(sender, 1, 8).alias("sender_label"),
        F.substring(receiver, 1, 8).alias("receiver_label"),
    )


def history_text_search(tx: DataFrame, text: str) -> DataFrame:
    """Rows where reference, description or the shown amount contains the text, any case."""
    needle = text.lower()
    shown = [F.col("reference"), F.col("description"), plain_number(F.col("amount"))]
    hit = F.lit(False)
    for c in shown:
        hit = hit | F.coalesce(F.lower(c).contains(needle), F.lit(False))
    return tx.where(hit)


def with_province(tx: DataFrame) -> DataFrame:
    place = nearest_province(coordinate(F.col("latitude")), coordinate(F.col("longitude")))
    return tx.withColumn("nearest", place)


def account_summary(accounts: DataFrame, shown: Column) -> DataFrame:
    """Card figures in one pass; ``shown`` is the current search predicate."""
    balance = F.col("balance")
    return accounts.agg(
        F.coalesce(F.sum(F.when(balance > 0, balance)), F.lit(0)).alias("total_balance"),
        F.coalesce(F.sum(F.when(balance < 0, -balance)), F.lit(0)).alias("total_liabilities"),
        F.count_if(F.col("status") == "ACTIVE").alias("active_count"),
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(shown).alias("shown_count"),
    )


def legs(tx: DataFrame) -> DataFrame:
    """Each transfer as a debit leg of its sender and a credit leg of its receiver."""
    debit = F.struct(
        F.col(SENDER).alias("account_id"), F.lit("debit").alias("leg"), (-F.col("amount")).alias("signed_amount")
    )
    credit = F.struct(
        F.col(RECEIVER).alias("account_id"), F.lit("credit").alias("leg"), F.col("amount").alias("signed_amount")
    )
    both = tx.select("id", F.inline(F.array(debit, credit)))
    return both.where(F.col("account_id").isNotNull())


def account_net_flow(accounts: DataFrame, tx: DataFrame) -> DataFrame:
    """Per account: debits, credits and the balance after applying them."""
    moved = legs(tx).groupBy(F.col("account_id").alias("id")).agg(
        F.sum(F.when(F.col("leg") == "debit", -F.col("signed_amount"))).alias("debits"),
        F.sum(F.when(F.col("leg") == "credit", F.col("signed_amount"))).alias("credits"),
    )
    debits, credits = (F.coalesce(F.col(c), F.lit(0)) for c in ("debits", "credits"))
    return accounts.select("id", "balance").join(moved, "id", "left").select(
        "id",
        F.col("balance").alias("opening_balance"),
        debits.alias("debits"),
        credits.alias("credits"),
        (F.col("balance") - debits + credits).alias("closing_balance"),
    )


# --- paging ------------------------------------------------------------------------


def page_bounds(page: int, limit: int, max_limit: int = 5) -> tuple[int, int, int]:
    """(page, limit, offset) after clamping: page at least 1, limit within 1..max_limit."""
    page = max(1, page)
    limit = max(1, min(limit, max_limit))
    return page, limit, (page - 1) * limit


def history_page(
    tx: DataFrame, accounts: DataFrame, own: DataFrame, page: int = 1, limit: int = 10, max_limit: int = 5
) -> DataFrame:
    """One page of the history of ``own`` accounts, newest first, with account structs.

    The page is cut before the account columns are fetched, so only its rows join.
    """
    page, limit, skip = page_bounds(page, limit, max_limit)
    rows = touching(tx, own).orderBy(*newest_first()).offset(skip).limit(limit)
    return with_account_structs(rows, accounts).orderBy(*newest_first())


def history_totals(
    tx: DataFrame, own: DataFrame, page: int = 1, limit: int = 10, max_limit: int = 5
) -> DataFrame:
    """Page figures: the count covers all rows, the volume only the page."""
    page, limit, skip = page_bounds(page, limit, max_limit)
    rows = touching(tx, own)
    counted = rows.agg(F.count(F.lit(1)).alias("total_count")).withColumn(
        "total_volume", F.lit(None).cast("decimal(28,2)")
    )
    summed = (
        rows.orderBy(*newest_first()).offset(skip).limit(limit)
        .agg(F.sum("amount").cast("decimal(28,2)").alias("total_volume"))
        .select(F.lit(None).cast("long").alias("total_count"), "total_volume")
    )
    merged = counted.unionByName(summed).agg(
        F.max("total_count").alias("total_count"),
        F.coalesce(F.max("total_volume"), F.lit(0)).alias("total_volume"),
    )
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_count") / F.lit(limit))).cast("long")
    return merged.select(
        "total_count",
        "total_volume",
        F.lit(page).cast("long").alias("page"),
        F.lit(limit).cast("long").alias("page_size"),
        pages.alias("total_pages"),
        (F.lit(page) < pages).alias("has_next_page"),
        F.lit(page > 1).alias("has_prev_page"),
    )


def keyset_page(
    tx: DataFrame, cursor: tuple | None, take: int, skip: int = 0
) -> DataFrame:
    """Rows after the cursor (micros, id) in newest-first order."""
    rows = tx
    if cursor is not None:
        us, key = cursor
        rows = rows.where((F.col("us") < us) | ((F.col("us") == us) & (F.col("id") < key)))
    return rows.orderBy(F.desc("us"), F.desc("id")).offset(skip).limit(take)


def latest(tx: DataFrame, n: int = 30) -> DataFrame:
    return tx.orderBy(*newest_first()).limit(n)
