"""The behavioural history of a transaction: what its receiver and its sender did before.

Both functions take transactions with a ``us`` column (``with_clock``) and add columns.
Rows are split by heat: ordinary keys go through windows that share one shuffle per
key space, hot keys through lane tallies joined back by (key, time), and rows without
a key get the defaults directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.times import DAY, HOUR, micros
from .hotkeys import (
    DEFAULT_HEAT,
    Heat,
    HotSet,
    hot_keys,
    only_hot,
    only_listed,
    union_all,
    without_hot,
)
from .trailing import add_and_expire, in_lanes, lane_running, strictly_before

RECEIVER = "receiver_account_id"
SENDER = "sender_account_id"

RECEIVER_WINDOW = 3 * DAY
SAME_AMOUNT_WINDOW = 2 * DAY
VELOCITY_WINDOW = HOUR


def with_clock(tx: DataFrame) -> DataFrame:
    return tx.withColumn("us", micros("created_at"))


# --- receiver side -----------------------------------------------------------------


def _hot_receiver_answers(hot_rows: DataFrame, lane_rows: int) -> DataFrame:
    """(receiver, us) -> incoming count and distinct senders, for hot receivers."""
    seen = hot_rows.groupBy(RECEIVER, SENDER, "us").agg(F.count(F.lit(1)).alias("n"))
    seen = in_lanes(seen, [RECEIVER, SENDER], ["us"], lane_rows)
    # The next time the same sender pays the same receiver ends the earlier
    # payment's claim on the distinct count.  Within a lane that is LEAD; the last
    # payment of a lane looks at the head of the pair's next lane.
    heads = seen.groupBy(RECEIVER, SENDER, "lane").agg(F.min("us").alias("head"))
    over_lanes = Window.partitionBy(RECEIVER, SENDER).orderBy("lane")
    peeks = heads.select(
        RECEIVER,
        SENDER,
        "lane",
        F.lead("head").over(over_lanes).alias("us"),
        F.lit(None).cast("long").alias("n"),
    ).where(F.col("us").isNotNull())
    in_lane = Window.partitionBy(RECEIVER, SENDER, "lane").orderBy("us")
    claims = (
        seen.unionByName(peeks)
        .withColumn("again", F.lead("us").over(in_lane))
        .where(F.col("n").isNotNull())
    )
    one = F.col(SENDER).isNotNull().cast("long")
    leave = F.col("us") + F.lit(RECEIVER_WINDOW)
    zero = F.lit(0).cast("long")

    def mark(at, own, n, d):
        return F.struct(at.alias("at"), F.lit(own).alias("own"), n.alias("n"), d.alias("d"))

    marks = claims.select(
        RECEIVER,
        F.inline(
            F.array(
                mark(F.col("us"), True, F.col("n"), one),
                mark(leave, False, -F.col("n"), zero),
                mark(F.least(leave, F.col("again")), False, zero, -one),
            )
        ),
    )
    return lane_running(marks, [RECEIVER], ["n", "d"], lane_rows).select(
        RECEIVER, F.col("at").alias("us"), F.col("n").alias("hot_count"), F.col("d").alias("hot_senders")
    )


def attach_hot_receivers(tx: DataFrame, hot: HotSet) -> DataFrame:
    """``tx`` plus ``hot_count`` / ``hot_senders``, NULL where the receiver is ordinary."""
    blank = [F.lit(None).cast("long").alias(c) for c in ("hot_count", "hot_senders")]
    if hot.rows is None:
        return tx.select("*", *blank)
    answers = _hot_receiver_answers(only_hot(tx.select(RECEIVER, SENDER, "us"), RECEIVER, hot), hot.lane_rows)
    ordinary = tx.join(
        F.broadcast(hot.rows), F.col(RECEIVER) == F.col("hot_key"), "left_anti"
    ).select("*", *blank)
    heavy = only_hot(tx, RECEIVER, hot).join(answers, [RECEIVER, "us"], "left")
    return ordinary.unionByName(heavy)


def finish_receivers(tx: DataFrame, hot: HotSet) -> DataFrame:
    """Windows for ordinary receivers; rows already answered travel in groups of one."""
    payload = [c for c in tx.columns if c not in (RECEIVER, "hot_count", "hot_senders")]
    group = [RECEIVER]
    if hot.rows is not None or hot.has_null:
        answered = F.col("hot_count").isNotNull() | F.col(RECEIVER).isNull()
        tx = tx.withColumn("lane", F.when(answered, F.xxhash64("id")).otherwise(F.lit(0).cast("long")))
        group = [RECEIVER, "lane"]
    # One shuffle for both windows, before the marks multiply the rows.
    pair = Window.partitionBy(*group, SENDER).orderBy("us")
    claims = tx.repartition(*group).withColumn("again", F.lead("us").over(pair))
    one = F.col(SENDER).isNotNull().cast("long")
    unit, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    leave = F.col("us") + F.lit(RECEIVER_WINDOW)

    def mark(at, own, n, d):
        return F.struct(at.alias("at"), F.lit(own).alias("own"), n.alias("n"), d.alias("d"))

    own = mark(F.col("us"), True, unit, one)
    marks = F.when(
        F.col("again") < leave,
        F.array(own, mark(leave, False, -unit, zero), mark(F.col("again"), False, zero, -one)),
    ).otherwise(F.array(own, mark(leave, False, -unit, -one)))
    swept = claims.select("*", F.explode(marks).alias("m")).select(
        *group,
        F.col("m.at").alias("at"),
        F.col("m.n").alias("n"),
        F.col("m.d").alias("d"),
        F.when(F.col("m.own"), F.struct(*payload)).alias("row"),
        "hot_count",
        "hot_senders",
    )
    running = strictly_before(*group)
    known = F.col(RECEIVER).isNotNull()

    def answer(hot: str, delta: str):
        total = F.coalesce(F.col(hot), F.sum(delta).over(running), F.lit(0).cast("long"))
        return F.when(known, total).otherwise(F.lit(0).cast("long"))

    return (
        swept.select(
            RECEIVER,
            "row",
            answer("hot_count", "n").alias("receiver_txn_count_last_3d"),
            answer("hot_senders", "d").alias("unique_senders_last_3d"),
        )
        .where(F.col("row").isNotNull())
        .select(RECEIVER, "row.*", "receiver_txn_count_last_3d", "unique_senders_last_3d")
    )


def receiver_history(tx: DataFrame, heat: Heat = DEFAULT_HEAT) -> DataFrame:
    hot = hot_keys(tx, RECEIVER, heat)
    return finish_receivers(attach_hot_receivers(tx, hot), hot)


# --- sender side -------------------------------------------------------------------

PREVIOUS = "struct<us:bigint,id:{id},latitude:double,longitude:double>"


def _place():
    return F.struct(
        F.col("us").alias("us"),
        F.col("id").alias("id"),
        F.col("latitude").alias("latitude"),
        F.col("longitude").alias("longitude"),
    )


def _ordinary_senders(rows: DataFrame) -> DataFrame:
    """Sender windows first, (sender, amount) windows second: the shuffle is shared."""
    payload = [c for c in rows.columns if c not in (SENDER, "amount")]
    velocity = rows.select("*", add_and_expire(VELOCITY_WINDOW).alias("m")).select(
        SENDER,
        "amount",
        (F.col("us") + F.col("m.shift")).alias("at"),
        F.col("m.sign").cast("long").alias("n"),
        (F.col("amount") * F.col("m.sign")).alias("v"),
        F.when(F.col("m.sign") == 1, _place()).alias("place"),
        F.when(F.col("m.sign") == 1, F.struct(*payload)).alias("row"),
    )
    by_sender = strictly_before(SENDER)
    paced = (
        velocity.select(
            SENDER,
            "amount",
            "row",
            F.coalesce(F.sum("n").over(by_sender), F.lit(0).cast("long")).alias(
                "sender_txn_count_last_1h"
            ),
            F.coalesce(F.sum("v").over(by_sender), F.lit(0)).cast("decimal(28,2)").alias(
                "sender_volume_last_1h"
            ),
            F.max("place").over(by_sender).alias("previous"),
        )
        .where(F.col("row").isNotNull())
        .select(
            SENDER, "amount", "row.*", "sender_txn_count_last_1h", "sender_volume_last_1h", "previous"
        )
    )
    keep = [c for c in paced.columns if c not in (SENDER, "amount")]
    repeats = paced.select("*", add_and_expire(SAME_AMOUNT_WINDOW).alias("m")).select(
        SENDER,
        "amount",
        (F.col("us") + F.col("m.shift")).alias("at"),
        F.col("m.sign").cast("long").alias("n"),
        F.when(F.col("m.sign") == 1, F.struct(*keep)).alias("row"),
    )
    by_amount = strictly_before(SENDER, "amount")
    return (
        repeats.select(
            SENDER,
            "amount",
            "row",
            F.coalesce(F.sum("n").over(by_amount), F.lit(0).cast("long")).alias("repeats"),
        )
        .where(F.col("row").isNotNull())
        .select(
            SENDER,
            "amount",
            "row.*",
            F.when(F.col("amount").isNotNull(), F.col("repeats"))
            .otherwise(F.lit(0).cast("long"))
            .alias("multi_same_amt_count_2d"),
        )
    )


def _heavy_senders(rows: DataFrame, lane_rows: int) -> DataFrame:
    """The same columns for hot senders, from tallies joined back by (sender, time)."""
    paced = rows.groupBy(SENDER, "us").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("amount").alias("v"),
        F.max(_place()).alias("place"),
    )
    marks = paced.select("*", add_and_expire(VELOCITY_WINDOW).alias("m")).select(
        SENDER,
        (F.col("us") + F.col("m.shift")).alias("at"),
        (F.col("m.sign") == 1).alias("own"),
        (F.col("n") * F.col("m.sign")).alias("n"),
        (F.col("v") * F.col("m.sign")).alias("v"),
        F.when(F.col("m.sign") == 1, F.col("place")).alias("place"),
    )
    velocity = lane_running(marks, [SENDER], ["n", "v"], lane_rows, last="place").select(
        SENDER,
        F.col("at").alias("us"),
        F.col("n").alias("sender_txn_count_last_1h"),
        F.col("v").cast("decimal(28,2)").alias("sender_volume_last_1h"),
        F.col("place").alias("previous"),
    )
    same = rows.where(F.col("amount").isNotNull()).groupBy(SENDER, "amount", "us").agg(F.count(F.lit(1)).alias("n"))
    marks = same.select("*", add_and_expire(SAME_AMOUNT_WINDOW).alias("m")).select(
        SENDER,
        "amount",
        (F.col("us") + F.col("m.shift")).alias("at"),
        (F.col("m.sign") == 1).alias("own"),
        (F.col("n") * F.col("m.sign")).alias("n"),
    )
    repeats = lane_running(marks, [SENDER, "amount"], ["n"], lane_rows).select(
        SENDER, "amount", F.col("at").alias("us"), F.col("n").alias("multi_same_amt_count_2d")
    )
    return (
        rows.join(velocity, [SENDER, "us"], "left")
        .join(repeats, [SENDER, "amount", "us"], "left")
        .fillna(0, ["multi_same_amt_count_2d"])
    )


def sender_history(
    tx: DataFrame,
    heat: Heat = DEFAULT_HEAT,
    accounts: DataFrame | None = None,
    hot: HotSet | None = None,
) -> DataFrame:
    """Adds the one-hour pace, the two-day repeats and ``previous``.

    With ``accounts`` also ``opened_us``: for ordinary senders that join is keyed like
    the windows, so a sort-merge join and the windows use the same shuffle.
    """
    hot = hot if hot is not None else hot_keys(tx, SENDER, heat)
    id_type = tx.schema["id"].dataType.simpleString()
    opened = None
    if accounts is not None:
        opened = accounts.select(
            F.col("id").alias("account_key"), micros("created_at").alias("opened_us")
        )

    def meet(rows, dim):
        if dim is None:
            return rows
        return rows.join(dim, F.col(SENDER) == F.col("account_key"), "left").drop("account_key")

    # One shuffle for the account join and all sender windows, before marks multiply rows.
    ordinary = without_hot(tx, SENDER, hot).repartition(SENDER)
    parts = [_ordinary_senders(meet(ordinary, opened))]
    if hot.rows is not None:
        few = None
        if opened is not None:
            few = F.broadcast(only_listed(opened, "account_key", hot))
        parts.append(_heavy_senders(meet(only_hot(tx, SENDER, hot), few), hot.lane_rows))
    if hot.has_null:
        blank = {
            "sender_txn_count_last_1h": F.lit(0).cast("long"),
            "sender_volume_last_1h": F.lit(0).cast("decimal(28,2)"),
            "previous": F.lit(None).cast(PREVIOUS.format(id=id_type)),
            "multi_same_amt_count_2d": F.lit(0).cast("long"),
        }
        if opened is not None:
            blank["opened_us"] = F.lit(None).cast("long")
        parts.append(
            tx.where(F.col(SENDER).isNull()).select("*", *[c.alias(n) for n, c in blank.items()])
        )
    return union_all(parts)
