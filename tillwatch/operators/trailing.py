"""Trailing time windows: aggregates over rows of the same key in ``[t - w, t)``.

The lower bound is inclusive, the upper one strict, so neither the row itself nor
rows with the same time are seen.  A sliding RANGE frame would say the same but
re-reads the frame for every row, which is quadratic on a busy key.  ``trailing``
sweeps instead: each row adds its value at ``t`` and takes it back at ``t + w``, so
one running sum answers every row in linear time.

``lane_running`` is the hot-key plan.  Rows are first tallied per (key, instant),
which the map side combines; the tallies are cut into lanes of so many rows; lane
totals (small) are accumulated per key and enter each lane as one carry row; the running
sum then needs only (key, lane) groups.  No task ever sees a whole hot key, however its
rows lie in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .hotkeys import DEFAULT_HEAT, Heat, HotSet, hot_keys, only_hot, union_all, without_hot


def strictly_before(*keys: str, order: str = "at"):
    return (
        Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    )


def in_lanes(rows: DataFrame, keys: list[str], order: list[str], lane_rows: int) -> DataFrame:
    """``rows`` with ``lane``: per key, runs of at most ``lane_rows`` rows in ``order``; a later run has a greater lane.

    Two levels: a range partitioning by key and order, whose bounds Spark takes from the rows' own quantiles, and within
    a partition the rank of the row.  The result is written to the shared folder, as bounds may fall
    elsewhere when they are taken again and everyone has to see the same lanes.
    """
    place = F.monotonically_increasing_id()  # the partition in the upper bits, the rank in the lower 33
    rank = F.lit(1 << 33)
    cut = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("lane", place)
    inside = F.pmod("lane", rank)
    lane = F.col("lane") - inside + F.floor(inside / F.lit(lane_rows))
    return materialise(cut.withColumn("lane", lane.cast("long")), "lanes")


def lane_running(
    marks: DataFrame, keys: list[str], sums: list[str], lane_rows: int, last: str | None = None
) -> DataFrame:
    """Running totals strictly before each instant, in bounded groups.

    ``marks`` has the keys, ``at`` (micros), ``own`` (is this a time some row asks
    about), the delta columns ``sums`` and optionally a struct ``last`` whose greatest
    earlier value is wanted.  One result row per (keys, at) with ``own``.
    """
    pick = [F.max(last).alias(last)] if last else []
    tally = marks.groupBy(*keys, "at").agg(*[F.sum(s).alias(s) for s in sums], *pick, F.max("own").alias("own"))
    tally = in_lanes(tally, keys, ["at"], lane_rows)
    totals = tally.groupBy(*keys, "lane").agg(F.min("at").alias("at"), *[F.sum(s).alias(s) for s in sums], *pick)
    earlier = (
        Window.partitionBy(*keys).orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *keys,
        "lane",
        (F.col("at") - 1).alias("at"),
        F.lit(False).alias("own"),
        *[F.sum(s).over(earlier).alias(s) for s in sums],
        *([F.max(last).over(earlier).alias(last)] if last else []),
    )
    running = strictly_before(*keys, "lane")
    return (
        tally.unionByName(carry)
        .select(
            *keys,
            "at",
            "own",
            *[F.coalesce(F.sum(s).over(running), F.lit(0)).alias(s) for s in sums],
            *([F.max(last).over(running).alias(last)] if last else []),
        )
        .where("own")
        .drop("own")
    )


def add_and_expire(width: int) -> Column:
    """Two marks per row: its time, and the time it leaves the window."""
    return F.explode(
        F.array(
            F.struct(F.lit(0).cast("long").alias("shift"), F.lit(1).alias("sign")),
            F.struct(F.lit(width).cast("long").alias("shift"), F.lit(-1).alias("sign")),
        )
    )


def enter_and_leave(widths: dict[str, int]) -> tuple[Column, dict[str, Column]]:
    """One mark per row for its time and one per distinct width for the time it leaves that window.

    Returns the exploded marks (``shift``, ``step``), to be selected as ``mark``, and each name's sign on them.
    """
    steps = [0, *sorted(set(widths.values()))]
    marks = F.explode(
        F.array(
            *[
                F.struct(F.lit(shift).cast("long").alias("shift"), F.lit(step).alias("step"))
                for step, shift in enumerate(steps)
            ]
        )
    )
    step = F.col("mark.step")
    signs = {n: F.when(step == 0, 1).when(step == steps.index(w, 1), -1).otherwise(0) for n, w in widths.items()}
    return marks, signs


def sweep(rows: DataFrame, keys: list[str], widths: dict[str, int], sums: dict[str, Column]) -> DataFrame:
    """``rows`` plus the trailing sums, each over its width, by one running window: one sort, linear time."""
    payload = [c for c in rows.columns if c not in keys]
    exploded, signs = enter_and_leave(widths)
    marks = (
        rows.select("*", *[v.alias(f"__{n}") for n, v in sums.items()])
        .select("*", exploded.alias("mark"))
        .select(
            *keys,
            (F.col("us") + F.col("mark.shift")).alias("at"),
            F.when(F.col("mark.step") == 0, F.struct(*payload)).alias("row"),
            *[(F.col(f"__{n}") * signs[n]).alias(f"__{n}") for n in sums],
        )
    )
    running = strictly_before(*keys)
    return (
        marks.select(
            *keys,
            "row",
            *[F.coalesce(F.sum(f"__{n}").over(running), F.lit(0)).alias(n) for n in sums],
        )
        .where(F.col("row").isNotNull())
        .select(*keys, "row.*", *sums)
    )


def trailing(
    df: DataFrame,
    keys: list[str],
    width: int,
    sums: dict[str, Column],
    heat: Heat = DEFAULT_HEAT,
) -> DataFrame:
    """``df`` (with ``us``) plus, per entry of ``sums``, the sum over ``[us - width, us)``.

    Rows with a NULL key match nothing and get zeros.
    """
    return trailing_terms(df, [(keys, width, sums)], heat)


def trailing_terms(
    df: DataFrame,
    terms: list[tuple[list[str], int, dict[str, Column]]],
    heat: Heat = DEFAULT_HEAT,
    hot: HotSet | None = None,
) -> DataFrame:
    """Several trailing windows whose keys start with the same column.

    The rows are split by that column's heat once, ordinary rows are shuffled once, and windows of the same keys share a
    sweep whatever their widths.
    """
    lead = terms[0][0][0]
    spaces: dict[tuple[str, ...], tuple[dict[str, int], dict[str, Column]]] = {}
    for keys, width, sums in terms:
        widths, columns = spaces.setdefault(tuple(keys), ({}, {}))
        widths.update(dict.fromkeys(sums, width))
        columns.update(sums)
    if hot is None:
        hot = hot_keys(df, lead, heat)
    names = [n for _, _, sums in terms for n in sums]
    wanted = [*df.columns, *names]

    cold = without_hot(df, lead, hot).repartition(lead)
    for keys, (widths, sums) in spaces.items():
        cold = _complete(sweep(cold, list(keys), widths, sums), list(keys), sums)
    parts = [cold.select(*wanted)]
    if hot.rows is not None:
        heavy = only_hot(df, lead, hot)
        for keys, (widths, sums) in spaces.items():
            heavy = _heavy_sums(heavy, only_hot(df, lead, hot), list(keys), widths, sums, hot.lane_rows)
        parts.append(heavy.select(*wanted))
    if hot.has_null:
        types = {f.name: f.dataType for f in cold.schema.fields}
        zeros = [F.lit(0).cast(types[n]).alias(n) for n in names]
        parts.append(df.where(F.col(lead).isNull()).select("*", *zeros))
    return union_all(parts)


def _complete(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Zero where one of the further keys is NULL."""
    if len(keys) == 1:
        return rows
    whole = F.lit(True)
    for k in keys[1:]:
        whole = whole & F.col(k).isNotNull()
    return rows.withColumns({n: F.when(whole, F.col(n)).otherwise(F.lit(0)) for n in sums})


def _heavy_sums(
    rows: DataFrame,
    ledger: DataFrame,
    keys: list[str],
    widths: dict[str, int],
    sums: dict[str, Column],
    lane_rows: int,
) -> DataFrame:
    """``rows`` of hot keys plus the sums, tallied from ``ledger`` (the same rows, unextended)."""
    tallied = ledger.groupBy(*keys, "us").agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    exploded, signs = enter_and_leave(widths)
    marks = tallied.select("*", exploded.alias("mark")).select(
        *keys,
        (F.col("us") + F.col("mark.shift")).alias("at"),
        (F.col("mark.step") == 0).alias("own"),
        *[(F.col(n) * signs[n]).alias(n) for n in sums],
    )
    answers = lane_running(marks, keys, list(sums), lane_rows).withColumnRenamed("at", "us")
    return rows.join(answers, [*keys, "us"], "left").withColumns(
        {n: F.coalesce(F.col(n), F.lit(0)) for n in sums}
    )
