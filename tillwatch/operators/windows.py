"""Per-key windows that are not trailing sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .hotkeys import DEFAULT_HEAT, Heat, hot_keys, only_hot, union_all, without_hot
from .trailing import in_lanes, lane_running


def lag_by_key(rows: DataFrame, key: str, heat: Heat = DEFAULT_HEAT) -> DataFrame:
    """Adds ``previous`` = struct(us, id) of the row before in (us, id) order, ties included.

    A hot key is cut into lanes of rows; each lane's first row takes the last row of the
    key's earlier lane, which a table of lane maxima supplies.
    """
    hot = hot_keys(rows, key, heat)
    place = F.struct("us", "id")
    by_key = Window.partitionBy(key).orderBy("us", "id")
    parts = [
        without_hot(rows, key, hot).select("*", F.lag(place).over(by_key).alias("previous"))
    ]
    if hot.rows is not None:
        laned = in_lanes(only_hot(rows, key, hot), [key], ["us", "id"], hot.lane_rows)
        tails = laned.groupBy(key, "lane").agg(F.max(place).alias("tail"))
        over_lanes = Window.partitionBy(key).orderBy("lane")
        carried = tails.select(key, "lane", F.lag("tail").over(over_lanes).alias("before"))
        in_lane = Window.partitionBy(key, "lane").orderBy("us", "id")
        parts.append(
            laned.withColumn("inside", F.lag(place).over(in_lane))
            .join(carried, [key, "lane"], "left")
            .withColumn("previous", F.coalesce("inside", "before"))
            .drop("inside", "before", "lane")
        )
    if hot.has_null:
        nothing = F.lit(None).cast(parts[0].schema["previous"].dataType)
        parts.append(rows.where(F.col(key).isNull()).select("*", nothing.alias("previous")))
    return union_all(parts)


def first_per_group(
    rows: DataFrame, keys: list[str], order_desc: list[str], keep: list[str]
) -> DataFrame:
    """The row with the greatest ``order_desc`` per group: an aggregate, combined map-side."""
    best = F.max_by(F.struct(*order_desc, *keep), F.struct(*order_desc))
    return rows.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def latest_mark(
    rows: DataFrame, key: str, marked: Column, name: str, heat: Heat = DEFAULT_HEAT
) -> DataFrame:
    """Adds the latest ``us`` at or before each row's where ``marked`` holds."""
    hot = hot_keys(rows, key, heat)
    mark = F.when(marked, F.col("us"))
    so_far = Window.partitionBy(key).orderBy("us").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    parts = [without_hot(rows, key, hot).select("*", F.max(mark).over(so_far).alias(name))]
    if hot.rows is not None:
        heavy = only_hot(rows, key, hot)
        # A mark counts for its own time too: ask one microsecond later.
        events = F.array(
            F.struct(F.col("us").alias("at"), F.lit(False).alias("own"), mark.alias("seen")),
            F.struct(
                (F.col("us") + 1).alias("at"),
                F.lit(True).alias("own"),
                F.lit(None).cast("long").alias("seen"),
            ),
        )
        found = lane_running(heavy.select(key, F.inline(events)), [key], [], hot.lane_rows, last="seen")
        answers = found.select(key, (F.col("at") - 1).alias("us"), F.col("seen").alias(name))
        parts.append(heavy.join(answers, [key, "us"], "left"))
    if hot.has_null:
        nothing = F.lit(None).cast("long").alias(name)
        parts.append(rows.where(F.col(key).isNull()).select("*", nothing))
    return union_all(parts)
