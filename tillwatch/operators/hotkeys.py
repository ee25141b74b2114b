"""Finding and separating hot keys.

A key (a hub account, a busy sender) may own a third of the ledger.  Joins and
windows keyed on it would put that third in one task, so operators split their
input by heat and give hot keys a plan of their own.

The hot set is safe to broadcast by construction: only the ``max_keys`` heaviest
keys are kept.  A key outside that list holds at most ``rows / max_keys`` rows,
so the ordinary plan stays bounded as well, and every row takes exactly one of
the two paths: nothing is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Heat:
    min_rows: int = 1_000_000  # a key with fewer rows is never hot
    max_keys: int = 100_000  # size bound of the broadcast set
    lane_rows: int = 500_000  # most rows of a hot key that one window group holds


DEFAULT_HEAT = Heat()


@dataclass(frozen=True)
class HotSet:
    """What one count per key found: the heavy keys, and whether NULL keys occur.

    ``rows`` is (hot_key) with at most ``Heat.max_keys`` rows, or None when no key is
    heavy; plans then leave the hot branch out altogether.
    """

    rows: DataFrame | None
    has_null: bool
    lane_rows: int = Heat.lane_rows


def hot_keys(df: DataFrame, key: str, heat: Heat = DEFAULT_HEAT) -> HotSet:
    """Count rows per key (combined map-side) and fetch the bounded list of heavy keys."""
    return hot_sets(df, [key], heat)[key]


def hot_sets(df: DataFrame, keys: list[str], heat: Heat = DEFAULT_HEAT) -> dict[str, HotSet]:
    """``hot_keys`` for several key columns of one table, in one pass over it.

    The heaviest ``max_keys`` per column are listed together, so a key left out holds at
    most ``rows / max_keys`` rows, whichever column it belongs to.
    """
    entries = [F.struct(F.lit(k).alias("key"), F.col(k).alias("hot_key")) for k in keys]
    found = (
        df.select(F.inline(F.array(*entries)))
        .groupBy("key", "hot_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= heat.min_rows) | F.col("hot_key").isNull())
        .orderBy(F.col("hot_key").isNotNull(), F.desc("n"), "key", "hot_key")
        .limit(len(keys) * (heat.max_keys + 1))
        .select("key", "hot_key")
    )
    schema = found.drop("key").schema
    listed = found.collect()
    sets = {}
    for key in keys:
        mine = [(r.hot_key,) for r in listed if r.key == key]
        heavy = [r for r in mine if r[0] is not None]
        rows = df.sparkSession.createDataFrame(heavy, schema=schema) if heavy else None
        sets[key] = HotSet(rows, len(heavy) < len(mine), heat.lane_rows)
    return sets


def only_hot(df: DataFrame, key: str, hot: HotSet) -> DataFrame:
    """Rows of hot keys."""
    return df.join(F.broadcast(hot.rows), F.col(key) == F.col("hot_key"), "left_semi")


def without_hot(df: DataFrame, key: str, hot: HotSet) -> DataFrame:
    """Rows of ordinary, known keys."""
    known = df.where(F.col(key).isNotNull()) if hot.has_null else df
    if hot.rows is None:
        return known
    return known.join(F.broadcast(hot.rows), F.col(key) == F.col("hot_key"), "left_anti")


def only_listed(dim: DataFrame, key: str, hot: HotSet) -> DataFrame:
    """The dimension rows of the hot keys: at most one per listed key."""
    return dim.join(F.broadcast(hot.rows), F.col(key) == F.col("hot_key"), "left_semi")


def union_all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def lookup(
    left: DataFrame,
    dim: DataFrame,
    key: str,
    dim_key: str,
    heat: Heat = DEFAULT_HEAT,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Left outer join against a table with one row per ``dim_key``.

    Ordinary keys take the join Catalyst picks.  Hot keys meet the at most
    ``max_keys`` matching dimension rows by broadcast, and NULL keys, which match
    nothing, skip the join instead of meeting in one partition.  ``counted`` names the
    table to count keys on when ``left`` is derived from it row by row.
    """
    hot = hot_keys(left if counted is None else counted, key, heat)
    extra = [f for f in dim.schema.fields if f.name != dim_key]

    def meet(rows: DataFrame, side: DataFrame) -> DataFrame:
        side = side.withColumnRenamed(dim_key, "__dim_key")
        return rows.join(side, F.col(key) == F.col("__dim_key"), "left").drop("__dim_key")

    parts = [meet(without_hot(left, key, hot), dim)]
    if hot.rows is not None:
        heavy = only_hot(left, key, hot)
        parts.append(meet(heavy, F.broadcast(only_listed(dim, dim_key, hot))))
    if hot.has_null:
        parts.append(
            left.where(F.col(key).isNull()).select(
                "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra]
            )
        )
    return union_all(parts)
