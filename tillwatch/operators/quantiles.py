"""Exact quantiles of several columns and classes at once, by narrowing ranges.

A wanted rank starts with its column's whole range.  Each round cuts the ranges into ``bins`` equal parts, counts the rows
per part - combined map-side, for all columns, classes and ranks in one pass - and keeps the part that holds the rank, between the
smallest and the largest value in it.  A rank is found when its part holds one value; parts of at most ``few`` rows
are sorted, all in one pass at the end.  What a round brings to the driver is a row per rank; no task sorts a column.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

BINS = 1024
FEW = 10_000

# The driver's small tables are Arrow tables: Spark takes them into the plan, without jobs and Python workers to read them.
CELLS = pa.schema([("l", pa.int32()), ("f", pa.string()), ("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])
ASKED = pa.schema([("c", pa.int32()), ("place", pa.int64())])


def _table(df: DataFrame, schema: pa.Schema, rows: list[tuple]) -> DataFrame:
    columns = [pa.array(list(values), f.type) for values, f in zip(zip(*rows), schema)]
    return df.sparkSession.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], label: str | None = None, bins: int = BINS, few: int = FEW
) -> dict[tuple[int | None, str], list[float]]:
    """(class, column) -> the interpolated quantiles of its values that are neither NULL nor NaN.

    Between two values the quantile lies in proportion, as in numpy's and SQL's continuous percentiles.  Classes are those
    of ``label`` cast to int; without ``label`` all rows are one class, None.  Columns without a value are left out.
    """
    mark = F.col(label).cast("int") if label else F.lit(None).cast("int")
    reals = df.select(mark.alias("__label"), *[F.col(c).cast("double").alias(c) for c in columns])
    cells = [F.struct(F.lit(c).alias("__feature"), F.col(c).alias("value")) for c in columns]
    long = reals.select("__label", F.inline(F.array(*cells))).where(F.col("value").isNotNull() & ~F.isnan("value"))
    # A row for each class and column.
    spans = long.groupBy("__label", "__feature").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    wanted: dict[tuple, list[tuple[int, float]]] = {}
    open_cells: dict[tuple, tuple[float, float, int]] = {}  # (class, column, rank) -> low, high, place within
    sizes: dict[tuple, int] = {}
    for r in spans:
        key = r["__label"], r["__feature"]
        wanted[key] = []
        for p in probabilities:
            at = p * (r.n - 1)
            rank = math.floor(at)
            wanted[key].append((rank, at - rank))
            for k in {rank, min(rank + 1, r.n - 1)}:
                open_cells[*key, k], sizes[*key, k] = (r.low, r.high, k), r.n
    found: dict[tuple, float] = {}
    small: dict[tuple, tuple[float, float, int]] = {}
    while True:
        found |= {c: low for c, (low, high, _) in open_cells.items() if low == high}
        small |= {c: v for c, v in open_cells.items() if c not in found and sizes[c] <= few}
        open_cells = {c: v for c, v in open_cells.items() if c not in found and c not in small}
        if not open_cells:
            break
        for c, (low, high, place, n) in _narrowed(long, open_cells, bins).items():
            open_cells[c], sizes[c] = (low, high, place), n
    if small:
        found |= _sorted(long, small)
    out = {}
    for (mark, column), ranks in wanted.items():
        values = []
        for rank, share in ranks:
            low = found[mark, column, rank]
            values.append(low + (found[mark, column, rank + 1] - low) * share if share else low)
        out[mark, column] = values
    return out


def _in_cells(long: DataFrame, cells: dict) -> tuple[DataFrame, list]:
    """The values within each cell's range (ranks that share a range share a cell), and the cells by number."""
    ranges: dict[tuple, list] = {}
    for c, (low, high, place) in cells.items():
        ranges.setdefault((c[0], c[1], low, high), []).append((c, place))
    numbered = list(ranges.items())
    rows = [(label, feature, i, low, high) for i, ((label, feature, low, high), _) in enumerate(numbered)]
    table = _table(long, CELLS, rows)
    # As many rows as there are ranks.
    inside = F.col("__label").eqNullSafe(F.col("l")) & (F.col("__feature") == F.col("f")) & F.col("value").between(F.col("low"), F.col("high"))
    return long.join(F.broadcast(table), inside).select("cell", "low", "high", "value"), numbered


def _narrowed(long: DataFrame, cells: dict, bins: int) -> dict:
    """Each rank's part of its range: smallest and largest value, place in it, rows."""
    rows, numbered = _in_cells(long, cells)
    # Halved first, so that the widest ranges don't overflow; falls short of a bin at most, in order all the same.
    share = (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    part = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy("cell", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    before = F.sum("n").over(Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    asked = _table(long, ASKED, sorted({(i, place) for i, (_, ranks) in enumerate(numbered) for _, place in ranks}))
    hit = (F.col("cell") == F.col("c")) & (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))
    parts = {(r["c"], r["place"]): r for r in counts.join(F.broadcast(asked), hit).collect()}
    out = {}
    for i, (_, ranks) in enumerate(numbered):
        for c, place in ranks:
            r = parts[i, place]
            out[c] = r["low"], r["high"], place - r["before"], r["n"]
    return out


def _sorted(long: DataFrame, cells: dict) -> dict:
    """The values of ranks whose ranges hold few rows."""
    rows, numbered = _in_cells(long, cells)
    place = F.row_number().over(Window.partitionBy("cell").orderBy("value")) - 1
    asked = _table(long, ASKED, sorted({(i, place) for i, (_, ranks) in enumerate(numbered) for _, place in ranks}))
    placed = rows.withColumn("at", place).join(F.broadcast(asked), (F.col("cell") == F.col("c")) & (F.col("at") == F.col("place")))
    values = {(r["c"], r["place"]): r["value"] for r in placed.collect()}
    return {c: values[i, place] for i, (_, ranks) in enumerate(numbered) for c, place in ranks}
