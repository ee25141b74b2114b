"""Field filters in the ledger API's shape, turned into Column predicates.

A filter is a mapping from column to a value (equality) or to a mapping of tests:
``equals in notIn lt lte gt gte contains startsWith endsWith not`` with
``mode: insensitive`` for the text tests.  ``AND``, ``OR`` and ``NOT`` take filters or
lists of filters.  SQL's three-valued logic is kept: ``notIn`` and ``not`` drop NULLs,
``equals: None`` and ``not: None`` are the null tests.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F


def _test(col: Column, name: str, value, fold) -> Column:
    if name == "equals":
        return col.isNull() if value is None else fold(col) == fold(F.lit(value))
    if name == "not":
        if value is None:
            return col.isNotNull()
        if isinstance(value, dict):
            return ~_column(col, value)
        return fold(col) != fold(F.lit(value))
    if name == "in":
        return col.isin(list(value)) if value else F.lit(False)
    if name == "notIn":
        return ~col.isin(list(value)) if value else F.lit(True)
    if name == "lt":
        return col < value
    if name == "lte":
        return col <= value
    if name == "gt":
        return col > value
    if name == "gte":
        return col >= value
    if name == "contains":
        return fold(col).contains(fold(F.lit(value)))
    if name == "startsWith":
        return fold(col).startswith(fold(F.lit(value)))
    if name == "endsWith":
        return fold(col).endswith(fold(F.lit(value)))
    raise ValueError(f"unknown test {name}")


def _column(col: Column, tests: dict) -> Column:
    fold = F.lower if tests.get("mode") == "insensitive" else (lambda c: c)
    parts = [_test(col, n, v, fold) for n, v in tests.items() if n != "mode"]
    return reduce(and_, parts, F.lit(True))


def where(filters: dict | list) -> Column:
    """The predicate for a filter; a list means all of them."""
    if isinstance(filters, list):
        return reduce(and_, [where(f) for f in filters], F.lit(True))
    parts = []
    for name, value in filters.items():
        if name == "AND":
            parts.append(where(value))
        elif name == "OR":
            parts.append(reduce(or_, [where(f) for f in value], F.lit(False)))
        elif name == "NOT":
            listed = value if isinstance(value, list) else [value]
            parts += [~where(f) for f in listed]
        elif isinstance(value, dict):
            parts.append(_column(F.col(name), value))
        else:
            parts.append(_column(F.col(name), {"equals": value}))
    return reduce(and_, parts, F.lit(True))


def order(spec: list[dict]) -> list[Column]:
    """Sort keys from ``[{column: "asc"}, {column: {"sort": "desc", "nulls": "last"}}]``.

    Without ``nulls`` the ledger database's default holds: NULLs sort as largest.
    """
    keys = []
    for item in spec:
        for name, how in item.items():
            how = how if isinstance(how, dict) else {"sort": how}
            down = how["sort"] == "desc"
            nulls = how.get("nulls", "first" if down else "last")
            keys.append(getattr(F.col(name), f"{how['sort']}_nulls_{nulls}")())
    return keys
