"""Labels shown on the ledger pages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MASK = "•••• "
DASH = "—"


def plain_number(amount: Column) -> Column:
    """A decimal as shown text: no trailing zeros after the point."""
    text = amount.cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*[1-9])0+$", "$1"), r"\.0+$", "")


def masked_number(number: Column) -> Column:
    return F.concat(F.lit(MASK), F.right(number, F.lit(4)))


def location_label(lat: Column, lon: Column) -> Column:
    known = lat.isNotNull() & lon.isNotNull()
    text = F.format_string("%.3f, %.3f", lat, lon)
    return F.when(known, text).otherwise(F.lit(DASH))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def money_label(amount: Column, currency: Column) -> Column:
    sign = F.when(currency == "USD", F.lit("$")).otherwise(F.concat(currency, F.lit(" ")))
    return F.concat(sign, F.format_number(amount, 2))
