"""Rounding and printing money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`, keeping the whole lazy inside coalesce()."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nonblank(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def money(col: Column) -> Column:
    return col.cast("decimal(18,2)")


def round_half_up(col: Column) -> Column:
    return money(F.round(col, 2))


def round_cents(col: Column) -> Column:
    """Two decimals, halves towards plus infinity; missing counts as zero."""
    return money(F.floor(F.coalesce(col, F.lit(0)) * 100 + F.lit(0.5).cast("decimal(2,1)")) / 100)


def round_units(col: Column) -> Column:
    """Whole units, halves towards plus infinity."""
    return F.floor(F.coalesce(col, F.lit(0)) + F.lit(0.5).cast("decimal(2,1)")).cast("bigint")


def format_amount(col: Column) -> Column:
    """Two-decimal text, empty when missing."""
    return F.coalesce(money(col).cast("string"), F.lit(""))
