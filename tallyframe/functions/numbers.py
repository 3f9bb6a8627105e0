"""Rounding, change and number formatting."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tallyframe.settings import AOV, REVENUE


# Sums are exact in units of this share of one; amounts from LARGE on are beyond that.
UNITS = 1_000_000_000
LARGE = 1e15


def round2(value: Column) -> Column:
    """Round to 2 decimals in one step, halves of the shortest decimal form away from zero."""
    return F.round(value, 2)


def exact_sum(value: Column, over: WindowSpec | None = None) -> Column:
    """Sum of doubles that does not depend on their order, as if each had 9 decimals; NULL without values.

    Distributed sums add up in no fixed order, and the last bits of plain ones vary from run to run, which
    would decide halves when they are rounded. Here whole parts and billionths are added as integers
    (the latter in two pieces, so that none overflows), which also takes the noise out of values such
    as 901.1999999999999. Amounts of ``LARGE`` or more, and sums beyond 64 bits, fall back to the plain sum.
    """

    def whole_table(measure: Column) -> Column:
        return measure if over is None else measure.over(over)

    usual = F.when(F.abs(value) < LARGE, value)
    whole = F.floor(usual)
    units = F.floor((usual - whole) * UNITS + 0.5)
    high, low = F.shiftright(units, 10), units.bitwiseAND(F.lit(1023))
    wholes, highs, lows = whole_table(F.try_sum(whole)), whole_table(F.sum(high)), whole_table(F.sum(low))
    counted = highs.cast("decimal(20,0)") * F.lit(1024).cast("decimal(4,0)") + lows.cast("decimal(20,0)")
    parts = counted.cast("decimal(26,0)") * F.lit(Decimal(1).scaleb(-9)).cast("decimal(9,9)")
    exact = (wholes.cast("decimal(20,0)") + parts).cast("double")
    large = whole_table(F.count(F.when(F.abs(value) >= LARGE, 1)))
    return F.when((large == 0) & wholes.isNotNull(), exact).otherwise(whole_table(F.sum(value)))


def percent_change(previous: Column, current: Column) -> Column:
    """NULL when the previous value is 0."""
    return F.try_divide(current - previous, previous) * 100


def direction(change: Column) -> Column:
    return (
        F.when(change > 0, "increased").when(change < 0, "decreased").when(change == 0, "stayed flat")
    )


def format_kpi_value(value: Column, kpi_name: str) -> Column:
    """``$1,234.50`` for money, ``1,234`` for counts, ``N/A`` if missing."""
    if kpi_name in (REVENUE, AOV):
        text = F.format_string("$%,.2f", value)
    else:
        text = F.format_number(value, 0)
    return F.when(value.isNull(), "N/A").otherwise(text)


def plain_number(value: Column) -> Column:
    """A number rounded to 2 decimals as text without trailing zero: 5.0, 0.25; None if missing."""
    text = F.regexp_replace(value.cast("decimal(38,2)").cast("string"), "0$", "")
    return F.coalesce(text, F.lit("None"))
