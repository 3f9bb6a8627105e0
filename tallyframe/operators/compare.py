"""Comparison of two chosen months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import named
from tallyframe.functions.numbers import direction, percent_change, round2
from tallyframe.operators.trend import by_period

# Ways to choose the two months (fixed values).
LATEST_VS_PREVIOUS = "Latest vs previous"
FIRST_VS_LATEST = "First vs latest"
CUSTOM = "Custom"


def comparison_periods(
    periods: Sequence[str],
    mode: str = LATEST_VS_PREVIOUS,
    previous: str | None = None,
    current: str | None = None,
) -> tuple[str, str]:
    """(previous, current) months for a comparison mode, from the sorted months present.

    Custom falls back to the last two months for what is not given.
    """
    if len(periods) < 2:
        raise ValueError("a comparison needs at least two periods")
    if mode == LATEST_VS_PREVIOUS:
        return periods[-2], periods[-1]
    if mode == FIRST_VS_LATEST:
        return periods[0], periods[-1]
    if mode == CUSTOM:
        return previous or periods[-2], current or periods[-1]
    raise ValueError(f"unknown comparison mode: {mode}")


def compare_periods(
    trend: DataFrame, previous: str, current: str, by: Sequence[str] = ()
) -> DataFrame:
    """Change between two months of a trend, with its direction.

    Without ``by`` the query fails when run if a month is absent; the check is a
    filter of the plan, so whatever is selected from the result keeps it, and
    the trend is not computed a second time for it. With ``by`` a series lacking
    a month keeps its row, with NULLs.
    """
    keys = [named(key) for key in by]

    def value_in(period: str) -> Column:
        return F.max(F.when(F.col("period") == period, F.col("kpi_value")))

    def missing(period: str) -> Column:
        return F.raise_error(f"period {period} is not in the trend").cast("boolean")

    complete = F.lit(True)
    if not by:
        complete = (
            F.when(F.col("previous_value").isNull(), missing(previous))
            .when(F.col("current_value").isNull(), missing(current))
            .otherwise(True)
        )
    values = (
        trend.filter(F.col("period").isin(previous, current))
        .groupBy(*keys)
        .agg(value_in(previous).alias("previous_value"), value_in(current).alias("current_value"))
        .filter(complete)
    )
    return compared_values(values, keys, F.lit(previous), F.lit(current))


def compared_values(
    values: DataFrame, keys: Sequence[Column], previous: Column, current: Column
) -> DataFrame:
    """The change fields and the direction from the values of two months."""
    change = F.col("current_value") - F.col("previous_value")
    return values.select(
        *keys,
        previous.alias("previous_period"),
        current.alias("current_period"),
        round2(F.col("previous_value")).alias("previous_value"),
        round2(F.col("current_value")).alias("current_value"),
        round2(change).alias("absolute_change"),
        round2(percent_change(F.col("previous_value"), F.col("current_value"))).alias(
            "percent_change"
        ),
        direction(change).alias("direction"),
    )


def with_own_months(
    months: DataFrame,
    by: Sequence[str],
    mode: str = LATEST_VS_PREVIOUS,
    previous: str | None = None,
    current: str | None = None,
) -> DataFrame:
    """``months`` (one row per series and period) with the two months its series compares.

    The rule is that of ``comparison_periods``, on the months of each series; both are
    NULL in a series with fewer than two. One sort of the months of a series gives all of them.
    """
    series = Window.partitionBy(*[named(key) for key in by])
    placed = months.withColumn("__before", F.lag("period").over(by_period(by)))
    first, last = F.min("period").over(series), F.max("period").over(series)
    # The latest of the months that another one follows.
    before = F.max("__before").over(series)
    pairs = {
        LATEST_VS_PREVIOUS: (before, last),
        FIRST_VS_LATEST: (first, last),
        CUSTOM: (F.coalesce(F.lit(previous), before), F.coalesce(F.lit(current), last)),
    }
    if mode not in pairs:
        raise ValueError(f"unknown comparison mode: {mode}")
    several = before.isNotNull()
    chosen = [F.when(several, period) for period in pairs[mode]]
    return placed.withColumns({"previous_period": chosen[0], "current_period": chosen[1]}).drop(
        "__before"
    )


def series_months(
    months: DataFrame,
    by: Sequence[str],
    mode: str = LATEST_VS_PREVIOUS,
    previous: str | None = None,
    current: str | None = None,
) -> DataFrame:
    """The two months of each series (keys, previous_period, current_period), for drivers and comparisons.

    Series with fewer than two months are left out.
    """
    keys = [named(key) for key in by]
    own = with_own_months(months.select(*keys, "period"), by, mode, previous, current)
    pair = F.first(F.struct("previous_period", "current_period")).alias("pair")
    chosen = own.filter("previous_period IS NOT NULL").groupBy(*keys).agg(pair)
    return chosen.select(*keys, "pair.*")


def compare_series(
    trend: DataFrame,
    by: Sequence[str],
    mode: str = LATEST_VS_PREVIOUS,
    previous: str | None = None,
    current: str | None = None,
) -> DataFrame:
    """Change of each series between its own two months; one row per series.

    All fields are NULL for a series with fewer than two months, and a value is NULL where a
    series lacks a named month.
    """
    keys = [named(key) for key in by]
    own = with_own_months(trend, by, mode, previous, current)

    def value_in(period: str) -> Column:
        return F.max(F.when(F.col("period") == F.col(period), F.col("kpi_value")))

    values = own.groupBy(*keys).agg(
        F.max("previous_period").alias("previous_period"),
        F.max("current_period").alias("current_period"),
        value_in("previous_period").alias("previous_value"),
        value_in("current_period").alias("current_value"),
    )
    return compared_values(values, keys, F.col("previous_period"), F.col("current_period"))
