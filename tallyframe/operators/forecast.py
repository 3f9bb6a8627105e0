"""Linear-trend forecast of the coming months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import named
from tallyframe.functions.numbers import exact_sum, round2
from tallyframe.operators.trend import by_period, in_order
from tallyframe.settings import DEFAULT_FORECAST_STEPS


def fit_sums(trend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What a line through the months of a series takes: months, exact sums of y and of x y, the last month.

    x is the month's position 0..n-1, so gaps between months are closed up. Series with fewer than two
    months are left out.
    """
    value, position = F.col("kpi_value"), F.col("__position")
    return (
        trend.withColumn("__position", F.row_number().over(by_period(by)) - 1)
        .groupBy(*[named(key) for key in by])
        .agg(
            F.count(F.lit(1)).alias("months"),
            exact_sum(value).alias("__y"),
            exact_sum(value * position).alias("__xy"),
            F.max("period").alias("last_period"),
        )
        .filter("months >= 2")
    )


def rise() -> Column:
    """Twice the sum of products of x and y around their means; x has the mean (n - 1) / 2."""
    return 2 * F.col("__xy") - (F.col("months") - 1) * F.col("__y")


def run() -> Column:
    """n (n^2 - 1), twelve times the sum of squares of x around its mean."""
    months = F.col("months").cast("double")
    return months * (months * months - 1)


def linear_fit(trend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Least squares of the value on the month's position 0..n-1, per series.

    Positions close up gaps between months. Series with fewer than two months
    are left out.
    """
    slope = 6 * rise() / run()
    intercept = F.col("__y") / F.col("months") - slope * (F.col("months") - 1) / 2
    fit = fit_sums(trend, by)
    keys = [named(key) for key in by]
    return fit.select(*keys, slope.alias("slope"), intercept.alias("intercept"), "months", "last_period")


def future_periods(last_period: Column, step: Column) -> Column:
    """The month ``step`` calendar months after ``last_period``."""
    first_day = F.to_date(F.concat(last_period, F.lit("-01")), "yyyy-MM-dd")
    return F.date_format(F.add_months(first_day, step), "yyyy-MM")


def forecast_kpi(
    trend: DataFrame, steps: int = DEFAULT_FORECAST_STEPS, by: Sequence[str] = ()
) -> DataFrame:
    """Value of the fitted line for the next calendar months."""
    keys = [named(key) for key in by]
    fit = fit_sums(trend, by)
    if steps < 1:
        fit = fit.filter(F.lit(False))
    step, months = F.col("__step"), F.col("months")
    # One fraction, so that nothing is rounded before the end: the mean of y, and the slope on what lies beyond that of x.
    beyond = 2 * (months + step - 1) - (months - 1)
    value = (F.col("__y") * (months * months - 1) + 3 * rise() * beyond) / run()
    future = fit.withColumn(
        "__step", F.explode(F.sequence(F.lit(1), F.lit(max(steps, 1))))
    ).select(
        *keys,
        future_periods(F.col("last_period"), step).alias("period"),
        round2(value).alias("forecast_value"),
    )
    return in_order(future, by)
