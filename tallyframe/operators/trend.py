"""Monthly KPI trend, its periods and the change from month to month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import named
from tallyframe.functions.dates import STORED_MONTH, coerce_date, drop_undated, month_of, period_of
from tallyframe.functions.kpi import check_kpi, kpi_value
from tallyframe.functions.numbers import percent_change, round2
from tallyframe.settings import Settings

MONTH = "__month"
CHANGE_FIELDS = (
    "current_period",
    "previous_period",
    "current_value",
    "previous_value",
    "absolute_change",
    "percent_change",
)


def dated(df: DataFrame, settings: Settings) -> DataFrame:
    """Rows with a usable date."""
    return drop_undated(coerce_date(df, settings.date_col, settings.date_format), settings.date_col)


def monthly_kpi(
    df: DataFrame, settings: Settings, kpi_name: str, by: Sequence[str] = ()
) -> DataFrame:
    """``kpi_trend`` without the final sort, for further processing."""
    check_kpi(kpi_name, settings)
    rows = dated(df, settings)
    return (
        rows.groupBy(*[named(key) for key in by], month_of(settings.date_col).alias(MONTH))
        .agg(round2(kpi_value(rows, kpi_name, settings)).alias("kpi_value"))
        .select(
            *[named(key) for key in by],
            period_of(F.col(MONTH)).alias("period"),
            F.lit(kpi_name).alias("kpi_name"),
            "kpi_value",
        )
    )


def monthly_kpis(
    df: DataFrame, settings: Settings, kpi_names: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """``monthly_kpi`` of several KPIs from one scan, a row for each KPI.

    One aggregation holds them all: it has at most one distinct count, which the Average Order Value
    shares with the Orders. As a key, ``kpi_name`` makes each KPI a series: ``by=["kpi_name", ...]``.
    """
    rows = dated(df, settings)
    keys = [named(key) for key in by]
    values = [round2(kpi_value(rows, name, settings)).alias(f"__kpi_{n}") for n, name in enumerate(kpi_names)]
    grouped = rows.groupBy(*keys, month_of(settings.date_col).alias(MONTH)).agg(*values)
    each = F.array(
        *[
            F.struct(F.lit(name).alias("kpi_name"), F.col(f"__kpi_{n}").alias("kpi_value"))
            for n, name in enumerate(kpi_names)
        ]
    )
    return grouped.select(*keys, period_of(F.col(MONTH)).alias("period"), F.inline(each))


def kpi_trend(
    df: DataFrame, settings: Settings, kpi_name: str, by: Sequence[str] = ()
) -> DataFrame:
    """KPI per calendar month, rounded to 2; months without rows do not appear."""
    return in_order(monthly_kpi(df, settings, kpi_name, by), by)


def in_order(months: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sort a table with one row per month by period, or per series by series and period.

    One series has no more rows than the calendar has months; these are put
    together directly, without sampling them for a range partitioning.
    """
    if by:
        return months.orderBy(*[named(key) for key in by], "period")
    return months.repartition(1).sortWithinPartitions("period")


def distinct_periods(df: DataFrame, settings: Settings) -> DataFrame:
    """Months that occur; reads only the date column and combines before the shuffle.

    Of a table stored by month, only the partitions' names are needed.
    """
    if STORED_MONTH in df.columns:
        stored = df.select(F.col(STORED_MONTH).alias(MONTH)).filter(F.col(MONTH).isNotNull())
        return stored.distinct().select(period_of(F.col(MONTH)).alias("period"))
    months = dated(df, settings).select(month_of(settings.date_col).alias(MONTH)).distinct()
    return months.select(period_of(F.col(MONTH)).alias("period"))


def list_periods(df: DataFrame, settings: Settings) -> DataFrame:
    """Months that occur, ascending."""
    return in_order(distinct_periods(df, settings))


def collect_periods(df: DataFrame, settings: Settings) -> list[str]:
    """Sorted periods on the driver: one short text per calendar month, however large the table."""
    return sorted(row.period for row in distinct_periods(df, settings).collect())


def by_period(by: Sequence[str]):
    """Window over the months of a series.

    A trend has one row per month, so a partition holds at most the calendar's
    months no matter how many base rows a series has.
    """
    return Window.partitionBy(*[named(key) for key in by]).orderBy("period")


def period_changes(trend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Change of every month against the month present before it; NULLs for the first."""
    previous = F.lag("kpi_value").over(by_period(by))
    return trend.select(
        *[named(key) for key in by],
        F.col("period").alias("current_period"),
        F.lag("period").over(by_period(by)).alias("previous_period"),
        round2(F.col("kpi_value")).alias("current_value"),
        round2(previous).alias("previous_value"),
        round2(F.col("kpi_value") - previous).alias("absolute_change"),
        round2(percent_change(previous, F.col("kpi_value"))).alias("percent_change"),
    )


def latest_change(trend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Last month against the one before it: one row per series, all NULL with fewer than two months."""
    change = F.when(F.col("previous_period").isNotNull(), F.struct(*CHANGE_FIELDS))
    return (
        period_changes(trend, by)
        .groupBy(*[named(key) for key in by])
        .agg(F.max(change).alias("change"))
        .select(*[named(key) for key in by], "change.*")
    )
