"""Root-cause drivers: how much each segment contributed to a change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import named, present
from tallyframe.functions.dates import (
    STORED_MONTH,
    coerce_date,
    drop_undated,
    filter_periods,
    month_of,
    period_of,
)
from tallyframe.functions.kpi import check_kpi, kpi_value, role_columns
from tallyframe.functions.numbers import percent_change, round2
from tallyframe.operators.compare import CUSTOM, series_months
from tallyframe.operators.trend import MONTH, collect_periods
from tallyframe.session import durable
from tallyframe.settings import Settings

SEGMENT_COLUMN = "segment_column"
SEGMENT = "segment"
DRIVER_VALUES = (
    "previous_period",
    "current_period",
    "previous_value",
    "current_value",
    "absolute_change",
    "percent_change",
)


def segment_drivers(
    df: DataFrame,
    settings: Settings,
    kpi_name: str,
    segment_col: str,
    previous: str | None = None,
    current: str | None = None,
    by: Sequence[str] = (),
    periods: Sequence[str] | None = None,
    ordered: bool = True,
    months: DataFrame | None = None,
) -> DataFrame:
    """KPI of every segment in two months, ascending by change.

    The months default to the last two, with ``by`` to the last two of each series.
    A segment missing in one month counts 0.0 there; rows without segment are left
    out; with fewer than two months in the data (of a series, unless both months
    are named) the result is empty. ``periods`` are the sorted months present, and
    ``months`` the two months of each series (``series_months``); left out, a job
    over the date and key columns finds them. ``ordered=False`` saves the sort when
    the result is processed further.
    """
    rows = coerce_date(df, settings.date_col, settings.date_format)
    labelled = rows.select(
        *base_columns(rows, kpi_name, settings, by), present(rows, segment_col).alias(SEGMENT)
    )
    drivers = segment_changes(
        rows, labelled, settings, kpi_name, by, [SEGMENT], previous, current, periods, months
    )
    drivers = drivers.select(
        *[named(key) for key in by],
        F.lit(segment_col).alias(SEGMENT_COLUMN),
        SEGMENT,
        *DRIVER_VALUES,
    )
    if not ordered:
        return drivers
    return drivers.orderBy(*[named(key) for key in by], "absolute_change", SEGMENT)


def drivers_all_segments(
    df: DataFrame,
    settings: Settings,
    kpi_name: str,
    segment_cols: Sequence[str],
    previous: str | None = None,
    current: str | None = None,
    by: Sequence[str] = (),
    periods: Sequence[str] | None = None,
    ordered: bool = True,
    months: DataFrame | None = None,
) -> DataFrame:
    """``segment_drivers`` for several segment columns in one pass over two months.

    Rows are repeated once per segment column only after the month filter, and
    combined again before the shuffle.
    """
    rows = coerce_date(df, settings.date_col, settings.date_format)
    base = base_columns(rows, kpi_name, settings, by)
    named_segments = F.array(
        *[
            F.struct(
                F.lit(name).alias(SEGMENT_COLUMN),
                present(rows, name).cast("string").alias(SEGMENT),
            )
            for name in segment_cols
        ]
    )
    labelled = rows.select(*base, F.inline(named_segments))
    segment = [SEGMENT_COLUMN, SEGMENT]
    drivers = segment_changes(
        rows, labelled, settings, kpi_name, by, segment, previous, current, periods, months
    )
    if not ordered:
        return drivers
    return drivers.orderBy(*[named(key) for key in by], SEGMENT_COLUMN, "absolute_change", SEGMENT)


def segment_changes(
    rows: DataFrame,
    labelled: DataFrame,
    settings: Settings,
    kpi_name: str,
    by: Sequence[str],
    segment: Sequence[str],
    previous: str | None,
    current: str | None,
    periods: Sequence[str] | None,
    months: DataFrame | None,
) -> DataFrame:
    """Changes by series and segment, in the months named, of the table, or of each series."""
    if months is None and by and (previous is None or current is None):
        months = own_months(rows, settings, by, previous, current)
    if months is not None:
        chosen = rows_of_series(labelled, settings, by, months)
        return compare_sides(chosen, settings, kpi_name, [*by, *segment])
    if periods is None:
        periods = present_periods(rows, settings, previous, current)
    chosen = rows_of_table(labelled, settings, previous, current, periods)
    return compare_sides(chosen, settings, kpi_name, [*by, *segment])


def present_periods(
    rows: DataFrame, settings: Settings, previous: str | None, current: str | None
) -> list[str]:
    """Enough of the months present to choose two and to tell that there are two.

    If both months are named and found, only those two months are read.
    """
    if previous is not None and current is not None:
        two_months = filter_periods(rows, settings.date_col, previous, current)
        found = collect_periods(two_months, settings)
        if len(found) == 2:
            return found
    return collect_periods(rows, settings)


def base_columns(
    rows: DataFrame, kpi_name: str, settings: Settings, by: Sequence[str]
) -> list[Column]:
    check_kpi(kpi_name, settings)
    stored = [name for name in rows.columns if name == STORED_MONTH]
    names = dict.fromkeys([*by, settings.date_col, *role_columns(kpi_name, settings), *stored])
    return [named(name) for name in names]


def own_months(
    rows: DataFrame,
    settings: Settings,
    by: Sequence[str],
    previous: str | None = None,
    current: str | None = None,
) -> DataFrame:
    """The months each series compares, from one job over the date and key columns."""
    month = month_of(settings.date_col).alias(MONTH)
    keys = [named(key) for key in by]
    present = drop_undated(rows, settings.date_col).select(*keys, month).distinct()
    months = present.select(*keys, period_of(F.col(MONTH)).alias("period"))
    return durable(series_months(months, by, CUSTOM, previous, current))


def wanted_months(months: DataFrame) -> list[str]:
    """All months that some series compares: one short text per calendar month, however many series."""
    both = F.explode(F.array("previous_period", "current_period")).alias("period")
    return sorted(row.period for row in months.select(both).distinct().collect())


def rows_of_table(
    labelled: DataFrame,
    settings: Settings,
    previous: str | None,
    current: str | None,
    periods: Sequence[str],
) -> DataFrame:
    """Rows of the two months of the table, with these months."""
    if len(periods) < 2:
        previous, current = previous or "", current or ""
    else:
        previous, current = previous or periods[-2], current or periods[-1]
    rows = filter_periods(labelled, settings.date_col, previous, current)
    if len(periods) < 2:
        rows = rows.filter(F.lit(False))
    return rows.select(
        "*", F.lit(previous).alias("previous_period"), F.lit(current).alias("current_period")
    )


def rows_of_series(
    labelled: DataFrame, settings: Settings, by: Sequence[str], months: DataFrame
) -> DataFrame:
    """Rows of the two months of their series, with these months.

    The months that any series compares are a range on the raw date column, which reaches the scan. Then
    rows meet the months of their series by (series, month), so a hot series is dealt out by its
    months, and rows of other months go before anything is aggregated.
    """
    rows = filter_periods(labelled, settings.date_col, *wanted_months(months))
    pair = ["previous_period", "current_period"]
    # In a struct nulls are equal, and keys can't clash with the rows' columns.
    series = F.struct(*[named(key) for key in by]).alias("__series")
    each = months.select(series, *pair, F.explode(F.array_distinct(F.array(*pair))).alias("__period"))
    first_day = F.try_to_timestamp(F.concat("__period", F.lit("-01")), F.lit("yyyy-MM-dd"))
    wanted = each.select("__series", first_day.cast("date").alias(MONTH), *pair)
    keyed = rows.select("*", series, month_of(settings.date_col).alias(MONTH))
    return keyed.join(wanted, ["__series", MONTH]).drop("__series", MONTH)


def compare_sides(
    rows: DataFrame, settings: Settings, kpi_name: str, keys: Sequence[str]
) -> DataFrame:
    """KPI per key in two months; ``rows`` has a typed date, a segment and the two periods of its series."""
    key_columns = [named(key) for key in keys]
    # Two levels: a conditional distinct count per side in one aggregate would
    # multiply the rows; (segment, month) first needs no such expansion. The
    # periods follow from the series, so as keys they make no more groups.
    pair = ("previous_period", "current_period")
    values = (
        rows.filter(F.col(SEGMENT).isNotNull())
        .groupBy(*key_columns, *pair, month_of(settings.date_col).alias(MONTH))
        .agg(kpi_value(rows, kpi_name, settings).alias("value"))
    )

    def side(period: str) -> Column:
        in_month = F.when(period_of(F.col(MONTH)) == F.col(period), F.col("value"))
        return F.coalesce(F.max(in_month), F.lit(0.0))

    sides = values.groupBy(*key_columns, *pair).agg(
        side("previous_period").alias("previous"), side("current_period").alias("current")
    )
    return sides.select(
        *key_columns,
        *pair,
        round2(F.col("previous")).alias("previous_value"),
        round2(F.col("current")).alias("current_value"),
        round2(F.col("current") - F.col("previous")).alias("absolute_change"),
        round2(percent_change(F.col("previous"), F.col("current"))).alias("percent_change"),
    )


def driver_extremes(drivers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First and last driver by change per segment column; ties go by segment.

    The biggest negative driver is the smallest change, even if all rose.
    """
    change = F.struct("absolute_change", SEGMENT)
    return (
        drivers.groupBy(*[named(key) for key in by], SEGMENT_COLUMN)
        .agg(F.min(change).alias("lowest"), F.max(change).alias("highest"))
        .select(
            *[named(key) for key in by],
            SEGMENT_COLUMN,
            F.col("lowest.segment").alias("biggest_negative_driver"),
            F.col("lowest.absolute_change").alias("biggest_negative_change"),
            F.col("highest.segment").alias("biggest_positive_driver"),
            F.col("highest.absolute_change").alias("biggest_positive_change"),
        )
    )
