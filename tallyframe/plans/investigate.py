"""All analyses of one KPI."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import data_type, is_categorical
from tallyframe.functions.kpi import check_kpi
from tallyframe.operators.anomaly import detect_anomalies
from tallyframe.operators.compare import (
    CUSTOM,
    compare_periods,
    compare_series,
    comparison_periods,
    series_months,
)
from tallyframe.operators.drivers import segment_drivers, wanted_months
from tallyframe.operators.forecast import forecast_kpi
from tallyframe.operators.profile import (
    column_counts,
    counted_date_format,
    profile_columns,
    profile_dataset,
    quality_notes,
)
from tallyframe.operators.trend import in_order, latest_change, monthly_kpi
from tallyframe.plans.narrative import investigation_steps, kpi_summary
from tallyframe.plans.report import report_bundle
from tallyframe.session import durable
from tallyframe.settings import DEFAULT_FORECAST_STEPS, DEFAULT_Z_THRESHOLD, Settings, pick_column


class Investigation:
    """The results for one KPI, each made when first asked for; with ``by`` for any number of series.

    The small tables several results need (profile counts, trend, drivers) are
    computed once and kept in the checkpoint folder. So the base table is read
    once for the trend, once for the profile counts, once to look for
    duplicates, and for two months to find the drivers; what is not asked for
    is not read. Months default to the last two, with ``by`` to the last two of
    each series; a series is compared in its own months everywhere.

    ``segment_rows(*months)`` gives the rows of the compared months with the
    segment column (and keys), where that takes joins; ``df`` then needs no
    segment, and the trend is made without them. A ``segment_col`` that the table
    lacks falls back to that of the settings. ``report_rows`` cuts the report's
    tables, for each series.
    """

    def __init__(
        self,
        df: DataFrame,
        settings: Settings,
        kpi_name: str,
        segment_col: str | None = None,
        previous: str | None = None,
        current: str | None = None,
        threshold: float = DEFAULT_Z_THRESHOLD,
        steps: int = DEFAULT_FORECAST_STEPS,
        duplicates: bool = True,
        segment_rows: Callable[..., DataFrame] | None = None,
        report_rows: int | None = None,
        by: Sequence[str] = (),
    ) -> None:
        check_kpi(kpi_name, settings)
        self.df = df
        self.kpi_name = kpi_name
        self.by = list(by)
        # With rows of their own for segments, the table can't tell which columns these have.
        fallback = settings.segment_col or segment_col
        known = segment_rows is not None and segment_col is not None
        self.segment_col = segment_col if known else pick_column(df, segment_col, fallback)
        self.threshold = threshold
        self.forecast_steps = steps
        self.duplicates = duplicates
        self.segment_rows = segment_rows
        self.report_rows = report_rows
        self._settings = settings
        self._named = (previous, current)

    @cached_property
    def counts(self) -> DataFrame:
        return durable(column_counts(self.df))

    @cached_property
    def settings(self) -> Settings:
        """With the format of a text date, so that it is measured only once."""
        given = self._settings
        if given.date_format or not is_categorical(data_type(self.df, given.date_col)):
            return given
        return replace(given, date_format=counted_date_format(self.df, given, self.counts))

    @cached_property
    def months(self) -> DataFrame:
        return durable(monthly_kpi(self.df, self.settings, self.kpi_name, self.by))

    @cached_property
    def periods(self) -> list[str]:
        """The months of the table: one short text per calendar month."""
        return sorted(row.period for row in self.months.select("period").distinct().collect())

    @cached_property
    def series_months(self) -> DataFrame:
        """The months each series compares; only with ``by``."""
        return durable(series_months(self.months, self.by, CUSTOM, *self._named))

    @cached_property
    def compared(self) -> tuple[str | None, str | None]:
        """The two months to compare."""
        previous, current = self._named
        if len(self.periods) < 2:
            return previous, current
        chosen = comparison_periods(self.periods, CUSTOM, previous, current)
        missing = sorted(set(chosen) - set(self.periods))
        if missing:
            raise ValueError(f"periods not in the data: {missing}")
        return chosen

    @cached_property
    def profile(self) -> DataFrame:
        return profile_dataset(self.df, self.duplicates, self.counts)

    @cached_property
    def columns(self) -> DataFrame:
        return profile_columns(self.df, counts=self.counts)

    @cached_property
    def trend(self) -> DataFrame:
        return in_order(self.months, self.by)

    @cached_property
    def change(self) -> DataFrame:
        return latest_change(self.months, self.by)

    @cached_property
    def comparison(self) -> DataFrame:
        """Empty with fewer than two months in the data; a series with fewer has a row of NULLs."""
        if self.by:
            return compare_series(self.months, self.by, CUSTOM, *self._named)
        if len(self.periods) < 2:
            return self.change.filter(F.lit(False))
        return compare_periods(self.months, *self.compared)

    @cached_property
    def drivers(self) -> DataFrame | None:
        """None without a segment column or without two months to compare."""
        if self.segment_col is None:
            return None
        if self.by:
            compared = wanted_months(self.series_months)
            months = {"months": self.series_months}
        else:
            compared = self.compared
            months = {"previous": compared[0], "current": compared[1], "periods": self.periods}
        if not compared or None in compared:
            return None
        return durable(
            segment_drivers(
                self.segment_rows(*compared) if self.segment_rows else self.df,
                self.settings,
                self.kpi_name,
                self.segment_col,
                by=self.by,
                **months,
            )
        )

    @cached_property
    def anomalies(self) -> DataFrame:
        return in_order(detect_anomalies(self.months, self.threshold, self.by), self.by)

    @cached_property
    def forecast(self) -> DataFrame:
        return forecast_kpi(self.months, self.forecast_steps, self.by)

    @cached_property
    def summary(self) -> DataFrame:
        return kpi_summary(self.comparison, self.kpi_name, self.drivers, self.by)

    @cached_property
    def steps(self) -> DataFrame:
        return investigation_steps(
            quality_notes(self.profile),
            self.months,
            self.change,
            self.anomalies,
            self.forecast,
            self.kpi_name,
            self.by,
        )

    @cached_property
    def report(self) -> DataFrame:
        return report_bundle(
            self.kpi_name,
            self.comparison if self.by or len(self.periods) >= 2 else self.change,
            self.months,
            self.summary,
            self.drivers,
            self.anomalies,
            self.forecast,
            self.report_rows,
            self.by,
        )


# Results of an investigation, in the order they are usually read.
RESULTS = (
    "profile",
    "columns",
    "trend",
    "change",
    "comparison",
    "drivers",
    "anomalies",
    "forecast",
    "summary",
    "steps",
    "report",
)


def investigate(df: DataFrame, settings: Settings, kpi_name: str, **options) -> dict[str, DataFrame]:
    """All results of an ``Investigation`` by name; ``drivers`` is left out if there are none."""
    found = Investigation(df, settings, kpi_name, **options)
    tables = {name: getattr(found, name) for name in RESULTS}
    return {name: table for name, table in tables.items() if table is not None}
