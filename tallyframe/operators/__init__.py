"""Analyses: each takes DataFrames and returns a lazy DataFrame.

``by`` names series columns: with it, one job computes every series; without
it, the whole table is one series.
"""

from tallyframe.operators.adhoc import kpi_by_segment, run_sql, sample_queries
from tallyframe.operators.anomaly import anomaly_count, detect_anomalies
from tallyframe.operators.compare import (
    compare_periods,
    compare_series,
    comparison_periods,
    series_months,
)
from tallyframe.operators.drivers import driver_extremes, drivers_all_segments, segment_drivers
from tallyframe.operators.forecast import forecast_kpi, future_periods, linear_fit
from tallyframe.operators.profile import (
    duplicate_rows,
    profile_columns,
    profile_dataset,
    quality_notes,
    suggest_settings,
)
from tallyframe.operators.state import (
    estimate_error,
    kpi_state,
    read_trend,
    refresh_trend,
    roll_up,
    write_trend,
)
from tallyframe.operators.tagging import tag_questions
from tallyframe.operators.trend import (
    kpi_trend,
    latest_change,
    list_periods,
    monthly_kpi,
    monthly_kpis,
    period_changes,
)

__all__ = [
    "anomaly_count",
    "compare_periods",
    "compare_series",
    "comparison_periods",
    "detect_anomalies",
    "driver_extremes",
    "drivers_all_segments",
    "duplicate_rows",
    "estimate_error",
    "forecast_kpi",
    "future_periods",
    "kpi_by_segment",
    "kpi_state",
    "kpi_trend",
    "latest_change",
    "linear_fit",
    "list_periods",
    "monthly_kpi",
    "monthly_kpis",
    "period_changes",
    "profile_columns",
    "profile_dataset",
    "quality_notes",
    "read_trend",
    "refresh_trend",
    "roll_up",
    "run_sql",
    "sample_queries",
    "segment_drivers",
    "series_months",
    "suggest_settings",
    "tag_questions",
    "write_trend",
]
