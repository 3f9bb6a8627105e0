"""Sentences made from results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import named
from tallyframe.functions.numbers import direction, format_kpi_value, plain_number
from tallyframe.operators.drivers import SEGMENT, SEGMENT_COLUMN
from tallyframe.operators.trend import CHANGE_FIELDS

# Texts of the summary (fixed values).
NO_CHANGE = "Not enough period data is available to generate a KPI summary."
APPEARED = " has no value in "
VANISHED = " and no value in "
CHANGE_PERCENT = " This represents a %.2f%% change."
LOWEST_DRIVER = ", the biggest negative driver was "
HIGHEST_DRIVER = ". The biggest positive driver was "
DRIVER_CHANGE = " with a change of "

# Texts of the investigation log (fixed values): who does what, and the outcomes.
LOG_STEPS = (
    ("Data Quality Agent", "Checked missing values, duplicates, and column types."),
    ("KPI Agent", "Calculated monthly {kpi_name}."),
    ("Change Detection Agent", "Compared current period against previous period."),
    ("Anomaly Agent", "Checked for unusual KPI values using z-score detection."),
    ("Forecast Agent", "Generated a baseline KPI forecast."),
)
TREND_OUTCOME = "Generated %d monthly KPI records."
CHANGE_OUTCOME = "%s changed by %s (%s%%)."
ANOMALY_OUTCOME = "Detected %d anomalies."
NO_ANOMALY_CHECK = "No anomaly check was performed."
FORECAST_OUTCOME = "Forecasted %d future periods."
NO_FORECAST = "Not enough data to forecast."


def kpi_summary(
    change: DataFrame,
    kpi_name: str,
    drivers: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """One text per series: the change, and if drivers are given the extreme ones.

    Change and driver rows are stacked and folded in one aggregation per series;
    no join, and no driver list is gathered anywhere. A series with a value in
    one of the two months only gets a sentence that says so.
    """
    keys = [named(key) for key in by]
    changed = change.select(
        *keys,
        F.when(F.col("current_period").isNotNull(), F.struct(*CHANGE_FIELDS)).alias("change"),
    )
    stacked = changed
    if drivers is not None:
        stacked = changed.unionByName(
            drivers.select(
                *keys,
                F.struct(
                    "absolute_change", F.col(SEGMENT).cast("string").alias(SEGMENT), SEGMENT_COLUMN
                ).alias("driver"),
            ),
            allowMissingColumns=True,
        )
    folded = [F.max("change").alias("change")]
    if drivers is not None:
        folded += [F.min("driver").alias("lowest"), F.max("driver").alias("highest")]
    totals = stacked.groupBy(*keys).agg(*folded)

    parts = [change_sentence(kpi_name)]
    if drivers is not None:
        parts.append(driver_sentence(kpi_name))
    nothing = F.col("change.previous_value").isNull() & F.col("change.current_value").isNull()
    summary = F.when(nothing, NO_CHANGE).otherwise(F.concat(*parts))
    return totals.select(*keys, summary.alias("summary"))


def change_sentence(kpi_name: str) -> Column:
    percent = F.col("change.percent_change")
    previous, current = F.col("change.previous_value"), F.col("change.current_value")
    appeared = F.concat(
        F.lit(f"{kpi_name}{APPEARED}"),
        F.col("change.previous_period"),
        F.lit(" and is "),
        format_kpi_value(current, kpi_name),
        F.lit(" in "),
        F.col("change.current_period"),
        F.lit("."),
    )
    vanished = F.concat(
        F.lit(f"{kpi_name} was "),
        format_kpi_value(previous, kpi_name),
        F.lit(" in "),
        F.col("change.previous_period"),
        F.lit(VANISHED),
        F.col("change.current_period"),
        F.lit("."),
    )
    both = F.concat(
        F.lit(f"{kpi_name} "),
        direction(F.col("change.absolute_change")),
        F.lit(" from "),
        format_kpi_value(F.col("change.previous_value"), kpi_name),
        F.lit(" in "),
        F.col("change.previous_period"),
        F.lit(" to "),
        format_kpi_value(F.col("change.current_value"), kpi_name),
        F.lit(" in "),
        F.col("change.current_period"),
        F.lit("."),
        F.when(percent.isNotNull(), F.format_string(CHANGE_PERCENT, percent)).otherwise(""),
    )
    return F.when(previous.isNull(), appeared).when(current.isNull(), vanished).otherwise(both)


def driver_sentence(kpi_name: str) -> Column:
    lowest, highest = F.col("lowest"), F.col("highest")
    text = F.concat(
        F.lit(" By "),
        lowest[SEGMENT_COLUMN],
        F.lit(LOWEST_DRIVER),
        lowest[SEGMENT],
        F.lit(DRIVER_CHANGE),
        format_kpi_value(lowest["absolute_change"], kpi_name),
        F.lit(HIGHEST_DRIVER),
        highest[SEGMENT],
        F.lit(DRIVER_CHANGE),
        format_kpi_value(highest["absolute_change"], kpi_name),
        F.lit("."),
    )
    return F.coalesce(text, F.lit(""))


def investigation_steps(
    notes: DataFrame,
    trend: DataFrame,
    change: DataFrame,
    anomalies: DataFrame,
    forecast: DataFrame,
    kpi_name: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Log of an investigation, five rows for each series: step, who, what, outcome.

    Each table is reduced to one row a series, and these rows are stacked and folded in one more
    aggregation, so the tables are never joined. The notes are about the whole dataset and the same
    in every series; without ``by`` there is one series, also where there are no months.
    """
    keys = [named(key) for key in by]
    rows = F.count(F.lit(1))
    # Months, change, anomalies and forecast of a series, each from its own table.
    facts = (
        (trend, {"months": rows}),
        (change, {"absolute_change": F.max("absolute_change"), "percent_change": F.max("percent_change")}),
        (anomalies, {"checked": rows, "anomalies": F.count_if("is_anomaly")}),
        (forecast, {"forecasts": rows}),
    )
    stacked = None
    for table, measures in facts:
        part = table.groupBy(*keys).agg(*[value.alias(name) for name, value in measures.items()])
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    names = [name for _, measures in facts for name in measures]
    folded = stacked.groupBy(*keys).agg(*[F.max(name).alias(name) for name in names])
    counted = folded.withColumns(
        {name: F.coalesce(name, F.lit(0)) for name in ("months", "checked", "anomalies", "forecasts")}
    )
    outcomes = (
        notes.agg(F.max("quality_notes")).scalar(),
        F.format_string(TREND_OUTCOME, "months"),
        F.format_string(
            CHANGE_OUTCOME,
            F.lit(kpi_name),
            plain_number(F.col("absolute_change")),
            plain_number(F.col("percent_change")),
        ),
        F.when(F.col("checked") > 0, F.format_string(ANOMALY_OUTCOME, "anomalies")).otherwise(
            NO_ANOMALY_CHECK
        ),
        F.when(F.col("forecasts") > 0, F.format_string(FORECAST_OUTCOME, "forecasts")).otherwise(
            NO_FORECAST
        ),
    )
    log = [
        F.struct(
            F.lit(number).alias("step_no"),
            F.lit(agent).alias("agent"),
            F.lit(task.format(kpi_name=kpi_name)).alias("task"),
            outcome.alias("output"),
        )
        for number, ((agent, task), outcome) in enumerate(zip(LOG_STEPS, outcomes), start=1)
    ]
    return counted.select(*keys, F.inline(F.array(*log)))
