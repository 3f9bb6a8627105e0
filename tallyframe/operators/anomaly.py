"""Unusual months by z-score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import named
from tallyframe.functions.numbers import exact_sum, round2
from tallyframe.settings import DEFAULT_Z_THRESHOLD


def detect_anomalies(
    trend: DataFrame,
    threshold: float = DEFAULT_Z_THRESHOLD,
    by: Sequence[str] = (),
    value_col: str = "kpi_value",
) -> DataFrame:
    """Trend with mean, z-score, flag and direction; flags test the rounded z-score.

    The window sees one row per month of a series. A constant or single-month
    series has z-score 0.0 and no anomaly; without the value column the result
    is empty.
    """
    if value_col not in trend.columns:
        empty = F.lit(None).cast("double")
        return detect_anomalies(
            trend.withColumn(value_col, empty).filter(F.lit(False)), threshold, by, value_col
        )
    series = Window.partitionBy(*[named(key) for key in by])
    value = named(value_col)
    mean = F.try_divide(exact_sum(value, series), F.count(value).over(series).cast("double"))
    spread = F.stddev_samp(value).over(series)
    z_score = F.col("z_score")
    varies = F.col("__spread") > 0
    return (
        trend.withColumn("__mean", mean)
        .withColumn("__spread", spread)
        .withColumn("mean_value", round2(F.col("__mean")))
        .withColumn(
            "z_score",
            F.when(
                varies, round2(F.try_divide(value - F.col("__mean"), F.col("__spread")))
            ).otherwise(F.lit(0.0)),
        )
        .withColumn(
            "is_anomaly",
            F.coalesce(varies, F.lit(False))
            & F.coalesce(F.abs(z_score) >= threshold, F.lit(False)),
        )
        .withColumn(
            "anomaly_direction",
            F.when(varies & (z_score >= threshold), "unusually high")
            .when(varies & (z_score <= -threshold), "unusually low")
            .otherwise("normal"),
        )
        .drop("__mean", "__spread")
    )


def anomaly_count(anomalies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return anomalies.groupBy(*[named(key) for key in by]).agg(
        F.count_if("is_anomaly").alias("anomalies")
    )
