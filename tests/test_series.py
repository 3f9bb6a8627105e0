"""Anomalies and forecast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import dicts_of, monthly_table, rows_of
from tallyframe import AOV, ORDERS, REVENUE
from tallyframe.operators import (
    anomaly_count,
    detect_anomalies,
    forecast_kpi,
    linear_fit,
    monthly_kpi,
)
from tallyframe.sources.star import ORDERS_SETTINGS, load

SF = "/root/testdata/sf0.01"
VALUES = [100, 101, 99, 100, 102, 98, 100, 160]


def test_anomaly_table(spark):
    found = detect_anomalies(monthly_table(spark, VALUES))
    assert found.columns == [
        "period",
        "kpi_name",
        "kpi_value",
        "mean_value",
        "z_score",
        "is_anomaly",
        "anomaly_direction",
    ]
    mean, spread = np.mean(VALUES), np.std(VALUES, ddof=1)
    rows = sorted(dicts_of(found), key=lambda row: row["period"])
    assert [row["z_score"] for row in rows] == [round((v - mean) / spread, 2) for v in VALUES]
    assert [row["anomaly_direction"] for row in rows] == ["normal"] * 7 + ["unusually high"]
    assert rows_of(anomaly_count(found)) == [(1,)]


@pytest.mark.parametrize("values", [[7], [5, 5, 5]])
def test_constant_series_has_no_anomaly(spark, values):
    for threshold in (1.5, 0.0):
        for row in dicts_of(detect_anomalies(monthly_table(spark, values), threshold)):
            assert (row["z_score"], row["is_anomaly"], row["anomaly_direction"]) == (
                0.0,
                False,
                "normal",
            )


def test_flag_tests_the_rounded_score(spark):
    rows = dicts_of(detect_anomalies(monthly_table(spark, VALUES)))
    score = max(row["z_score"] for row in rows)
    assert anomaly_count(detect_anomalies(monthly_table(spark, VALUES), score)).first()[0] == 1


def test_empty_trend_and_missing_column(spark):
    assert rows_of(detect_anomalies(monthly_table(spark, []))) == []
    found = detect_anomalies(monthly_table(spark, VALUES), value_col="margin")
    assert rows_of(found) == []
    assert "z_score" in found.columns


def test_flags_do_not_depend_on_the_unit(spark):
    trend = monthly_table(spark, VALUES)
    scaled = trend.withColumn("kpi_value", F.col("kpi_value") * 1000)
    flags = [row["is_anomaly"] for row in dicts_of(detect_anomalies(trend))]
    assert flags == [row["is_anomaly"] for row in dicts_of(detect_anomalies(scaled))]


def test_series_are_separate(spark):
    one = monthly_table(spark, VALUES).withColumn("shop", F.lit("a"))
    two = monthly_table(spark, [5, 5]).withColumn("shop", F.lit("b"))
    both = one.unionByName(two)
    counts = dict(rows_of(anomaly_count(detect_anomalies(both, by=["shop"]), by=["shop"])))
    assert counts == {"a": 1, "b": 0}
    future = rows_of(forecast_kpi(both, 1, by=["shop"]))
    assert [row[:2] for row in future] == [("a", "2024-09"), ("b", "2024-03")]


def test_exact_line_is_continued_exactly(spark):
    trend = monthly_table(spark, [10, 12, 14], start=(2024, 10))
    assert rows_of(forecast_kpi(trend)) == [
        ("2025-01", 16.0),
        ("2025-02", 18.0),
        ("2025-03", 20.0),
    ]


def test_gaps_close_up_in_the_fit(spark):
    trend = monthly_table(spark, [10, 12, 14], gaps=(1, 2))
    assert rows_of(forecast_kpi(trend, 1)) == [("2024-06", 16.0)]


@pytest.mark.parametrize("values", [[], [5]])
def test_forecast_needs_two_months(spark, values):
    forecast = forecast_kpi(monthly_table(spark, values))
    assert forecast.columns == ["period", "forecast_value"]
    assert rows_of(forecast) == []


def test_no_steps(spark):
    assert rows_of(forecast_kpi(monthly_table(spark, [1, 2]), 0)) == []


def test_fit_equals_numpy(spark):
    rng = np.random.default_rng(3)
    values = [round(float(v), 2) for v in rng.normal(1e6, 1e5, 60)]
    fit = linear_fit(monthly_table(spark, values)).first()
    slope, intercept = np.polyfit(np.arange(60), values, 1)
    assert np.isclose(fit.slope, slope, rtol=1e-9)
    assert np.isclose(fit.intercept, intercept, rtol=1e-12)


GOLDEN = {
    REVENUE: (46980495.25, {"2001-08": -6.87}, [46464233.99, 46451486.80, 46438739.61]),
    ORDERS: (187.50, {"1995-07": 1.66, "2001-08": -7.25}, [183.39, 183.29, 183.19]),
    AOV: (
        251843.34,
        {"1996-08": 1.58, "1999-02": -1.58, "2000-05": 1.61, "2001-08": 5.99},
        [258031.05, 258183.83, 258336.61],
    ),
}


@pytest.mark.parametrize("kpi_name", GOLDEN)
def test_golden(spark, kpi_name):
    mean, flagged, forecast = GOLDEN[kpi_name]
    trend = monthly_kpi(load(spark, SF, "orders"), ORDERS_SETTINGS, kpi_name)
    rows = dicts_of(detect_anomalies(trend))
    assert {row["mean_value"] for row in rows} == {mean}
    assert {row["period"]: row["z_score"] for row in rows if row["is_anomaly"]} == flagged
    assert [row[1] for row in rows_of(forecast_kpi(trend))] == forecast
