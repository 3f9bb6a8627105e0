"""Everything is rounded once, and sums do not depend on the order of their values."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import SETTINGS, dicts_of, monthly_table, rows_of, sales_table
from tallyframe import AOV, REVENUE
from tallyframe.functions.numbers import exact_sum, round2
from tallyframe.operators import detect_anomalies, forecast_kpi, monthly_kpi, segment_drivers


def total(spark, values):
    table = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    return table.agg(exact_sum(F.col("v")).alias("total")).first()[0]


def test_a_value_just_below_a_half(spark):
    row = dicts_of(spark.range(1).select(round2(F.lit(1.4949996)).alias("z")))[0]
    assert row["z"] == 1.49


def test_just_below_a_half_everywhere(spark):
    table = sales_table(spark, [("2024-01-05", 2.9899992, "a", "N"), ("2024-01-06", 0.0, "b", "N"), ("2024-02-01", 4.4849988, "c", "N"), ("2024-02-01", 0.0, "d", "N")])
    values = {row["period"]: row["kpi_value"] for row in dicts_of(monthly_kpi(table, SETTINGS, AOV))}
    assert values == {"2024-01": 1.49, "2024-02": 2.24}
    change = dicts_of(segment_drivers(table, SETTINGS, REVENUE, "region"))[0]
    assert (change["previous_value"], change["current_value"], change["absolute_change"]) == (2.99, 4.48, 1.49)
    trend = spark.createDataFrame([("2024-01", REVENUE, 1.4949996), ("2024-02", REVENUE, 1.4949996)], "period string, kpi_name string, kpi_value double")
    assert {row["mean_value"] for row in dicts_of(detect_anomalies(trend))} == {1.49}
    assert {row["forecast_value"] for row in dicts_of(forecast_kpi(trend))} == {1.49}


def test_means_and_lines_at_a_half(spark):
    assert {row["mean_value"] for row in dicts_of(detect_anomalies(monthly_table(spark, [1.0, 1.01])))} == {1.01}
    assert [row[1] for row in rows_of(forecast_kpi(monthly_table(spark, [1.0, 1.01, 1.01]), 1))] == [1.02]


def test_sums_in_any_order(spark):
    r = random.Random(6)
    values = [round(r.uniform(-5e6, 5e6), 4) for _ in range(3000)] + [0.1] * 1000 + [901.1999999999999, -0.3, 1e14 + 0.25]
    exact = float(sum(Decimal(repr(v)).quantize(Decimal("1e-9")) for v in values))
    for _ in range(3):
        r.shuffle(values)
        assert total(spark, values) == exact


def test_sums_of_odd_values(spark):
    assert total(spark, []) is None and total(spark, [None]) is None
    assert total(spark, [None, 2.5]) == 2.5 and total(spark, [-0.25]) == -0.25
    assert total(spark, [1e300, 1.0]) == 1e300 and total(spark, [float("inf"), 1.0]) == float("inf")
    assert total(spark, [9e14] * 20_000) == pytest.approx(1.8e19)
    assert total(spark, [1e-9, 2e-9]) == 3e-9


def test_sums_over_a_window(spark):
    table = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 5.0), ("c", None)], "k string, v double")
    sums = table.select("k", exact_sum(F.col("v"), Window.partitionBy("k")).alias("s")).distinct()
    assert dict(rows_of(sums)) == {"a": 0.3, "b": 5.0, "c": None}
