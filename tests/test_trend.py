"""KPI values, trends and changes."""

from dataclasses import replace

import pandas as pd
import pytest

from helpers import SETTINGS, dicts_of, monthly_table, rows_of, sales_table
from tallyframe import AOV, ORDERS, REVENUE, Settings
from tallyframe.operators import (
    compare_periods,
    comparison_periods,
    kpi_trend,
    latest_change,
    list_periods,
    monthly_kpi,
    period_changes,
)
from tallyframe.sources.star import EVENTS_SETTINGS, ORDERS_SETTINGS, load

SF = "/root/testdata/sf0.01"
ROWS = [
    ("2024-01-05", 10.0, "a", "N"),
    ("2024-01-06", 20.0, "a", "S"),
    ("2024-01-31", None, None, "N"),
    ("2024-03-01", 7.5, "b", None),
    ("2024-03-02", 2.5, "c", "S"),
    (None, 99.0, "z", "N"),
]


def test_trend_values(spark):
    table = sales_table(spark, ROWS)
    assert rows_of(kpi_trend(table, SETTINGS, REVENUE)) == [
        ("2024-01", REVENUE, 30.0),
        ("2024-03", REVENUE, 10.0),
    ]
    # Repeated ids count once, missing ids not at all.
    assert rows_of(kpi_trend(table, SETTINGS, ORDERS)) == [
        ("2024-01", ORDERS, 1.0),
        ("2024-03", ORDERS, 2.0),
    ]
    assert [row[2] for row in rows_of(kpi_trend(table, SETTINGS, AOV))] == [30.0, 5.0]


def test_orders_without_order_column_counts_rows(spark):
    trend = kpi_trend(sales_table(spark, ROWS), Settings("day", "revenue"), ORDERS)
    assert [row[2] for row in rows_of(trend)] == [3.0, 2.0]


def test_approximate_orders(spark):
    exact = kpi_trend(load(spark, SF, "orders"), ORDERS_SETTINGS, ORDERS)
    settings = replace(ORDERS_SETTINGS, approximate_orders=True)
    estimated = kpi_trend(load(spark, SF, "orders"), settings, ORDERS)
    for one, other in zip(rows_of(exact), rows_of(estimated), strict=True):
        assert one[0] == other[0] and abs(one[2] - other[2]) <= 0.25 * one[2]


def test_all_order_ids_missing(spark):
    table = sales_table(spark, [("2024-01-01", 5.0, None, "N")])
    assert rows_of(kpi_trend(table, SETTINGS, AOV)) == [("2024-01", AOV, 0.0)]
    table = sales_table(spark, [("2024-01-01", None, "a", "N")])
    assert rows_of(kpi_trend(table, SETTINGS, REVENUE)) == [("2024-01", REVENUE, 0.0)]


def test_nan_is_missing(spark):
    table = sales_table(spark, [("2024-01-01", float("nan"), "a", "N"), ("2024-01-02", 1.0, "b", "N")])
    assert rows_of(kpi_trend(table, SETTINGS, REVENUE)) == [("2024-01", REVENUE, 1.0)]


def test_empty_input_is_typed(spark):
    trend = kpi_trend(sales_table(spark, []), SETTINGS, REVENUE)
    assert trend.columns == ["period", "kpi_name", "kpi_value"]
    assert rows_of(trend) == []
    assert rows_of(kpi_trend(sales_table(spark, [(None, 1.0, "a", "N")]), SETTINGS, REVENUE)) == []


def test_wrong_arguments(spark):
    table = sales_table(spark, ROWS)
    with pytest.raises(ValueError, match="unsupported KPI"):
        kpi_trend(table, SETTINGS, "Margin")
    with pytest.raises(ValueError, match="revenue column"):
        kpi_trend(table, Settings("day"), REVENUE)
    with pytest.raises(ValueError, match="revenue column"):
        kpi_trend(table, Settings("day", None, "order_id"), AOV)
    with pytest.raises(ValueError, match="no column"):
        kpi_trend(table, Settings("nowhere", "revenue"), REVENUE)
    with pytest.raises(ValueError, match="not a date"):
        kpi_trend(table, Settings("revenue", "revenue"), REVENUE)


def test_timestamps_with_and_without_zone(spark):
    table = sales_table(spark, ROWS)
    expected = rows_of(kpi_trend(table, SETTINGS, REVENUE))
    for kind in ("timestamp", "timestamp_ntz"):
        typed = table.withColumn("day", table.day.cast(kind))
        assert rows_of(kpi_trend(typed, SETTINGS, REVENUE)) == expected


def test_list_periods(spark):
    assert rows_of(list_periods(sales_table(spark, ROWS), SETTINGS)) == [("2024-01",), ("2024-03",)]


def test_latest_change_uses_previous_present_month(spark):
    trend = monthly_table(spark, [100, 50, 80], gaps=(1, 2))
    assert dicts_of(latest_change(trend)) == [
        {
            "current_period": "2024-05",
            "previous_period": "2024-04",
            "current_value": 80.0,
            "previous_value": 50.0,
            "absolute_change": 30.0,
            "percent_change": 60.0,
        }
    ]
    second = dicts_of(period_changes(trend))[1]
    assert (second["previous_period"], second["current_period"]) == ("2024-01", "2024-04")


@pytest.mark.parametrize("values", [[], [5]])
def test_latest_change_needs_two_months(spark, values):
    change = dicts_of(latest_change(monthly_table(spark, values)))
    assert len(change) == 1
    assert set(change[0].values()) == {None}


def test_previous_value_zero_has_no_percentage(spark):
    change = dicts_of(latest_change(monthly_table(spark, [0, 5])))[0]
    assert (change["absolute_change"], change["percent_change"]) == (5.0, None)


def test_latest_change_per_series(spark):
    rows = [
        ("2024-01-01", 1.0, "a", "N"),
        ("2024-02-01", 3.0, "b", "N"),
        ("2024-02-01", 9.0, "c", "S"),
    ]
    trend = monthly_kpi(sales_table(spark, rows), SETTINGS, REVENUE, ["region"])
    found = {row["region"]: row for row in dicts_of(latest_change(trend, ["region"]))}
    assert found["N"]["absolute_change"] == 2.0
    assert found["S"]["current_period"] is None


def test_compare_periods(spark):
    trend = monthly_table(spark, [10, 20, 20])
    assert dicts_of(compare_periods(trend, "2024-02", "2024-03"))[0]["direction"] == "stayed flat"
    assert dicts_of(compare_periods(trend, "2024-02", "2024-01"))[0] == {
        "previous_period": "2024-02",
        "current_period": "2024-01",
        "previous_value": 20.0,
        "current_value": 10.0,
        "absolute_change": -10.0,
        "percent_change": -50.0,
        "direction": "decreased",
    }
    with pytest.raises(Exception, match="2030-01 is not in the trend"):
        compare_periods(trend, "2024-01", "2030-01").collect()
    with pytest.raises(Exception, match="2030-01 is not in the trend"):
        compare_periods(trend, "2024-01", "2030-01").count()


def test_comparison_modes():
    periods = ["2024-01", "2024-02", "2024-05"]
    assert comparison_periods(periods) == ("2024-02", "2024-05")
    assert comparison_periods(periods, "First vs latest") == ("2024-01", "2024-05")
    assert comparison_periods(periods, "Custom", "2024-01", "2024-02") == ("2024-01", "2024-02")
    assert comparison_periods(periods, "Custom", previous="2024-01") == ("2024-01", "2024-05")
    with pytest.raises(ValueError, match="two periods"):
        comparison_periods(["2024-01"])
    with pytest.raises(ValueError, match="unknown"):
        comparison_periods(periods, "Random")


GOLDEN = {
    REVENUE: (48593367.15, 53657147.71, 702947.99, -52954199.72, -98.69),
    ORDERS: (182.0, 207.0, 2.0, -205.0, -99.03),
    AOV: (266996.52, 259213.27, 351474.00, 92260.73, 35.59),
}


@pytest.mark.parametrize("kpi_name", GOLDEN)
def test_golden_orders(spark, kpi_name):
    trend = monthly_kpi(load(spark, SF, "orders"), ORDERS_SETTINGS, kpi_name)
    values = {row.period: row.kpi_value for row in trend.collect()}
    change = latest_change(trend).first()
    assert len(values) == 80
    assert GOLDEN[kpi_name] == (
        values["1995-01"],
        change.previous_value,
        change.current_value,
        change.absolute_change,
        change.percent_change,
    )


def test_golden_events(spark):
    trend = kpi_trend(load(spark, SF, "events"), EVENTS_SETTINGS, REVENUE)
    assert rows_of(trend) == [("2024-01", REVENUE, 496306.57)]


def test_trend_equals_pandas(spark):
    orders = pd.read_parquet(f"{SF}/orders.parquet")
    month = orders.o_orderdate.dt.strftime("%Y-%m")
    grouped = orders.groupby([orders.o_orderpriority, month])
    expected = (grouped.o_totalprice.sum() / grouped.o_orderkey.nunique()).round(2)
    trend = kpi_trend(load(spark, SF, "orders"), ORDERS_SETTINGS, AOV, ["o_orderpriority"])
    found = {(row[0], row[1]): row[3] for row in rows_of(trend)}
    assert found.keys() == set(expected.index)
    assert all(abs(found[key] - expected[key]) < 0.011 for key in found)
