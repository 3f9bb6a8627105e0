"""Segment drivers."""

import random

from pyspark.sql import functions as F

from helpers import SETTINGS, dicts_of, rows_of, sales_table
from tallyframe import AOV, ORDERS, REVENUE
from tallyframe.operators import (
    compare_series,
    driver_extremes,
    drivers_all_segments,
    latest_change,
    monthly_kpi,
    segment_drivers,
)
from tallyframe.operators.compare import FIRST_VS_LATEST
from tallyframe.sources.star import ORDERS_SETTINGS, SALES_SETTINGS, load, sales

SF = "/root/testdata/sf0.01"
ROWS = [
    ("2024-01-05", 10.0, "a", "N"),
    ("2024-01-06", 20.0, "b", "S"),
    ("2024-01-07", 1.0, "c", None),
    ("2024-02-01", 5.0, "d", "S"),
    ("2024-02-02", 5.0, "e", "E"),
    ("2024-02-29", 5.0, "e", "E"),
]


def test_driver_rows(spark):
    drivers = segment_drivers(sales_table(spark, ROWS), SETTINGS, REVENUE, "region")
    assert drivers.columns == [
        "segment_column",
        "segment",
        "previous_period",
        "current_period",
        "previous_value",
        "current_value",
        "absolute_change",
        "percent_change",
    ]
    assert rows_of(drivers) == [
        ("region", "S", "2024-01", "2024-02", 20.0, 5.0, -15.0, -75.0),
        ("region", "N", "2024-01", "2024-02", 10.0, 0.0, -10.0, -100.0),
        ("region", "E", "2024-01", "2024-02", 0.0, 10.0, 10.0, None),
    ]


def test_other_kpis(spark):
    table = sales_table(spark, ROWS)
    orders = {row["segment"]: row for row in dicts_of(segment_drivers(table, SETTINGS, ORDERS, "region"))}
    assert (orders["E"]["previous_value"], orders["E"]["current_value"]) == (0.0, 1.0)
    values = {row["segment"]: row for row in dicts_of(segment_drivers(table, SETTINGS, AOV, "region"))}
    assert values["E"]["current_value"] == 10.0


def test_named_period_that_is_absent_counts_zero(spark):
    table = sales_table(spark, ROWS)
    one_side = dicts_of(segment_drivers(table, SETTINGS, REVENUE, "region", "2023-12", "2024-01"))
    assert [(row["segment"], row["previous_value"]) for row in one_side] == [("N", 0.0), ("S", 0.0)]
    assert rows_of(segment_drivers(table, SETTINGS, REVENUE, "region", "2020-01", "2020-02")) == []
    assert rows_of(segment_drivers(table, SETTINGS, REVENUE, "region", "soon", "2020-02")) == []


def test_single_period_is_empty_and_typed(spark):
    table = sales_table(spark, ROWS[:3])
    for periods in ((), ("2024-01", "2024-02")):
        drivers = segment_drivers(table, SETTINGS, REVENUE, "region", *periods)
        assert rows_of(drivers) == []
        assert dict(drivers.dtypes)["absolute_change"] == "double"


def test_ties_are_ordered_by_segment(spark):
    rows = [
        (day, value, f"{region}{day}", region)
        for region in ("B", "A", "C")
        for day, value in (("2024-01-01", 1.0), ("2024-02-01", 2.0))
    ]
    drivers = segment_drivers(sales_table(spark, rows), SETTINGS, REVENUE, "region")
    assert [row["segment"] for row in dicts_of(drivers)] == ["A", "B", "C"]
    assert dicts_of(driver_extremes(drivers)) == [
        {
            "segment_column": "region",
            "biggest_negative_driver": "A",
            "biggest_negative_change": 1.0,
            "biggest_positive_driver": "C",
            "biggest_positive_change": 1.0,
        }
    ]


def test_all_segments_equal_single_ones(spark):
    orders = load(spark, SF, "orders")
    segments = ["o_orderpriority", "o_orderstatus"]
    together = drivers_all_segments(orders, ORDERS_SETTINGS, AOV, segments)
    single = [
        row
        for segment in segments
        for row in rows_of(segment_drivers(orders, ORDERS_SETTINGS, AOV, segment))
    ]
    assert rows_of(together) == single


def test_drivers_per_series(spark):
    rows = ROWS + [("2024-01-01", 3.0, "q", "E")]
    table = sales_table(spark, rows).withColumn("shop", F.lit("one"))
    table = table.unionByName(table.withColumn("shop", F.lit("two")).filter("region = 'S'"))
    drivers = segment_drivers(table, SETTINGS, REVENUE, "region", by=["shop"])
    found = [(row["shop"], row["segment"], row["absolute_change"]) for row in dicts_of(drivers)]
    assert found == [("one", "S", -15.0), ("one", "N", -10.0), ("one", "E", 7.0), ("two", "S", -15.0)]


ENDED = [
    ("2024-01-05", 4.0, "a", "N"),
    ("2024-02-05", 9.0, "b", "N"),
    ("2024-02-06", 2.0, "c", "S"),
    ("2024-03-01", 1.0, "d", "S"),
    ("2024-05-01", 6.0, "e", "N"),
    ("2024-05-02", 7.0, "f", "E"),
]


def ended_series(spark):
    """Series one ends in February, two skips April, a null key has two months, four only one."""
    table = sales_table(spark, ENDED).withColumn("k", F.lit("y"))
    parts = [
        table.filter("day < '2024-03-01'").withColumn("shop", F.lit("one")),
        table.filter("day >= '2024-03-01'").withColumn("shop", F.lit("two")),
        table.filter("day < '2024-03-01'").withColumn("shop", F.lit(None).cast("string")),
        table.filter("day = '2024-05-01'").withColumn("shop", F.lit("four")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def test_series_compare_their_own_months(spark):
    table = ended_series(spark)
    drivers = segment_drivers(table, SETTINGS, REVENUE, "region", by=["shop", "k"])
    found = [
        (row["shop"], row["segment"], row["previous_period"], row["current_period"], row["absolute_change"])
        for row in dicts_of(drivers)
    ]
    first = [("S", "2024-01", "2024-02", 2.0), ("N", "2024-01", "2024-02", 5.0)]
    second = [("S", "2024-03", "2024-05", -1.0), ("N", "2024-03", "2024-05", 6.0), ("E", "2024-03", "2024-05", 7.0)]
    assert found == [(None, *row) for row in first] + [("one", *row) for row in first] + [("two", *row) for row in second]
    trend = monthly_kpi(table, SETTINGS, REVENUE, ["shop", "k"])
    compared = {row["shop"]: row for row in dicts_of(compare_series(trend, ["shop", "k"]))}
    for row in dicts_of(latest_change(trend, ["shop", "k"])):
        assert {name: compared[row["shop"]][name] for name in row} == row
    assert compared["four"]["previous_period"] is None


def test_each_series_equals_a_table_of_its_own(spark):
    table = ended_series(spark)
    segments = ["region", "k"]
    together = drivers_all_segments(table, SETTINGS, AOV, segments, by=["shop"])
    for shop in ("one", "two", "four", None):
        same = F.col("shop").eqNullSafe(F.lit(shop))
        alone = drivers_all_segments(table.filter(same), SETTINGS, AOV, segments)
        assert rows_of(together.filter(same).drop("shop")) == rows_of(alone)


def test_one_named_month_and_the_latest_of_each_series(spark):
    table = ended_series(spark)
    drivers = segment_drivers(table, SETTINGS, REVENUE, "region", previous="2024-01", by=["shop"])
    assert {(row["shop"], row["previous_period"], row["current_period"]) for row in dicts_of(drivers)} == {
        (None, "2024-01", "2024-02"),
        ("one", "2024-01", "2024-02"),
        ("two", "2024-01", "2024-05"),
    }
    trend = monthly_kpi(table, SETTINGS, REVENUE, ["shop"])
    first = {row["shop"]: row for row in dicts_of(compare_series(trend, ["shop"], FIRST_VS_LATEST))}
    assert (first["two"]["previous_period"], first["two"]["current_period"]) == ("2024-03", "2024-05")
    assert rows_of(segment_drivers(table, SETTINGS, REVENUE, "region", previous="soon", current=None, by=["shop"])) != []


def test_only_the_months_that_a_series_compares_are_read(spark, tmp_path, capsys):
    path = str(tmp_path / "orders.parquet")
    ended_series(spark).write.parquet(path)
    capsys.readouterr()
    segment_drivers(spark.read.parquet(path), SETTINGS, REVENUE, "region", by=["shop"]).explain("formatted")
    plan = capsys.readouterr().out
    for bound in ("GreaterThanOrEqual(day,2024-01-01)", "LessThan(day,2024-04-01)", "GreaterThanOrEqual(day,2024-05-01)"):
        assert bound in plan


def test_changes_add_up_to_the_total(spark):
    random.seed(5)
    rows = [
        (f"2024-0{random.randint(1, 2)}-1{random.randint(0, 9)}", random.randint(1, 99) / 4, str(n), random.choice("NESW"))
        for n in range(300)
    ]
    table = sales_table(spark, rows)
    total = latest_change(monthly_kpi(table, SETTINGS, REVENUE)).first().absolute_change
    parts = segment_drivers(table, SETTINGS, REVENUE, "region").agg(F.sum("absolute_change")).first()[0]
    assert abs(total - parts) < 0.05


def test_golden_drivers(spark):
    orders = load(spark, SF, "orders")
    drivers = segment_drivers(orders, ORDERS_SETTINGS, REVENUE, "o_orderpriority", "2001-06", "2001-07")
    found = [(row[1], row[4], row[5], row[6], row[7]) for row in rows_of(drivers)]
    assert found[0] == ("5-LOW", 8471134.73, 6228415.46, -2242719.27, -26.47)
    assert found[-1] == ("2-HIGH", 7629634.01, 11294893.89, 3665259.88, 48.04)
    counted = segment_drivers(sales(spark, SF, "r_name"), SALES_SETTINGS, ORDERS, "r_name", "2001-06", "2001-07")
    found = {row["segment"]: (row["previous_value"], row["current_value"]) for row in dicts_of(counted)}
    assert found["AFRICA"] == (143.0, 153.0)
    assert found["MIDDLE EAST"] == (150.0, 138.0)
