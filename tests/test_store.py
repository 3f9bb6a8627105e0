"""Stored tables by month, trends kept and refreshed, mergeable states."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from helpers import SETTINGS, dicts_of, rows_of, sales_table
from tallyframe import AOV, ORDERS, REVENUE, Settings
from tallyframe.functions.dates import STORED_MONTH, filter_periods
from tallyframe.operators import (
    compare_periods,
    estimate_error,
    kpi_state,
    list_periods,
    monthly_kpi,
    monthly_kpis,
    profile_columns,
    profile_dataset,
    read_trend,
    refresh_trend,
    roll_up,
    segment_drivers,
    write_trend,
)
from tallyframe.settings import KPI_NAMES
from tallyframe.sources import preview, read_store, replace_months, write_store
from tallyframe.sources.star import TEXT_SETTINGS, text_orders

SF = "/root/testdata/sf0.001"
ROWS = [
    ("2024-01-05", 10.0, "a", "N"), ("2024-01-06", 20.0, "b", "S"), ("2024-02-01", 5.0, "c", "S"),
    ("2024-03-09", 7.0, "c", "N"), ("2024-03-31", 1.5, "d", None), (None, 100.0, "e", "N"),
]


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "store")
    write_store(text_orders(spark, SF), TEXT_SETTINGS, path, ["channel"])
    return path


def test_months_prune_folders_and_reach_the_files(spark, stored, capsys):
    table = read_store(spark, stored)
    drivers = segment_drivers(table, TEXT_SETTINGS, REVENUE, "channel", "2001-05", "2001-06")
    rows = filter_periods(table, TEXT_SETTINGS.date_col, "2001-05", "2001-06")
    compared = compare_periods(monthly_kpi(rows, TEXT_SETTINGS, REVENUE), "2001-05", "2001-06")
    for df in (drivers, compared):
        plan = plan_of(df, capsys)
        assert f"PartitionFilters: [isnotnull({STORED_MONTH}" in plan and "2001-05-01" in plan.split("PartitionFilters")[1]
        assert "GreaterThanOrEqual(order_date,2001-05-01" in plan
    text = text_orders(spark, SF)
    assert rows_of(drivers) == rows_of(segment_drivers(text, TEXT_SETTINGS, REVENUE, "channel", "2001-05", "2001-06"))


def test_the_store_holds_the_table_typed(spark, stored):
    table = read_store(spark, stored)
    assert dict(table.dtypes)["order_date"] == "timestamp_ntz"
    text = text_orders(spark, SF)
    assert table.count() == text.count() and table.filter(F.col(STORED_MONTH).isNull()).count() == text.filter("order_date = 'unknown'").count()
    profile = profile_dataset(table).first()
    assert profile["columns"] == len(text.columns) and profile["duplicate_rows"] == profile_dataset(text).first()["duplicate_rows"]
    assert [row["column_name"] for row in dicts_of(profile_columns(table))] == text.columns == preview(table).columns
    assert rows_of(list_periods(table, TEXT_SETTINGS)) == rows_of(list_periods(text, TEXT_SETTINGS))


def test_a_hot_month_is_written_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "hot")
    rows = spark.range(0, 40_000, 1, 8).selectExpr(
        "date'2024-01-15' AS day", "1.0D AS revenue", "cast(id as string) AS order_id", "'x' AS region"
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_store(rows, SETTINGS, path, ["region"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = [f for f in os.listdir(f"{path}/{STORED_MONTH}=2024-01-01") if f.endswith(".parquet")]
    assert len(files) >= 4


def spoil(path, keep):
    """Make the files of all folders but one unreadable."""
    for folder in os.listdir(path):
        if "=" in folder and keep not in folder:
            for name in os.listdir(f"{path}/{folder}"):
                if name.endswith(".parquet"):
                    with open(f"{path}/{folder}/{name}", "wb") as file:
                        file.write(b"not parquet")
                    crc = f"{path}/{folder}/.{name}.crc"
                    if os.path.exists(crc):
                        os.remove(crc)


def test_a_refresh_reads_and_writes_its_month_only(spark, tmp_path):
    store, kept = str(tmp_path / "store"), str(tmp_path / "trend")
    table = sales_table(spark, ROWS)
    early = table.filter("day < '2024-03-10' OR day IS NULL")
    write_store(early, SETTINGS, store, ["region"])
    write_trend(read_store(spark, store), SETTINGS, kept, by=["region"])
    replace_months(table, SETTINGS, store, ["2024-03"], ["region"])
    full = sorted(map(str, rows_of(monthly_kpis(table, SETTINGS, KPI_NAMES, ["region"]))))
    assert sorted(map(str, rows_of(monthly_kpis(read_store(spark, store), SETTINGS, KPI_NAMES, ["region"])))) == full
    shutil.copytree(store, str(tmp_path / "spoilt"))
    spoil(str(tmp_path / "spoilt"), "2024-03")
    schema = read_store(spark, store).schema
    march = spark.read.schema(schema).parquet(str(tmp_path / "spoilt"))
    files = {f: os.path.getmtime(f"{kept}/period=2024-01/{f}") for f in os.listdir(f"{kept}/period=2024-01")}
    refresh_trend(march, SETTINGS, kept, ["2024-03"], by=["region"])
    assert files == {f: os.path.getmtime(f"{kept}/period=2024-01/{f}") for f in os.listdir(f"{kept}/period=2024-01")}
    assert sorted(map(str, rows_of(read_trend(spark, kept, by=["region"])))) == full


def test_a_month_that_lost_its_rows(spark, tmp_path):
    kept = str(tmp_path / "trend")
    table = sales_table(spark, ROWS)
    write_trend(table, SETTINGS, kept, [REVENUE, ORDERS])
    left = table.filter("day <> '2024-02-01'")
    refresh_trend(left, SETTINGS, kept, ["2024-02", "2024-02", "soon"], [REVENUE, ORDERS])
    found = read_trend(spark, kept, [ORDERS])
    assert found.columns == ["period", "kpi_name", "kpi_value"]
    assert sorted(rows_of(found)) == [("2024-01", ORDERS, 2.0), ("2024-03", ORDERS, 2.0)]


@pytest.mark.parametrize("order_col", ["order_id", None])
def test_several_kpis_equal_single_ones(spark, capsys, order_col):
    settings = Settings("day", "revenue", order_col)
    table = sales_table(spark, ROWS)
    together = monthly_kpis(table, settings, KPI_NAMES, ["region"])
    single = [tuple(row) for name in KPI_NAMES for row in monthly_kpi(table, settings, name, ["region"]).collect()]
    assert sorted(map(str, rows_of(together))) == sorted(map(str, single))
    with pytest.raises(ValueError):
        monthly_kpis(table, Settings("day"), KPI_NAMES)


def test_several_kpis_take_one_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "table")
    sales_table(spark, ROWS).write.parquet(path)
    plan = plan_of(monthly_kpis(spark.read.parquet(path), SETTINGS, KPI_NAMES), capsys)
    assert "Expand" not in plan and plan.count("Scan parquet") == 2  # in the tree and in its details


def test_rolled_up_states(spark):
    random.seed(8)
    rows = [(f"2024-{random.randint(1, 6):02d}-11", random.randint(1, 400) / 4, f"o{random.randrange(9000)}", random.choice("NESW")) for _ in range(30_000)]
    table = sales_table(spark, rows).withColumn("shop", F.col("revenue") % 3)
    state = kpi_state(table, SETTINGS, ["region", "shop"])
    for by, periods in (([], None), (["region"], None), (["shop"], ["2024-02", "2024-03"])):
        months = table if periods is None else filter_periods(table, "day", *periods)
        exact = {tuple(row[:-2]): row[-2:] for row in months.groupBy(*by).agg(F.sum("revenue"), F.count_distinct("order_id")).collect()}
        for row in roll_up(state, by, periods).collect():
            revenue, orders = exact[tuple(row[name] for name in by)]
            assert row[REVENUE] == pytest.approx(revenue, abs=0.01)
            assert abs(row[ORDERS] - orders) <= 3 * estimate_error() * orders
            assert row[AOV] == pytest.approx(row[REVENUE] / row[ORDERS], abs=0.01)
    monthly = roll_up(state, monthly=True)
    assert monthly.columns[0] == "period" and monthly.count() == 6


def test_states_of_nothing(spark):
    empty = sales_table(spark, []).withColumn("shop", F.lit(1))
    assert rows_of(roll_up(kpi_state(empty, SETTINGS), monthly=True)) == []
    assert rows_of(roll_up(kpi_state(empty, SETTINGS))) == [(0.0, 0.0, 0.0)]
    nulls = sales_table(spark, [("2024-01-05", None, None, "N")])
    assert rows_of(roll_up(kpi_state(nulls, SETTINGS))) == [(0.0, 0.0, 0.0)]
    counted = roll_up(kpi_state(sales_table(spark, ROWS), Settings("day", "revenue")))
    assert dicts_of(counted)[0][ORDERS] == 5.0
