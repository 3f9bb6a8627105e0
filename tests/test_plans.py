"""Physical plans: what reaches the scan, what is shuffled, and that no Python runs."""

import re

import pytest

from tallyframe import AOV, ORDERS, REVENUE
from tallyframe.functions.dates import filter_periods
from tallyframe.operators import (
    drivers_all_segments,
    kpi_trend,
    list_periods,
    monthly_kpi,
    segment_drivers,
    tag_questions,
)
from tallyframe.sources.star import ORDERS_SETTINGS, SALES_SETTINGS, load, sales
from tallyframe.workload.queries import ALL_QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def read_columns(plan):
    return [
        {field.split(":")[0] for field in re.findall(r"\w+:\w+", schema)}
        for schema in re.findall(r"ReadSchema: struct<(.*)>", plan)
    ]


@pytest.mark.parametrize("kind", [None, "date", "timestamp"])
def test_period_bounds_reach_the_scan(spark, capsys, kind, tmp_path):
    orders = load(spark, SF, "orders")
    if kind:
        path = str(tmp_path / "orders.parquet")
        orders.withColumn("o_orderdate", orders.o_orderdate.cast(kind)).write.parquet(path)
        orders = spark.read.parquet(path)
    drivers = segment_drivers(orders, ORDERS_SETTINGS, REVENUE, "o_orderstatus", "2001-06", "2001-07")
    plan = plan_of(drivers, capsys)
    pushed = re.search(r"PushedFilters: (.*)", plan)[1]
    for bound in ("GreaterThanOrEqual(o_orderdate,2001-06-01", "LessThan(o_orderdate,2001-08-01"):
        assert bound in pushed
    assert read_columns(plan) == [{"o_orderdate", "o_totalprice", "o_orderstatus"}]


def test_bounds_pass_the_segment_columns_and_joins(spark, capsys):
    segments = ["r_name", "p_brand"]
    table = sales(spark, SF, *segments)
    drivers = drivers_all_segments(table, SALES_SETTINGS, REVENUE, segments, "2001-06", "2001-07")
    plan = plan_of(drivers, capsys)
    assert "GreaterThanOrEqual(l_shipdate,2001-06-01" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_drivers_do_not_expand_rows(spark, capsys):
    drivers = segment_drivers(
        load(spark, SF, "orders"), ORDERS_SETTINGS, ORDERS, "o_orderstatus", "2001-06", "2001-07"
    )
    assert "Expand" not in plan_of(drivers, capsys)


def test_distinct_orders_are_shuffled_by_month_and_order(spark, capsys):
    plan = plan_of(monthly_kpi(load(spark, SF, "orders"), ORDERS_SETTINGS, AOV), capsys)
    assert "Expand" not in plan
    shuffles = re.findall(r"Arguments: hashpartitioning\((.*?)\)", plan)
    assert any("o_orderkey" in shuffle for shuffle in shuffles)


def test_only_needed_columns_are_read(spark, capsys):
    orders = load(spark, SF, "orders")
    assert read_columns(plan_of(kpi_trend(orders, ORDERS_SETTINGS, ORDERS), capsys)) == [
        {"o_orderkey", "o_orderdate"}
    ]
    assert read_columns(plan_of(list_periods(orders, ORDERS_SETTINGS), capsys)) == [{"o_orderdate"}]


def test_rows_are_combined_before_every_shuffle(spark, capsys):
    plan = plan_of(monthly_kpi(load(spark, SF, "orders"), ORDERS_SETTINGS, REVENUE), capsys)
    assert len(re.findall(r"^\(\d+\) Exchange", plan, re.M)) == 1
    assert "partial_sum" in plan


def test_line_items_are_shuffled_once_for_customer_columns(spark, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(sales(spark, SF, "r_name"), capsys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_line_item = [
        keys for keys in re.findall(r"Arguments: hashpartitioning\((.*?)\)", plan) if "l_" in keys
    ]
    assert len(by_line_item) == 1 and "l_orderkey" in by_line_item[0]


def test_tagging_has_no_shuffle(spark, capsys):
    plan = plan_of(tag_questions(load(spark, SF, "documents"), "text"), capsys)
    assert "Exchange" not in plan
    assert plan.count("lower(trim(") <= 2


def test_month_filter_on_any_date(spark):
    orders = load(spark, SF, "orders")
    for period in ("9999-12", "0001-01", "2001-13", "soon"):
        assert filter_periods(orders, "o_orderdate", period).count() == 0


@pytest.mark.parametrize("name", sorted(ALL_QUERIES))
def test_no_python_and_no_cross_join_in_any_plan(spark, capsys, name):
    plan = plan_of(ALL_QUERIES[name](spark, SF), capsys)
    for operator in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct"):
        assert operator not in plan
    if name != "sql_scalar_subquery":
        assert "NestedLoopJoin" not in plan
