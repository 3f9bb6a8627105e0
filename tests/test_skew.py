"""One key, segment or row holding a third of the table."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from tallyframe import AOV, ORDERS, REVENUE, Settings
from tallyframe.operators import (
    drivers_all_segments,
    duplicate_rows,
    kpi_by_segment,
    kpi_trend,
    segment_drivers,
)
from tallyframe.sources.star import SALES_SETTINGS, sales

SETTINGS = Settings("day", "revenue", "order_id")
ROWS = 60_000


@pytest.fixture(scope="module")
def hot_table(spark):
    """A third of the rows: one order, one region, January."""
    hot = F.col("id") % 3 == 0
    table = spark.range(0, ROWS, 1, 8).select(
        F.when(hot, F.lit("2024-01-15"))
        .otherwise(F.concat(F.lit("2024-0"), F.col("id") % 2 + 1, F.lit("-10")))
        .cast("date")
        .alias("day"),
        (F.col("id") % 1000 / 4).alias("revenue"),
        F.when(hot, 7).otherwise(F.col("id") % 9000 + 100).alias("order_id"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 50)).alias("region"),
        F.when(hot, "x").otherwise(F.concat(F.lit("c"), F.col("id") % 11)).alias("channel"),
    )
    return table, table.toPandas()


def expected_kpi(frame, keys, kpi_name):
    groups = frame.groupby(keys)
    revenue, orders = groups.revenue.sum(), groups.order_id.nunique()
    return {REVENUE: revenue, ORDERS: orders, AOV: revenue / orders}[kpi_name].round(2)


@pytest.mark.parametrize("kpi_name", [REVENUE, ORDERS, AOV])
def test_trend_and_drivers(hot_table, kpi_name):
    table, frame = hot_table
    frame = frame.assign(period=pd.to_datetime(frame.day).dt.strftime("%Y-%m"))
    trend = {row[0]: row[2] for row in rows_of(kpi_trend(table, SETTINGS, kpi_name))}
    assert trend == pytest.approx(expected_kpi(frame, ["period"], kpi_name).to_dict(), abs=0.011)
    values = expected_kpi(frame, ["region", "period"], kpi_name).to_dict()
    for row in segment_drivers(table, SETTINGS, kpi_name, "region").collect():
        assert row.previous_value == pytest.approx(values.get((row.segment, "2024-01"), 0), abs=0.011)
        assert row.current_value == pytest.approx(values.get((row.segment, "2024-02"), 0), abs=0.011)
    both = drivers_all_segments(table, SETTINGS, kpi_name, ["region", "channel"])
    assert both.count() == frame.region.nunique() + frame.channel.nunique()


def test_many_copies_of_one_row(spark, hot_table):
    table, frame = hot_table
    flat = table.select("day", "order_id", "region")
    assert duplicate_rows(flat) == int(frame[["day", "order_id", "region"]].duplicated().sum())


@pytest.fixture
def small_skew_limits(spark):
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    for name, value in limits.items():
        spark.conf.set(name, value)
    yield
    for name in limits:
        spark.conf.unset(name)


def test_hot_order_is_split_in_joins(spark, small_skew_limits, tmp_path):
    """Line items of which a third belong to one order: the join splits that order."""
    hot = F.col("id") % 3 == 0
    lineitem = spark.range(0, ROWS, 1, 8).select(
        F.when(hot, 5).otherwise(F.col("id") % 9000).alias("l_orderkey"),
        (F.col("id") % 20).alias("l_partkey"),
        F.lit(1).cast("bigint").alias("l_suppkey"),
        F.lit(1).alias("l_linenumber"),
        F.lit(1.0).alias("l_quantity"),
        (F.col("id") % 500).cast("double").alias("l_extendedprice"),
        F.lit(0.5).alias("l_discount"),
        F.lit(0.0).alias("l_tax"),
        F.lit("N").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"),
        F.lit("2024-01-10").cast("timestamp_ntz").alias("l_shipdate"),
    )
    orders = spark.range(9000).select(
        F.col("id").alias("o_orderkey"),
        (F.col("id") % 300).alias("o_custkey"),
        F.lit("F").alias("o_orderstatus"),
        F.lit(1.0).alias("o_totalprice"),
        F.lit("2024-01-10").cast("timestamp_ntz").alias("o_orderdate"),
        F.lit("5-LOW").alias("o_orderpriority"),
    )
    customer = spark.range(300).select(
        F.col("id").alias("c_custkey"),
        F.lit("name").alias("c_name"),
        (F.col("id") % 5).cast("int").alias("c_nationkey"),
        F.lit(0.0).alias("c_acctbal"),
        F.concat(F.lit("m"), F.col("id") % 4).alias("c_mktsegment"),
    )
    for name, table in {"lineitem": lineitem, "orders": orders, "customer": customer}.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")

    found = kpi_by_segment(
        sales(spark, str(tmp_path), "c_mktsegment"), SALES_SETTINGS, AOV, "c_mktsegment"
    )
    values = dict(rows_of(found))
    frame = lineitem.toPandas().merge(orders.toPandas(), left_on="l_orderkey", right_on="o_orderkey")
    frame = frame.merge(customer.toPandas(), left_on="o_custkey", right_on="c_custkey")
    groups = frame.groupby("c_mktsegment")
    expected = (groups.l_extendedprice.sum() / 2 / groups.l_orderkey.nunique()).round(2)
    assert values == pytest.approx(expected.to_dict(), abs=0.011)
    assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
