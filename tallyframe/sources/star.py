"""The driver tables, and flat transaction tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.dates import filter_periods
from tallyframe.settings import Settings
from tallyframe.sources.datasets import read_dataset

ORDERS_SETTINGS = Settings("o_orderdate", "o_totalprice", "o_orderkey")
SALES_SETTINGS = Settings("l_shipdate", "net_revenue", "l_orderkey")
EVENTS_SETTINGS = Settings("ts", "value", "event_id")
TEXT_SETTINGS = Settings("order_date", "amount", "order_id")

CUSTOMER_SEGMENTS = ("c_mktsegment", "n_name", "r_name")


# Columns of the driver tables; with them, no job is spent on reading footers first.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_dataset(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def customers_with_places(spark: SparkSession, sf_dir: str, segments: set[str]) -> DataFrame:
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    if not {"n_name", "r_name"} & segments:
        return customers
    places = load(spark, sf_dir, "nation")
    if "r_name" in segments:
        regions = load(spark, sf_dir, "region")
        places = places.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return customers.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")


def sales(
    spark: SparkSession, sf_dir: str, *segments: str, months: tuple[str, ...] = ()
) -> DataFrame:
    """Line items with the named segment columns; only the tables holding those are joined.

    Over all months, customer attributes are first put onto the orders, so that
    the line items, by far the largest table, are shuffled only once for them.
    With ``months`` few line items are left, and these are joined to the orders
    and then to the customers, so that most orders are never joined further.
    Small tables are broadcast by Spark's own size check, the others are
    sort-merge joins whose hot keys AQE splits.
    """
    facts = load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_shipdate",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_revenue"),
    )
    if months:
        facts = filter_periods(facts, "l_shipdate", *months)
    if set(segments) & set(CUSTOMER_SEGMENTS):
        customers = customers_with_places(spark, sf_dir, set(segments))
        buyers = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        same_order = F.col("l_orderkey") == F.col("o_orderkey")
        same_customer = F.col("o_custkey") == F.col("c_custkey")
        if months:
            facts = facts.join(buyers, same_order, "left").join(customers, same_customer, "left")
        else:
            facts = facts.join(buyers.join(customers, same_customer, "left"), same_order, "left")
    if "p_brand" in segments:
        parts = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
        facts = facts.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    return facts.select("l_orderkey", "l_shipdate", "net_revenue", *segments)


def text_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as a careless export would hold them.

    Dates are texts and unknown for one priority, one status is missing, and
    urgent orders are listed twice.
    """
    orders = load(spark, sf_dir, "orders")
    texts = orders.select(
        F.when(F.col("o_orderpriority") == "5-LOW", "unknown")
        .otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
        .alias("order_date"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("channel"),
        F.col("o_orderpriority").alias("order priority"),
    )
    return texts.unionByName(texts.filter(F.col("order priority") == "1-URGENT"))
