"""SQL over the dataset."""

from datetime import datetime

import pytest

from helpers import SETTINGS, dicts_of, rows_of, sales_table
from tallyframe import AOV, ORDERS, REVENUE, Settings
from tallyframe.operators import (
    kpi_by_segment,
    kpi_trend,
    run_sql,
    sample_queries,
    segment_drivers,
)

ROWS = [
    ("2024-01-05", 10.0, "a", "N"),
    ("2024-02-06", 20.0, "a", None),
    ("2024-02-07", 5.0, "b", "N"),
    (None, 1.0, None, "S"),
]


def test_plain_query_and_semicolon(spark):
    table = sales_table(spark, ROWS)
    assert rows_of(run_sql(table, "SELECT count(*) AS n FROM sales_data;")) == [(4,)]
    assert rows_of(run_sql(table, "  ")) == []


def test_guard(spark):
    table = sales_table(spark, ROWS)
    assert rows_of(run_sql(table, " select 1 AS x", select_only=True)) == [(1,)]
    for text in ("WITH t AS (SELECT 1) SELECT * FROM t", "DROP VIEW sales_data", ""):
        with pytest.raises(ValueError, match="SELECT"):
            run_sql(table, text, select_only=True)
    assert rows_of(run_sql(table, "WITH t AS (SELECT 1 AS x) SELECT * FROM t")) == [(1,)]


def test_errors_reach_the_caller(spark):
    with pytest.raises(Exception, match="nowhere"):
        run_sql(sales_table(spark, ROWS), "SELECT nowhere FROM sales_data")
    with pytest.raises(Exception, match="PARSE"):
        run_sql(sales_table(spark, ROWS), "SELECT 1; SELECT 2")


def test_double_quotes_and_strftime(spark):
    table = sales_table(spark, ROWS).withColumnRenamed("day", "Order Day")
    found = run_sql(
        table,
        """SELECT strftime(CAST("Order Day" AS DATE), '%Y-%m') AS month, ROUND(SUM("revenue"), 2) AS total
        FROM sales_data GROUP BY month ORDER BY month;""",
        double_quotes=True,
    )
    assert rows_of(found) == [(None, 1.0), ("2024-01", 10.0), ("2024-02", 25.0)]
    assert rows_of(run_sql(table, 'SELECT "text" AS x LIMIT 1')) == [("text",)]


def test_sample_queries_with_awkward_names(spark):
    table = sales_table(spark, ROWS).toDF("Order Day", "net `sum`", "order id", "sales.region")
    settings = Settings("Order Day", "net `sum`", "order id")
    texts = sample_queries(settings, "sales.region")
    assert list(texts) == [
        "Monthly revenue",
        "Revenue by sales.region",
        "Orders by sales.region",
        "Preview data",
    ]
    found = {name: rows_of(run_sql(table, text)) for name, text in texts.items()}
    # Rows without date or segment form groups of their own here.
    assert found["Monthly revenue"] == [(None, 1.0), ("2024-01", 10.0), ("2024-02", 25.0)]
    assert found["Revenue by sales.region"] == [(None, 20.0), ("N", 15.0), ("S", 1.0)]
    assert dict(found["Orders by sales.region"]) == {"N": 2, None: 1, "S": 0}
    assert len(found["Preview data"]) == 4


def test_awkward_names_in_operators(spark):
    table = sales_table(spark, ROWS).toDF("Order Day", "net `sum`", "order id", "sales.region")
    settings = Settings("Order Day", "net `sum`", "order id")
    assert [row[2] for row in rows_of(kpi_trend(table, settings, AOV))] == [10.0, 12.5]
    drivers = dicts_of(segment_drivers(table, settings, REVENUE, "sales.region"))
    assert [(row["segment"], row["absolute_change"]) for row in drivers] == [("N", -5.0)]


def test_bad_date_raises_in_sql(spark):
    table = spark.createDataFrame([("soon", 1.0, "a")], "day string, revenue double, order_id string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        run_sql(table, sample_queries(SETTINGS, "order_id")["Monthly revenue"]).collect()


def test_kpi_by_segment(spark):
    table = sales_table(spark, ROWS)
    assert rows_of(kpi_by_segment(table, SETTINGS, REVENUE)) == [(None, 20.0), ("N", 15.0), ("S", 1.0)]
    assert kpi_by_segment(table, SETTINGS, REVENUE).columns == ["region", "total_revenue"]
    assert dict(rows_of(kpi_by_segment(table, SETTINGS, ORDERS))) == {"N": 2, None: 1, "S": 0}
    assert dict(rows_of(kpi_by_segment(table, SETTINGS, AOV))) == {None: 20.0, "N": 7.5, "S": None}
    assert kpi_by_segment(table, Settings("day"), AOV, preview_instead=True).columns == table.columns
    with pytest.raises(ValueError, match="column roles"):
        kpi_by_segment(table, Settings("day"), AOV)


MOMENT = "TIMESTAMP_NTZ'1997-01-05 15:04:09'"


@pytest.mark.parametrize(
    "pattern", ["%y-%m", "%-m/%Y", "%Y-%m-%dT%H:%M:%S at", "%j %b %B", "%I:%M %p", "100%%", "%a %A", "%-d.%-m.%y %-H:%-M:%-S %-I", "plain 'text'", ""]
)
def test_strftime(spark, pattern):
    quoted = pattern.replace("'", "''")
    found = run_sql(spark.range(1), f"SELECT strftime({MOMENT}, '{quoted}') AS t")
    assert rows_of(found) == [(datetime(1997, 1, 5, 15, 4, 9).strftime(pattern),)]


@pytest.mark.parametrize("pattern", ["%Q", "%Y %", "%-Y"])
def test_strftime_refuses_what_it_does_not_know(spark, pattern):
    with pytest.raises(Exception, match="strftime does not know"):
        run_sql(spark.range(1), f"SELECT strftime({MOMENT}, '{pattern}') AS t").collect()
