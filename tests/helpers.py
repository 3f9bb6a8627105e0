"""Small tables for the tests."""

from __future__ import annotations

from datetime import date

from tallyframe import Settings

SETTINGS = Settings("day", "revenue", "order_id")
SCHEMA = "day date, revenue double, order_id string, region string"


def sales_table(spark, rows):
    """Rows (yyyy-mm-dd text, revenue, order id, region)."""
    typed = [
        (date.fromisoformat(day) if day else None, revenue, order, region)
        for day, revenue, order, region in rows
    ]
    return spark.createDataFrame(typed, SCHEMA)


def monthly_table(spark, values, start=(2024, 1), gaps=()):
    """A trend with one value per month from ``start``, skipping month numbers in ``gaps``."""
    rows, month = [], 0
    year, first = start
    for value in values:
        while month in gaps:
            month += 1
        total = year * 12 + first - 1 + month
        rows.append((f"{total // 12:04d}-{total % 12 + 1:02d}", "Revenue", float(value)))
        month += 1
    return spark.createDataFrame(rows, "period string, kpi_name string, kpi_value double")


def rows_of(df):
    return [tuple(row) for row in df.collect()]


def dicts_of(df):
    return [row.asDict(recursive=True) for row in df.collect()]


