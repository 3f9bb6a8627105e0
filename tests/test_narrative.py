"""Summaries, the investigation log and the whole investigation."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import SETTINGS, dicts_of, monthly_table, rows_of, sales_table
from tallyframe import AOV, ORDERS, REVENUE, Settings
from tallyframe.operators import compare_periods, latest_change, monthly_kpi, segment_drivers
from tallyframe.plans import Investigation, investigate, kpi_summary

ROWS = [
    ("2024-01-05", 1000.0, "a", "N"),
    ("2024-01-06", 2000.5, "b", "S"),
    ("2024-02-01", 500.0, "c", "S"),
    ("2024-02-02", 4500.0, "d", "E"),
]


def text_of(df):
    rows = rows_of(df)
    assert len(rows) == 1
    return rows[0][-1]


def test_summary_with_drivers(spark):
    table = sales_table(spark, ROWS)
    found = investigate(table, SETTINGS, REVENUE, segment_col="region")
    assert text_of(found["summary"]) == (
        "Revenue increased from $3,000.50 in 2024-01 to $5,000.00 in 2024-02. "
        "This represents a 66.64% change. "
        "By region, the biggest negative driver was S with a change of $-1,500.50. "
        "The biggest positive driver was E with a change of $4,500.00."
    )
    found = investigate(table, SETTINGS, ORDERS, segment_col="region")
    assert text_of(found["summary"]) == (
        "Orders stayed flat from 2 in 2024-01 to 2 in 2024-02. This represents a 0.00% change. "
        "By region, the biggest negative driver was N with a change of -1. "
        "The biggest positive driver was E with a change of 1."
    )


def test_summary_parts(spark):
    change = latest_change(monthly_table(spark, [0, 3]))
    assert text_of(kpi_summary(change, REVENUE)) == (
        "Revenue increased from $0.00 in 2024-01 to $3.00 in 2024-02."
    )
    short = latest_change(monthly_table(spark, [3]))
    none = "Not enough period data is available to generate a KPI summary."
    assert text_of(kpi_summary(short, AOV)) == none
    no_drivers = segment_drivers(sales_table(spark, ROWS[:1]), SETTINGS, REVENUE, "region")
    assert text_of(kpi_summary(short, REVENUE, no_drivers)) == none
    assert text_of(kpi_summary(change, REVENUE, no_drivers)).endswith("$3.00 in 2024-02.")


def test_investigation_tables(spark):
    found = investigate(sales_table(spark, ROWS), SETTINGS, AOV, segment_col="region")
    assert set(found) == {
        "profile",
        "columns",
        "trend",
        "change",
        "comparison",
        "drivers",
        "anomalies",
        "forecast",
        "summary",
        "steps",
        "report",
    }
    assert [row["period"] for row in dicts_of(found["trend"])] == ["2024-01", "2024-02"]
    assert dicts_of(found["comparison"])[0]["direction"] == "increased"
    assert [row[1:] for row in rows_of(found["steps"])] == [
        (
            "Data Quality Agent",
            "Checked missing values, duplicates, and column types.",
            "No major data quality issues detected from basic profiling.",
        ),
        (
            "KPI Agent",
            "Calculated monthly Average Order Value.",
            "Generated 2 monthly KPI records.",
        ),
        (
            "Change Detection Agent",
            "Compared current period against previous period.",
            "Average Order Value changed by 999.75 (66.64%).",
        ),
        (
            "Anomaly Agent",
            "Checked for unusual KPI values using z-score detection.",
            "Detected 0 anomalies.",
        ),
        ("Forecast Agent", "Generated a baseline KPI forecast.", "Forecasted 3 future periods."),
    ]
    sections = [row["section"] for row in dicts_of(found["report"])]
    assert sorted(set(sections)) == sorted(
        ["kpi", "summary", "change", "trend", "drivers", "anomalies", "forecast"]
    )


def test_single_period_investigation(spark):
    found = investigate(sales_table(spark, ROWS[:2]), SETTINGS, REVENUE, segment_col="region")
    assert "drivers" not in found
    assert rows_of(found["comparison"]) == []
    assert text_of(found["summary"]).startswith("Not enough period data")
    outputs = [row["output"] for row in dicts_of(found["steps"])]
    assert outputs[2:] == [
        "Revenue changed by None (None%).",
        "Detected 0 anomalies.",
        "Not enough data to forecast.",
    ]


def test_empty_investigation(spark):
    found = investigate(sales_table(spark, []), SETTINGS, REVENUE)
    outputs = [row["output"] for row in dicts_of(found["steps"])]
    assert outputs[1] == "Generated 0 monthly KPI records."
    assert outputs[3] == "No anomaly check was performed."


def test_named_months(spark):
    rows = [*ROWS, ("2024-03-01", 1.0, "z", "N")]
    table = sales_table(spark, rows)
    found = investigate(
        table, SETTINGS, REVENUE, segment_col="region", previous="2024-01", current="2024-02"
    )
    assert dicts_of(found["change"])[0]["current_period"] == "2024-03"
    assert dicts_of(found["comparison"])[0]["current_period"] == "2024-02"
    with pytest.raises(ValueError, match="2031-01"):
        investigate(table, SETTINGS, REVENUE, previous="2031-01")


def test_text_dates_are_detected_once(spark):
    rows = [("1/5/2024", 1.0, "a"), ("2/14/2024", 3.0, "b")]
    table = spark.createDataFrame(rows, "order_date string, revenue double, order_id string")
    settings = Settings("order_date", "revenue", "order_id")
    found = investigate(table, settings, REVENUE)
    assert [row["period"] for row in dicts_of(found["trend"])] == ["2024-01", "2024-02"]


def test_only_what_is_asked_for_is_computed(spark):
    found = Investigation(sales_table(spark, ROWS), SETTINGS, REVENUE, "region")
    assert rows_of(found.trend)[0][0] == "2024-01"
    assert "drivers" not in vars(found) and "counts" not in vars(found)


def test_summary_per_series(spark):
    rows = [*ROWS, ("2024-01-02", 7.0, "x", "E")]
    table = sales_table(spark, rows)
    trend = monthly_kpi(table, SETTINGS, REVENUE, ["region"])
    found = dict(rows_of(kpi_summary(latest_change(trend, ["region"]), REVENUE, by=["region"])))
    assert found["E"].startswith("Revenue increased from $7.00 in 2024-01 to $4,500.00")
    assert found["N"].startswith("Not enough")


def test_summary_of_series_with_one_month(spark):
    trend = monthly_kpi(sales_table(spark, ROWS), SETTINGS, REVENUE, ["region"])
    change = compare_periods(trend, "2024-01", "2024-02", ["region"])
    drivers = segment_drivers(
        sales_table(spark, ROWS), SETTINGS, REVENUE, "order_id", "2024-01", "2024-02", ["region"]
    )
    for extra in (None, drivers):
        found = dict(rows_of(kpi_summary(change, REVENUE, extra, ["region"])))
        assert found["E"].startswith("Revenue has no value in 2024-01 and is $4,500.00 in 2024-02.")
        assert found["N"].startswith("Revenue was $1,000.00 in 2024-01 and no value in 2024-02.")
    empty = compare_periods(trend, "2023-01", "2023-02", ["region"])
    none = change.withColumns({name: F.lit(None).cast("double") for name in ("previous_value", "current_value")})
    assert set(dict(rows_of(kpi_summary(none, REVENUE, by=["region"]))).values()) == {
        "Not enough period data is available to generate a KPI summary."
    }
    assert rows_of(empty) == []


def payloads(report, name):
    rows = report.filter(F.col("section") == name).orderBy("row_no").collect()
    return [(row.row_no, json.loads(row.payload)) for row in rows]


def test_report_has_all_rows_and_the_compared_months(spark):
    rows = [(f"20{10 + n // 12}-{n % 12 + 1:02d}-05", n + 1.0, f"o{n}", f"r{n % 14}") for n in range(30)]
    found = Investigation(
        sales_table(spark, rows), SETTINGS, REVENUE, "region", "2010-02", "2010-05"
    )
    change = payloads(found.report, "change")[0][1]
    assert (change["previous_period"], change["current_period"]) == ("2010-02", "2010-05")
    assert change["absolute_change"] == 3.0 and change["direction"] == "increased"
    trend = payloads(found.report, "trend")
    assert [number for number, _ in trend] == list(range(1, 31))
    assert trend[-1][1] == {"period": "2012-06", "kpi_name": REVENUE, "kpi_value": 30.0}
    drivers = payloads(found.report, "drivers")
    assert [number for number, _ in drivers] == list(range(1, len(drivers) + 1))
    assert drivers == sorted(drivers, key=lambda row: row[1]["absolute_change"])
    cut = Investigation(sales_table(spark, rows), SETTINGS, REVENUE, report_rows=10).report
    assert len(payloads(cut, "trend")) == 10
    assert payloads(cut, "drivers") == [(0, {"note": "No data available."})]


def test_report_of_one_month_marks_empty_sections(spark):
    report = Investigation(sales_table(spark, ROWS[:1]), SETTINGS, REVENUE, "region").report
    assert payloads(report, "forecast") == payloads(report, "drivers") == [(0, {"note": "No data available."})]


def test_trend_is_made_without_the_segment_table(spark, capsys):
    seen = []

    def segment_rows(*months):
        seen.append(months)
        return sales_table(spark, ROWS)

    facts = sales_table(spark, ROWS).drop("region")
    found = Investigation(facts, SETTINGS, REVENUE, "region", segment_rows=segment_rows)
    assert len(rows_of(found.trend)) == 2 and seen == []
    assert len(rows_of(found.drivers)) == 3 and seen == [("2024-01", "2024-02")]


SERIES_ROWS = [
    ("2024-01-05", 10.0, "a", "N"),
    ("2024-01-06", 20.0, "b", "S"),
    ("2024-02-01", 5.0, "d", "S"),
    ("2024-04-01", 7.0, "e", "N"),
    ("2024-04-02", 1.0, "f", None),
]


def keyed_table(spark):
    """Two series of different months, one of a single month, and one with a null key."""
    table = sales_table(spark, SERIES_ROWS)
    parts = [
        table.filter("day < '2024-03-01'").withColumn("shop", F.lit("one")),
        table.filter("day >= '2024-02-01'").withColumn("shop", F.lit("two")),
        table.filter("day >= '2024-04-01'").withColumn("shop", F.lit("three")),
        table.withColumn("shop", F.lit(None).cast("string")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def test_every_series_equals_an_investigation_of_its_own(spark):
    table = keyed_table(spark)
    by = {"segment_col": "region", "duplicates": False}
    found = investigate(table, SETTINGS, REVENUE, by=["shop"], **by)
    for shop in ("one", "two", "three", None):
        same = F.col("shop").eqNullSafe(F.lit(shop))
        alone = investigate(table.filter(same), SETTINGS, REVENUE, **by)
        for name in ("trend", "change", "drivers", "anomalies", "forecast", "summary"):
            expected = rows_of(alone[name]) if name in alone else []
            assert rows_of(found[name].filter(same).drop("shop")) == expected, (shop, name)
        steps = sorted(rows_of(found["steps"].filter(same).drop("shop")))
        # The notes are about the whole dataset.
        assert steps[1:] == sorted(rows_of(alone["steps"]))[1:]
        report = {(r.section, r.row_no): r.payload for r in found["report"].filter(same).collect()}
        single = {(r.section, r.row_no): r.payload for r in alone["report"].collect()}
        if shop == "three":
            # A table without two months has a change without direction.
            del report["change", 1], single["change", 1]
        assert report == single


def test_large_series_are_numbered_over_partitions(spark):
    table = spark.range(3000).selectExpr(
        "date_add(date'2024-01-05', cast(id % 2 * 31 as int)) AS day", "cast(id % 7 as double) AS revenue",
        "cast(id as string) AS order_id", "cast(id % 997 as string) AS region", "if(id % 10 = 0, null, id % 2) AS shop",
    )
    table = table.unionByName(table.withColumn("day", F.date_add("day", 31)))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        report = Investigation(table, SETTINGS, REVENUE, "region", by=["shop"]).report.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for shop in {r.shop for r in report}:
        drivers = sorted((r.row_no, json.loads(r.payload)) for r in report if r.shop == shop and r.section == "drivers") if shop is not None else []
        order = [(p["absolute_change"], p["segment"]) for _, p in drivers]
        assert [n for n, _ in drivers] == list(range(1, len(drivers) + 1)) and order == sorted(order)


def test_report_tables_are_computed_once(spark, capsys):
    found = Investigation(sales_table(spark, ROWS), SETTINGS, REVENUE, "region")
    capsys.readouterr()
    found.report.explain("formatted")
    plan = capsys.readouterr().out
    # The durable rows, read for themselves and for the markers; each scan is listed twice.
    assert plan.count("Scan ExistingRDD") <= 4 and "Window" not in plan


def test_segment_column_falls_back_to_that_of_the_settings(spark):
    settings = Settings("day", "revenue", "order_id", segment_col="region")
    table = sales_table(spark, ROWS)
    for name in (None, "not a column"):
        assert {row["segment"] for row in dicts_of(Investigation(table, settings, REVENUE, name).drivers)} == {"N", "S", "E"}
    assert settings.override(table, segment_col="order_id").segment_col == "order_id"
    with pytest.raises(ValueError, match="not a column"):
        _ = Investigation(table, SETTINGS, REVENUE, "not a column").drivers
