"""Reading CSV and writing reports."""

import pytest

from helpers import dicts_of, rows_of
from tallyframe import REVENUE, Settings
from tallyframe.operators import kpi_trend
from tallyframe.plans import report_bundle
from tallyframe.sources import (
    malformed_counts,
    malformed_rows,
    nan_to_null,
    preview,
    read_dataset,
    read_report,
    write_report,
)


@pytest.fixture
def csv_file(tmp_path):
    def write(text):
        path = tmp_path / "data.csv"
        path.write_text(text)
        return str(path)

    return write


def test_missing_tokens_and_types(spark, csv_file):
    path = csv_file(
        "order_date,order_id,amount,units,region,open,void\n"
        "2024-01-05,7,1.5,1,North,True,\n"
        "2024-01-06,NA,N/A,2,null,False,NaN\n"
        "2024-02-01,8,NaN,3,N/A,True,\n"
        "2024-02-02,,2,4,n1,False,NA\n"
    )
    table = read_dataset(spark, path)
    assert dict(table.dtypes) == {
        "order_date": "string",
        "order_id": "bigint",
        "amount": "double",
        "units": "bigint",
        "region": "string",
        "open": "boolean",
        "void": "double",
    }
    assert [row["region"] for row in dicts_of(table)] == ["North", None, None, "n1"]
    assert [row["amount"] for row in dicts_of(table)] == [1.5, None, None, 2.0]
    trend = kpi_trend(table, Settings("order_date", "amount", "order_id"), REVENUE)
    assert rows_of(trend) == [("2024-01", REVENUE, 1.5), ("2024-02", REVENUE, 2.0)]


def test_texts_that_only_look_like_numbers_to_a_cast(spark, csv_file):
    table = read_dataset(spark, csv_file("size,flag,big\n1d,True,99999999999999999999\n2f,,1\n"))
    assert dict(table.dtypes) == {"size": "string", "flag": "string", "big": "double"}


def test_quotes_and_line_breaks(spark, csv_file):
    text = 'name,n\n"a ""quoted"", word",1\n"two\nlines",2\n'
    table = read_dataset(spark, csv_file(text), multi_line=True)
    assert rows_of(table) == [('a "quoted", word', 1), ("two\nlines", 2)]


def test_given_schema(spark, csv_file):
    path = csv_file("day,amount,region\n2024-01-05,1.5,NA\n2024-01-06,NaN,x\n")
    table = read_dataset(spark, path, "day date, amount double, region string")
    assert [(row[1], row[2]) for row in rows_of(table)] == [(1.5, None), (None, "x")]


def test_header_only(spark, csv_file):
    table = read_dataset(spark, csv_file("a,b\n"))
    assert table.columns == ["a", "b"]
    assert table.count() == 0


def test_parquet_nan_becomes_null(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    spark.createDataFrame([(float("nan"),), (1.0,)], "x double").write.parquet(path)
    assert sorted(rows_of(read_dataset(spark, path)), key=str) == [(1.0,), (None,)]


def test_nan_in_columns_with_awkward_names(spark):
    table = spark.createDataFrame([(float("nan"), 1.0, "a")], "`a.b` double, `c d` float, e string")
    cleaned = nan_to_null(table)
    assert cleaned.dtypes == table.dtypes
    assert rows_of(cleaned) == [(None, 1.0, "a")]


def test_preview(spark):
    assert preview(spark.range(100)).count() == 5


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_report_round_trip(spark, tmp_path, fmt):
    trend = spark.createDataFrame(
        [(f"2023-{month:02d}", REVENUE, float(month)) for month in range(12, 0, -1)],
        "period string, kpi_name string, kpi_value double",
    )
    change = spark.createDataFrame([("2023-12", None)], "current_period string, percent_change double")
    report = report_bundle(REVENUE, change, trend)
    path = str(tmp_path / "report")
    write_report(report, path, fmt)
    found = sorted(rows_of(read_report(spark, path, fmt)))
    assert found == sorted(rows_of(report))
    by_section = {}
    for section, row_no, payload in found:
        by_section.setdefault(section, []).append((row_no, payload))
    assert sorted(by_section) == sorted(
        ["anomalies", "change", "drivers", "forecast", "kpi", "summary", "trend"]
    )
    assert by_section["drivers"] == [(0, '{"note":"No data available."}')]
    assert [row_no for row_no, _ in by_section["trend"]] == list(range(1, 13))
    assert by_section["trend"][0][1].startswith('{"period":"2023-01"')
    assert by_section["change"] == [(1, '{"current_period":"2023-12","percent_change":null}')]
    assert by_section["summary"] == [(1, '{"summary":"No summary available."}')]


def test_report_format_is_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="parquet or json"):
        write_report(spark.range(1), str(tmp_path / "r"), "xml")


def test_format_is_given_or_told_by_the_ending(spark, tmp_path):
    folder = str(tmp_path / "sales")
    spark.range(3).write.parquet(folder)
    with pytest.raises(ValueError, match="give fmt"):
        read_dataset(spark, folder)
    assert read_dataset(spark, folder, fmt="parquet").count() == 3
    with pytest.raises(ValueError, match="give fmt"):
        read_dataset(spark, folder, fmt="orc")


RAGGED = (
    "day,n,word,N\n"
    "2024-01-01,5,a,b\n"
    "2024-01-02,6,a,b,EXTRA\n"
    '2024-01-03,7\n'
    '2024-01-04,8,"x,y ""z"" ",b\n'
    "2024-01-05,9,a,b,\n"
    '2024-01-06,10,"p,q",b,"r,s"\n'
)


def test_rows_that_do_not_fit_are_reported(spark, csv_file):
    path = csv_file(RAGGED)
    found = malformed_rows(spark, path)
    assert sorted(rows_of(found)) == [
        ("2024-01-02,6,a,b,EXTRA", 5, 4, "surplus"),
        ("2024-01-03,7", 2, 4, "missing"),
        ("2024-01-05,9,a,b,", 5, 4, "surplus"),
        ('2024-01-06,10,"p,q",b,"r,s"', 5, 4, "surplus"),
    ]
    assert rows_of(malformed_counts(found)) == [(3, 1, 0)]
    assert found.count() == 4
    typed = malformed_rows(spark, csv_file("n,day\nx,2024-01-01\n3,2024-01-02\n4\n"), "n int, day date")
    assert sorted(row["problem"] for row in dicts_of(typed)) == ["missing", "value"]


def test_rules_for_rows_that_do_not_fit(spark, csv_file):
    path = csv_file(RAGGED)
    with pytest.raises(Exception, match="row does not fit the 4 columns: 2024-01-0"):
        read_dataset(spark, path)
    dropped = read_dataset(spark, path, malformed="drop")
    assert dropped.count() == 3 and [row["n"] for row in dicts_of(dropped)] == [5, 7, 8]
    assert [row["word"] for row in dicts_of(dropped.select("word"))] == ["a", None, 'x,y "z" ']
    assert read_dataset(spark, path, malformed="keep").count() == 6
    short = csv_file("a,b\n1,2\n3\n")
    assert rows_of(read_dataset(spark, short)) == [(1, 2), (3, None)]
    with pytest.raises(Exception, match="row does not fit the 2 columns: 3"):
        read_dataset(spark, short, malformed="strict")
    with pytest.raises(ValueError, match="malformed is one of"):
        read_dataset(spark, short, malformed="ignore")
    given = read_dataset(spark, csv_file(RAGGED), "day date, n int, word string, rest string", malformed="drop")
    assert [row["n"] for row in dicts_of(given)] == [5, 7, 8]


def test_equal_and_blank_header_names(spark, csv_file):
    table = read_dataset(spark, csv_file("amount,day,Amount,,amount\n1,2024-01-01,2,x,3\n"))
    assert table.columns == ["amount", "day", "Amount.1", "_c3", "amount.2"]
    assert [value for name, value in dicts_of(table)[0].items() if "mount" in name] == [1, 2, 3]
    trend = kpi_trend(table, Settings("day", table.columns[2]), REVENUE)
    assert rows_of(trend) == [("2024-01", REVENUE, 2.0)]


def test_files_without_rows(spark, csv_file):
    assert read_dataset(spark, csv_file("a,b\n")).columns == ["a", "b"]
    assert read_dataset(spark, csv_file("")).columns == []
    assert malformed_rows(spark, csv_file("")).count() == 0
