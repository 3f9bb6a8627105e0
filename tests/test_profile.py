"""Profile, date detection and column roles."""

import pytest
from pyspark.sql import functions as F

from helpers import dicts_of, rows_of
from tallyframe import Settings
from tallyframe.functions.dates import DATE_FORMATS, coerce_date, detect_date_format
from tallyframe.operators import (
    duplicate_rows,
    profile_columns,
    profile_dataset,
    quality_notes,
    suggest_settings,
)
from tallyframe.operators import profile
from tallyframe.operators.profile import count_repeats, duplicate_count


def texts(spark, values, name="order_date"):
    return spark.createDataFrame([(value,) for value in values], f"`{name}` string")


def by_name(df):
    return {row["column_name"]: row for row in dicts_of(df)}


def test_missing_counts_null_and_nan(spark):
    table = spark.createDataFrame(
        [(1.0, "x"), (float("nan"), None), (None, "y")], "amount double, region string"
    )
    found = by_name(profile_columns(table))
    assert (found["amount"]["missing_values"], found["region"]["missing_values"]) == (2, 1)
    assert dicts_of(profile_dataset(table))[0] == {
        "rows": 3,
        "columns": 2,
        "column_names": ["amount", "region"],
        "numeric_columns": ["amount"],
        "categorical_columns": ["region"],
        "missing_total": 3,
        "duplicate_rows": 0,
    }


def test_classes(spark):
    table = spark.sql(
        "SELECT 1 AS n, 1.5D AS d, CAST(1 AS DECIMAL(5,2)) AS dec, true AS flag, 'a' AS word, "
        "DATE'2024-01-01' AS day, array(1) AS list, map('a', 1) AS pairs"
    )
    found = by_name(profile_columns(table, distinct_estimates=True))
    assert [name for name, row in found.items() if row["is_numeric"]] == ["n", "d", "dec"]
    assert [name for name, row in found.items() if row["is_categorical"]] == ["word"]
    assert [name for name, row in found.items() if row["is_date_like"]] == ["day"]
    assert found["word"]["approx_distinct"] == 1
    assert found["pairs"]["approx_distinct"] is None


@pytest.mark.parametrize(
    ("good", "bad", "expected"), [(66, 34, False), (70, 30, False), (71, 29, True)]
)
def test_share_of_parseable_dates(spark, good, bad, expected):
    table = texts(spark, ["2024-01-05"] * good + ["soon"] * (bad - 1) + [None])
    assert by_name(profile_columns(table))["order_date"]["is_date_like"] is expected


def test_date_like_needs_name_or_type(spark):
    found = by_name(profile_columns(texts(spark, ["2024-01-05"], "shipped")))
    assert not found["shipped"]["is_date_like"]
    numbers = spark.createDataFrame([(20240105,)], "timestamp long")
    assert not by_name(profile_columns(numbers))["timestamp"]["is_date_like"]
    assert not by_name(profile_columns(texts(spark, [])))["order_date"]["is_date_like"]
    empty = spark.createDataFrame([], "day date")
    assert by_name(profile_columns(empty))["day"]["is_date_like"]


def test_text_date_is_also_categorical_and_segment_candidate(spark):
    row = by_name(profile_columns(texts(spark, ["2024-01-05"])))["order_date"]
    assert row["is_categorical"] and row["is_date_like"] and row["is_segment_candidate"]
    table = spark.createDataFrame([("a", "b")], "width string, region string")
    found = by_name(profile_columns(table))
    assert not found["width"]["is_segment_candidate"]


EXAMPLES = {
    "yyyy-M-d[ H:m[:s[.SSSSSSSSS]]]": ["2024-01-05", "2024-1-5 7:30", "2024-12-31 23:59:58.123"],
    "yyyy-M-d'T'H:m[:s[.SSSSSSSSS]][XXX]": ["2024-01-05T10:00:00", "2024-12-31T23:59:59.5Z"],
    "yyyy/M/d[ H:m[:s]]": ["2024/01/05", "2024/1/31 10:20:30"],
    "M/d/yyyy[ H:m[:s]]": ["01/05/2024", "1/31/2024 10:00", "12/12/2024"],
    "d/M/yyyy[ H:m[:s]]": ["31/01/2024", "1/2/2024", "15/1/2024"],
    "M/d/yyyy h:m[:s] a": ["1/5/2024 1:30 PM", "12/31/2024 11:59:59 AM"],
    "M/d/yy[ H:m[:s]]": ["1/5/24", "12/31/24"],
    "M-d-yyyy[ H:m[:s]]": ["01-05-2024", "1-31-2024"],
    "d-M-yyyy[ H:m[:s]]": ["31-01-2024", "5-1-2024"],
    "d.M.yyyy[ H:m[:s]]": ["31.01.2024", "5.1.2024 08:00"],
    "yyyyMMdd": ["20240105", "20241231"],
    "yyyy-M": ["2024-01", "2024-12"],
    "MMM d, yyyy": ["Jan 5, 2024", "Dec 31, 2024"],
    "MMMM d, yyyy": ["January 5, 2024", "December 31, 2024"],
    "d MMM yyyy": ["5 Jan 2024", "31 Dec 2024"],
    "d MMMM yyyy": ["5 January 2024", "31 December 2024"],
    "d-MMM-yyyy": ["5-Jan-2024", "31-Dec-2024"],
}


def test_every_format_is_found(spark):
    assert list(EXAMPLES) == [date_format for date_format, _ in DATE_FORMATS]
    for date_format, values in EXAMPLES.items():
        table = texts(spark, [*values, None])
        assert detect_date_format(table, "order_date") == date_format
        years = coerce_date(table, "order_date").select(F.year("order_date"))
        assert [row[0] for row in rows_of(years)] == [2024] * len(values) + [None]


def test_ambiguous_dates_are_month_first(spark):
    table = texts(spark, ["01/05/2024", "02/06/2024"])
    months = coerce_date(table, "order_date").select(F.month("order_date"))
    assert rows_of(months) == [(1,), (2,)]
    months = coerce_date(table, "order_date", "d/M/yyyy").select(F.month("order_date"))
    assert rows_of(months) == [(5,), (6,)]


def test_texts_without_date(spark):
    assert detect_date_format(texts(spark, ["12:30", "2024", "x", None]), "order_date") is None
    assert rows_of(coerce_date(texts(spark, ["x"]), "order_date")) == [(None,)]


def roles(columns, role):
    ranked = sorted((row[f"{role}_rank"], name) for name, row in columns.items() if row[f"{role}_rank"])
    return [name for _, name in ranked]


def test_roles(spark):
    table = spark.createDataFrame(
        [("2024-01-01", "2024-01-01", "1", 2.0, 3.0, 4.0, "x", "y", "z")],
        "created_at string, `Order Date` string, transaction_id string, price double, "
        "total_sales double, other double, product string, sales_region string, note string",
    )
    found = by_name(profile_columns(table))
    assert roles(found, "date") == ["Order Date", "created_at"]
    assert roles(found, "revenue") == ["price", "total_sales", "other"]
    assert roles(found, "order")[0] == "transaction_id"
    assert roles(found, "segment")[0] == "sales_region"
    assert roles(found, "sql_segment")[:2] == ["product", "sales_region"]
    assert suggest_settings(profile_columns(table)) == Settings(
        "Order Date", "price", "transaction_id", "yyyy-M-d[ H:m[:s[.SSSSSSSSS]]]"
    )


def test_exact_name_beats_keyword_order(spark):
    table = spark.createDataFrame([(1.0, 2.0)], "net_revenue double, amount double")
    assert roles(by_name(profile_columns(table)), "revenue") == ["amount", "net_revenue"]


def test_order_falls_back_to_first_other_column(spark):
    table = spark.createDataFrame([("2024-01-01", 1.0, 2)], "date string, value double, n int")
    found = by_name(profile_columns(table))
    assert roles(found, "order") == ["value", "n", "date"]
    assert roles(found, "segment") == ["date"]
    numbers = spark.createDataFrame([(1.0, 2)], "value double, n int")
    assert roles(by_name(profile_columns(numbers)), "sql_segment") == ["value"]
    with pytest.raises(ValueError, match="date-like"):
        suggest_settings(profile_columns(numbers))


DUPLICATES = [(1, None, 1.0), (1, None, 1.0), (1, "a", 1.0), (None, "a", None), (None, "a", None), (None, "a", None)]


def test_duplicates(spark):
    table = spark.createDataFrame(DUPLICATES, "n int, word string, x double")
    assert duplicate_rows(table) == 3
    assert duplicate_rows(table.limit(0)) == 0


def test_rows_with_equal_hash_are_told_apart(spark):
    # NULL leaves a hash unchanged, so these two rows share one.
    table = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert table.select(F.xxhash64("x", "y")).distinct().count() == 1
    assert duplicate_rows(table) == 0


def test_duplicates_with_maps(spark):
    table = spark.sql("SELECT map('a', 1) AS m, 1 AS n UNION ALL SELECT map('a', 1), 1")
    assert duplicate_rows(table) == 1
    assert duplicate_rows(table.select("m")) == 1


def test_duplicates_equal_brute_force(spark):
    rows = [(number % 7, number % 3) for number in range(200)] + [(999, 999)]
    table = spark.createDataFrame(rows, "a int, b int")
    assert duplicate_rows(table) == count_repeats(table).first()[0] == len(rows) - len(set(rows))


def exchanges(plan):
    """Shuffled bytes and partitioning of each exchange of a plan that has run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return exchanges(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return exchanges(plan.plan())
    found = []
    if name == "ShuffleExchangeExec":
        found.append((plan.metrics().apply("dataSize").value(), plan.outputPartitioning().toString()))
    children = plan.children()
    for number in range(children.size()):
        found += exchanges(children.apply(number))
    return found


@pytest.mark.parametrize("copies", [0, 2000])
def test_rows_are_not_shuffled_to_find_duplicates(spark, tmp_path, copies):
    path, rows = str(tmp_path / "wide"), 20_000
    wide = spark.range(rows).selectExpr("id", *[f"sha2(cast(id + {n} as string), 512) AS t{n}" for n in range(8)])
    wide.unionByName(wide.limit(copies)).write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        counted = duplicate_count(spark.read.parquet(path))
        assert counted.first()[0] == copies
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = exchanges(counted._jdf.queryExecution().executedPlan())
    width = 8 * 128 + 100
    # Hash and count of every row as Spark lays them out, and the copied rows with their likes.
    assert sum(size for size, _ in moved) < 40 * (rows + copies) + 3 * copies * width + 10_000
    assert sum(size for size, _ in moved) < 0.25 * rows * width or copies


def test_chance_hits_of_the_bits_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(profile, "HASH_WORDS", 1)
    rows = [(number % 400, number % 3) for number in range(1000)]
    table = spark.createDataFrame(rows, "a int, b int")
    assert duplicate_rows(table) == len(rows) - len(set(rows))


def test_quality_notes(spark):
    def notes(rows):
        table = spark.createDataFrame(rows, "n int, word string, x double")
        return rows_of(quality_notes(profile_dataset(table)))[0][0]

    assert notes(DUPLICATES) == (
        "Detected 3 duplicate rows. Detected 8 missing values across the dataset."
    )
    assert notes([(1, "a", 1.0), (1, "a", 1.0)]) == "Detected 1 duplicate rows."
    assert notes([(1, "a", None)]) == "Detected 1 missing values across the dataset."
    twice = spark.createDataFrame([(1, "a"), (1, "a")], "n int, word string")
    unchecked = quality_notes(profile_dataset(twice, duplicates=False))
    assert rows_of(unchecked) == [("Duplicate rows were not checked.",)]
    assert notes([(1, "a", 1.0)]) == "No major data quality issues detected from basic profiling."


def test_settings_override(spark):
    table = spark.createDataFrame([(1, 2)], "a int, b int")
    settings = Settings("a", "b").override(table, date_col="b", revenue_col="nope", order_col=None)
    assert settings == Settings("b", "b")
