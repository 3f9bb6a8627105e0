"""Loading one flat transaction table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import is_categorical, is_floating, named, present
from tallyframe.functions.dates import without_stored_month

# Texts that stand for a missing value in a CSV field (fixed values).
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
# What becomes of CSV rows that do not fit the columns, and the name of their text.
MALFORMED = ("fail", "drop", "keep", "strict")
BAD_RECORD = "__record"
ENDINGS = {"parquet": r"\.parquet$", "csv": r"\.(csv|tsv|txt)(\.\w+)?$"}
BOOLEAN_TEXTS = ("True", "TRUE", "true", "False", "FALSE", "false")

# Spark's casts also accept texts such as 1d or 2f; a CSV number looks like this.
INTEGER_SHAPE = r"^\s*[+-]?\d+\s*$"
FLOAT_SHAPE = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|Inf|Infinity|infinity)\s*$"


def read_dataset(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
    fmt: str | None = None,
    malformed: str = "fail",
) -> DataFrame:
    """Read a CSV file with header, or Parquet, into a table with one kind of missing value.

    ``fmt`` is ``csv`` or ``parquet``; without it, the endings of the paths (files
    or folders) must tell. For
    CSV the missing-value tokens become NULL and, unless ``schema`` is given,
    column types are inferred in one pass: integer, double, boolean, else
    string. Dates stay strings until they are coerced. Quoted line breaks need
    ``multi_line``, which keeps Spark from splitting files.

    A CSV row with fewer fields than the header has NULL in the others. ``malformed`` says what becomes
    of one with more: ``fail`` fails, ``drop`` leaves it out, ``keep`` cuts it off, and ``strict`` fails
    for rows with fewer fields and values that don't fit ``schema`` as well. ``malformed_rows`` lists
    them all. Of header names that are equal but for case, the second becomes ``name.1`` and so on; a
    blank one becomes ``_c`` and its place, from 0.
    """
    if malformed not in MALFORMED:
        raise ValueError(f"malformed is one of {MALFORMED}, not {malformed!r}")
    paths = [path] if isinstance(path, str) else list(path)
    if file_format(paths, fmt) == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return nan_to_null(reader.parquet(*paths))
    records = csv_records(spark, paths, schema, multi_line, whole=malformed != "keep")
    rows = tokens_to_null(checked(records, malformed))
    return nan_to_null(rows if schema is not None else apply_types(rows, infer_types(rows)))


def csv_records(
    spark: SparkSession,
    paths: list[str],
    schema: T.StructType | str | None,
    multi_line: bool,
    whole: bool = True,
) -> DataFrame:
    """The rows of CSV files and, if ``whole``, the text of those that don't fit the columns.

    To tell them, all fields of a line are parsed, whichever are used.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    if schema is None:
        names = header_names(spark, paths, multi_line)
        schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    elif isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    if whole:
        schema = T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])
        options |= {"columnPruning": False, "columnNameOfCorruptRecord": BAD_RECORD}
    return spark.read.options(**options).schema(schema).csv(paths)


def header_names(spark: SparkSession, paths: list[str], multi_line: bool) -> list[str]:
    """The names in the first line, made different from each other."""
    first = spark.read.options(escape='"', multiLine=multi_line).csv(paths).first()
    names: list[str] = []
    taken: set[str] = set()
    for place, given in enumerate(first or ()):
        name = base = given or f"_c{place}"
        number = 0
        while name.lower() in taken:
            number += 1
            name = f"{base}.{number}"
        taken.add(name.lower())
        names.append(name)
    return names


def record_of(records: DataFrame) -> Column:
    """The text of a row that doesn't fit, else NULL.

    Spark refuses queries that read nothing but this text, as a count of such rows would, so nothing of
    another column is put after it.
    """
    other = named(next(name for name in records.columns if name != BAD_RECORD)).cast("string")
    return F.concat(F.col(BAD_RECORD), F.substring(F.coalesce(other, F.lit("")), 1, 0))


def field_count(record: Column) -> Column:
    """Fields of a CSV line: separators outside quotes, and one."""
    bare = F.regexp_replace(record, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def checked(records: DataFrame, malformed: str) -> DataFrame:
    """The records without their text, after the rule for those that don't fit."""
    if BAD_RECORD not in records.columns or len(records.columns) == 1:
        return records.drop(BAD_RECORD)
    record, expected = record_of(records), len(records.columns) - 1
    wrong = record.isNotNull() if malformed == "strict" else field_count(record) > expected
    if malformed == "drop":
        return records.filter(~F.coalesce(wrong, F.lit(False))).drop(BAD_RECORD)
    message = F.concat(F.lit(f"row does not fit the {expected} columns: "), record)
    return records.filter(F.when(wrong, F.raise_error(message).cast("boolean")).otherwise(True)).drop(
        BAD_RECORD
    )


def malformed_rows(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """The CSV rows that don't fit the columns: record, fields, expected, problem.

    The problem is ``surplus`` or ``missing`` fields, or ``value`` where a value doesn't fit ``schema``.
    """
    paths = [path] if isinstance(path, str) else list(path)
    records = csv_records(spark, paths, schema, multi_line)
    expected = len(records.columns) - 1
    if expected == 0:
        return spark.createDataFrame([], "record string, fields int, expected int, problem string")
    rows = records.select(record_of(records).alias("record")).filter(F.col("record").isNotNull())
    fields = field_count(F.col("record"))
    problem = F.when(fields > expected, "surplus").when(fields < expected, "missing").otherwise("value")
    return rows.select("record", fields.alias("fields"), F.lit(expected).alias("expected"), problem.alias("problem"))


def malformed_counts(malformed: DataFrame) -> DataFrame:
    """How many of ``malformed_rows`` there are of each problem, as one row."""
    kinds = ("surplus", "missing", "value")
    return malformed.agg(*[F.count_if(F.col("problem") == kind).alias(kind) for kind in kinds])


def file_format(paths: list[str], fmt: str | None) -> str:
    found = {fmt} if fmt else {
        next((name for name, ending in ENDINGS.items() if re.search(ending, one.rstrip("/"))), None)
        for one in paths
    }
    if len(found) != 1 or not found <= set(ENDINGS):
        raise ValueError(f"give fmt, one of {sorted(ENDINGS)}, for {paths}")
    return found.pop()


def tokens_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.when(~named(field.name).isin(*MISSING_TOKENS), named(field.name)).alias(field.name)
            if is_categorical(field.dataType)
            else named(field.name)
            for field in df.schema.fields
        ]
    )


def infer_types(texts: DataFrame) -> dict[str, str]:
    """Type of each text column, from one aggregation over the table."""
    tests = []
    for position, name in enumerate(texts.columns):
        value = named(name)
        integer = value.rlike(INTEGER_SHAPE) & value.try_cast("bigint").isNotNull()
        tests += [
            F.count(value).alias(f"present_{position}"),
            F.count_if(integer).alias(f"integer_{position}"),
            F.count_if(value.rlike(FLOAT_SHAPE)).alias(f"float_{position}"),
            F.count_if(value.isin(*BOOLEAN_TEXTS)).alias(f"boolean_{position}"),
        ]
    found = texts.agg(F.count(F.lit(1)).alias("rows"), *tests).first()
    types = {}
    for position, name in enumerate(texts.columns):
        present_values = found[f"present_{position}"]
        if present_values == found[f"integer_{position}"] and present_values > 0:
            types[name] = "bigint"
        elif present_values == found[f"float_{position}"]:
            types[name] = "string" if found["rows"] == 0 else "double"
        elif found["rows"] == found[f"boolean_{position}"]:
            types[name] = "boolean"
        else:
            types[name] = "string"
    return types


def apply_types(texts: DataFrame, types: dict[str, str]) -> DataFrame:
    return texts.select(
        *[
            (named(name) if types[name] == "string" else as_type(named(name), types[name])).alias(
                name
            )
            for name in texts.columns
        ]
    )


def as_type(text: Column, type_name: str) -> Column:
    return F.trim(text).try_cast(type_name)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL both mean missing; keep only NULL, so sums and counts skip both."""
    return df.withColumns(
        {
            field.name: present(df, field.name)
            for field in df.schema.fields
            if is_floating(field.dataType)
        }
    )


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """Some first rows; which ones is not promised."""
    return without_stored_month(df).limit(rows)
