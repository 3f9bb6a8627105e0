"""Names, types and missing values of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names are matched to date columns by these substrings (fixed values).
DATE_NAME_KEYWORDS = ("date", "time", "created_at", "updated_at", "timestamp")


def quote_identifier(name: str) -> str:
    """Backtick-quoted name, for columns holding spaces, dots or quotes."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    """The column called exactly ``name``."""
    return F.col(quote_identifier(name))


def data_type(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"no column named {name!r}")
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_categorical(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def has_date_name(name: str) -> bool:
    return any(keyword in name.lower() for keyword in DATE_NAME_KEYWORDS)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so both count as missing."""
    dtype = data_type(df, name)
    if is_floating(dtype):
        return F.expr(f"nanvl({quote_identifier(name)}, CAST(NULL AS {dtype.simpleString()}))")
    return named(name)


def is_missing(df: DataFrame, name: str) -> Column:
    column = quote_identifier(name)
    if is_floating(data_type(df, name)):
        return F.expr(f"{column} IS NULL OR isnan({column})")
    return F.expr(f"{column} IS NULL")
