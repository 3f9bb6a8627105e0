"""A transaction table stored typed, by month."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.columns import named
from tallyframe.functions.dates import (
    STORED_MONTH,
    coerce_date,
    filter_periods,
    month_of,
    without_stored_month,
)
from tallyframe.settings import Settings

# Rows that agree in month and cluster columns are dealt out to this many places.
SPREAD = 1024


def write_store(
    df: DataFrame,
    settings: Settings,
    path: str,
    cluster_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """Write a table with typed dates, one folder per month, clustered by the named segments.

    Dates are parsed this once; from then on a month filter prunes folders and its range on the date
    reaches the files, whose row groups hold few segments each. Rows are dealt by range over
    (month, segments, a hash of the row), so a hot month or segment is written by many tasks and a task
    writes few folders. Rows without a usable date have a folder of their own.
    """
    rows = stored_rows(df, settings, cluster_by)
    rows.write.mode(mode).partitionBy(STORED_MONTH).parquet(path)


def replace_months(
    df: DataFrame,
    settings: Settings,
    path: str,
    periods: Iterable[str],
    cluster_by: Sequence[str] = (),
) -> None:
    """Put the rows of the named months in place of those that the store has; other months stay untouched.

    Only rows of these months are taken from ``df``. A month without rows there keeps its folder, so
    take such rows out with the months that they move to. The table must not be read from this store.
    """
    typed = coerce_date(without_stored_month(df), settings.date_col, settings.date_format)
    rows = stored_rows(filter_periods(typed, settings.date_col, *periods), settings, cluster_by)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(STORED_MONTH).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; its last column is the month by which it is stored, NULL for undated rows.

    Operators use that column to prune folders and otherwise leave it out.
    """
    return spark.read.option("mergeSchema", False).parquet(path)


def stored_rows(df: DataFrame, settings: Settings, cluster_by: Sequence[str]) -> DataFrame:
    typed = coerce_date(without_stored_month(df), settings.date_col, settings.date_format)
    rows = typed.withColumn(STORED_MONTH, month_of(settings.date_col))
    roles = dict.fromkeys([settings.date_col, settings.order_col or settings.date_col])
    spread = F.pmod(F.xxhash64(*[named(name) for name in roles]), F.lit(SPREAD))
    order = [named(STORED_MONTH), *[named(name) for name in cluster_by]]
    return rows.repartitionByRange(*order, spread).sortWithinPartitions(*order, named(settings.date_col))
