"""The report as one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import named
from tallyframe.session import durable

# What a section without rows holds, and the summary where none is given (fixed values).
NO_DATA = "No data available."
NO_SUMMARY = "No summary available."
PAYLOAD_OPTIONS = {"ignoreNullFields": "false"}
SECTION_NO = "row_no"


def section(
    table: DataFrame,
    name: str,
    order: Sequence[str],
    rows: int | None,
    by_month: bool,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows of a result as JSON, numbered within their series.

    With ``rows``, only the first ones of each series are kept. Tables by month have no more rows in a
    series than the calendar has months and are numbered by a window, others by the place of a row in
    its sorted partition and the rows of its series in the partitions before.
    """
    keys = [named(key) for key in by]
    if rows is not None and not by:
        table = table.orderBy(*order).limit(rows) if order else table.limit(rows)
    fields = [named(name) for name in table.columns if name not in by]
    payload = F.to_json(F.struct(*fields), PAYLOAD_OPTIONS).alias("payload")
    if by_month or rows is not None:
        series = Window.partitionBy(*keys) if by else Window
        number = F.row_number().over(series.orderBy(*(order or [F.lit(1)])))
        numbered = table.select(*keys, number.alias(SECTION_NO), payload)
    else:
        numbered = numbered_parts(table.orderBy(*keys, *order), payload, by)
    if rows is not None:
        numbered = numbered.filter(F.col(SECTION_NO) <= rows)
    return numbered.select(*keys, F.lit(name).alias("section"), SECTION_NO, "payload")


def numbered_parts(ordered: DataFrame, payload: Column, by: Sequence[str] = ()) -> DataFrame:
    """Number the rows of each series of a sorted table without gathering them in one task.

    A series, however large, only meets one row for each partition that holds some of it.
    """
    keys = [named(key) for key in by]
    kept = durable(ordered.select(*keys, payload)).select(
        *keys,
        "payload",
        # In a struct nulls are equal.
        F.struct(*keys, F.spark_partition_id().alias("__part")).alias("__run"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__place"),
    )
    runs = kept.groupBy("__run").agg(F.count(F.lit(1)).alias("size"), F.min("__place").alias("first"))
    series = Window.partitionBy(*[F.col("__run")[key] for key in by]) if by else Window
    before = F.sum("size").over(series.orderBy(F.col("__run")["__part"])) - F.col("size")
    starts = runs.select("__run", (before - F.col("first") + 1).alias("__start"))
    number = (F.col("__start") + F.col("__place")).cast("int")
    return kept.join(starts, "__run").select(*keys, number.alias(SECTION_NO), "payload")


def markers(series: DataFrame, found: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """A row with a note for each section in which a series has no rows."""
    keys = [named(key) for key in by]
    each = series.select(*keys, F.explode(F.array(*map(F.lit, names))).alias("section"))
    place = F.struct(*keys, "section").alias("__place")
    missing = each.select("*", place).join(found.select(place).distinct(), "__place", "left_anti")
    note = F.to_json(F.struct(F.lit(NO_DATA).alias("note"))).alias("payload")
    return missing.select(*keys, "section", F.lit(0).alias(SECTION_NO), note)


def report_bundle(
    kpi_name: str,
    change: DataFrame,
    trend: DataFrame,
    summary: DataFrame | None = None,
    drivers: DataFrame | None = None,
    anomalies: DataFrame | None = None,
    forecast: DataFrame | None = None,
    rows: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Report as rows (section, row_no, payload), with ``by`` after the keys of the series.

    All rows of each table, or the first ``rows`` of each series. A section that is empty or not given
    has one row with number 0 and a note, in each series of the trend. The numbered rows are made
    durable, so that no table is computed again to find out which sections are empty; any number of
    series takes the same few jobs.
    """
    keys = [named(key) for key in by]
    one = trend.sparkSession.range(1)
    series = durable(trend.select(*keys).distinct()) if by else one.select()
    if summary is None:
        summary = series.select(*keys, F.lit(NO_SUMMARY).alias("summary"))
    sections = [
        (series.select(*keys, F.lit(kpi_name).alias("kpi_name")), "kpi", (), True),
        (summary, "summary", (), True),
        (change, "change", (), True),
        (trend, "trend", ("period",), True),
        (drivers, "drivers", ("absolute_change", "segment"), False),
        (anomalies, "anomalies", ("period",), True),
        (forecast, "forecast", ("period",), True),
    ]
    found = None
    for table, name, order, by_month in sections:
        if table is not None:
            part = section(table, name, order, rows, by_month, by)
            found = part if found is None else found.unionByName(part)
    found = durable(found)
    return found.unionByName(markers(series, found, [name for _, name, _, _ in sections], by))
