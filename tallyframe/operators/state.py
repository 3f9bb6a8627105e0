"""Monthly figures kept between runs: refreshed by month, rolled up without the base rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import data_type, named, present
from tallyframe.functions.dates import coerce_date, filter_periods, month_of, month_start, period_of
from tallyframe.functions.kpi import revenue_sum
from tallyframe.functions.numbers import exact_sum, round2
from tallyframe.operators.trend import MONTH, dated, monthly_kpis
from tallyframe.settings import AOV, KPI_NAMES, ORDERS, REVENUE, Settings

# Log2 of the registers of a sketch of distinct orders.
SKETCH_SIZE = 14
STATE_PERIOD = "period"


def estimate_error(sketch_size: int = SKETCH_SIZE) -> float:
    """Relative standard error of an estimate from merged sketches; three of them hold 99 % of estimates."""
    return 1.04 / 2 ** (sketch_size / 2)


# --- exact trends by month ------------------------------------------------


def write_trend(
    df: DataFrame,
    settings: Settings,
    path: str,
    kpi_names: Sequence[str] = KPI_NAMES,
    by: Sequence[str] = (),
) -> None:
    """Keep the trends of all months, one folder per month."""
    trend = monthly_kpis(df, settings, kpi_names, by)
    trend.write.partitionBy(STATE_PERIOD).parquet(path)


def refresh_trend(
    df: DataFrame,
    settings: Settings,
    path: str,
    periods: Iterable[str],
    kpi_names: Sequence[str] = KPI_NAMES,
    by: Sequence[str] = (),
) -> None:
    """Compute the named months anew and put them in place of what is kept of them.

    A KPI of a month depends on the rows of that month alone, so only these are read (of a stored table,
    only their folders) and the result equals a full run. A month that has no rows any more is replaced
    as well: each one named is written with a row that marks it, which ``read_trend`` leaves out.
    """
    wanted = sorted({period for period in periods if month_start(period)})
    typed = coerce_date(df, settings.date_col, settings.date_format)
    trend = monthly_kpis(filter_periods(typed, settings.date_col, *wanted), settings, kpi_names, by)
    marks = df.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, wanted)).cast("array<string>")).alias(STATE_PERIOD)
    )
    rows = trend.unionByName(marks, allowMissingColumns=True)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(STATE_PERIOD).parquet(path)


def read_trend(
    spark: SparkSession, path: str, kpi_names: Sequence[str] = KPI_NAMES, by: Sequence[str] = ()
) -> DataFrame:
    """The kept trends, as ``monthly_kpis`` gives them.

    Each KPI of each series is a series of its own: give the other operators ``by=["kpi_name", ...]``.
    """
    kept = spark.read.parquet(path).withColumn(STATE_PERIOD, month_text())
    rows = kept.filter(F.col("kpi_value").isNotNull() & F.col("kpi_name").isin(*kpi_names))
    return rows.select(*[named(key) for key in by], STATE_PERIOD, "kpi_name", "kpi_value")


def month_text() -> Column:
    """The folder's month as ``yyyy-MM``, whichever type Spark reads from its name."""
    return F.substring(F.col(STATE_PERIOD).cast("string"), 1, 7)


# --- mergeable sums and sketches ------------------------------------------


def kpi_state(
    df: DataFrame, settings: Settings, by: Sequence[str] = (), sketch_size: int = SKETCH_SIZE
) -> DataFrame:
    """Revenue, rows and a sketch of the distinct orders for each series and month.

    Exact distinct counts do not add up over months or segments; sketches merge. One has at most
    2^sketch_size bytes, whatever it counted.
    """
    rows = dated(df, settings)
    measures = [F.count(F.lit(1)).alias("n_rows")]
    if settings.revenue_col is not None:
        measures.append(revenue_sum(rows, settings).alias("revenue"))
    if settings.order_col is not None:
        sketch = F.hll_sketch_agg(countable(rows, settings.order_col), F.lit(sketch_size))
        measures.append(sketch.alias("order_sketch"))
    keys = [named(key) for key in by]
    grouped = rows.groupBy(*keys, month_of(settings.date_col).alias(MONTH)).agg(*measures)
    return grouped.select(
        *keys, period_of(F.col(MONTH)).alias("period"), *grouped.columns[len(keys) + 1 :]
    )


def countable(df: DataFrame, name: str) -> Column:
    """The column in a type that sketches take."""
    value = present(df, name)
    takes = isinstance(data_type(df, name), (T.IntegerType, T.LongType, T.StringType, T.BinaryType))
    return value if takes else value.cast("string")


def roll_up(
    state: DataFrame, by: Sequence[str] = (), periods: Iterable[str] | None = None, monthly: bool = False
) -> DataFrame:
    """The KPIs of coarser series from ``kpi_state``: any part of its keys, over any months.

    Revenue is exact, Orders an estimate (see ``estimate_error``), and so is the Average Order Value.
    Without an order column, Orders counts rows and is exact. ``monthly`` keeps the months apart.
    Partial sketches are merged before the shuffle, so a hot series sends one sketch a task.
    """
    keys = [*by, "period"] if monthly else list(by)
    rows = state if periods is None else state.filter(F.col("period").isin(*periods))
    sketched = "order_sketch" in state.columns
    # A month without order ids has a sketch of nothing; without rows at all there is none to merge.
    orders = F.hll_sketch_estimate(F.hll_union_agg("order_sketch")) if sketched else F.sum("n_rows")
    measures = [F.coalesce(orders, F.lit(0)).cast("double").alias(ORDERS)]
    if "revenue" in state.columns:
        revenue = F.coalesce(exact_sum(F.col("revenue")), F.lit(0.0))
        average = F.coalesce(F.try_divide(revenue, F.coalesce(orders, F.lit(0)).cast("double")), F.lit(0.0))
        measures += [round2(revenue).alias(REVENUE), round2(average).alias(AOV)]
    return rows.groupBy(*[named(key) for key in keys]).agg(*measures)
