"""The KPIs as aggregate expressions for any ``groupBy``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import present
from tallyframe.functions.numbers import exact_sum
from tallyframe.settings import AOV, KPI_NAMES, ORDERS, REVENUE, Settings


def check_kpi(kpi_name: str, settings: Settings) -> None:
    if kpi_name not in KPI_NAMES:
        raise ValueError(f"unsupported KPI: {kpi_name}")
    if kpi_name != ORDERS and settings.revenue_col is None:
        raise ValueError(f"the KPI {kpi_name} needs a revenue column")


def revenue_sum(df: DataFrame, settings: Settings) -> Column:
    """Sum of revenue, 0.0 when nothing is there to sum."""
    return F.coalesce(exact_sum(present(df, settings.revenue_col).cast("double")), F.lit(0.0))


def order_count(df: DataFrame, settings: Settings) -> Column:
    """Distinct non-missing order ids, or rows if there is no order column.

    Spark counts a single distinct column by deduplicating on (group, id) first,
    so no group's ids ever meet in one task.
    """
    if settings.order_col is None:
        return F.count(F.lit(1))
    order = present(df, settings.order_col)
    return F.approx_count_distinct(order) if settings.approximate_orders else F.count_distinct(order)


def kpi_value(df: DataFrame, kpi_name: str, settings: Settings) -> Column:
    """Unrounded KPI of the rows of a group, as double."""
    check_kpi(kpi_name, settings)
    if kpi_name == REVENUE:
        return revenue_sum(df, settings)
    if kpi_name == ORDERS:
        return order_count(df, settings).cast("double")
    return F.coalesce(
        F.try_divide(revenue_sum(df, settings), order_count(df, settings).cast("double")),
        F.lit(0.0),
    )


def role_columns(kpi_name: str, settings: Settings) -> list[str]:
    """Columns a KPI reads besides the date."""
    check_kpi(kpi_name, settings)
    roles = []
    if kpi_name in (REVENUE, AOV):
        roles.append(settings.revenue_col)
    if kpi_name in (ORDERS, AOV) and settings.order_col is not None:
        roles.append(settings.order_col)
    return roles
