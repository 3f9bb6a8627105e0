"""SQL over the dataset and the ready-made queries."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import named, present, quote_identifier
from tallyframe.functions.kpi import order_count
from tallyframe.functions.numbers import exact_sum, round2
from tallyframe.settings import AOV, ORDERS, REVENUE, Settings
from tallyframe.sources.datasets import preview

TABLE_NAME = "sales_data"
PREVIEW_ROWS = 10
BINDING = threading.Lock()
DOUBLE_QUOTED_IDENTIFIERS = "spark.sql.ansi.doubleQuotedIdentifiers"

# Directives of strftime and the patterns of Spark's that mean the same (fixed values).
DIRECTIVES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%-m": "M",
    "%d": "dd",
    "%-d": "d",
    "%j": "DDD",
    "%b": "MMM",
    "%B": "MMMM",
    "%a": "EEE",
    "%A": "EEEE",
    "%H": "HH",
    "%-H": "H",
    "%I": "hh",
    "%-I": "h",
    "%p": "a",
    "%M": "mm",
    "%-M": "m",
    "%S": "ss",
    "%-S": "s",
}

# An SQL function: the analyzer puts its body into the plan. The pattern is cut into directives and
# the text between them; text is kept as it is, and an unknown directive fails.
STRFTIME = (
    "CREATE OR REPLACE TEMPORARY FUNCTION strftime(moment TIMESTAMP_NTZ, pattern STRING) RETURNS STRING "
    "RETURN CASE WHEN moment IS NOT NULL THEN array_join(transform("
    "regexp_extract_all(pattern, '(%-?.|%|[^%]+)', 1), part -> CASE part "
    + " ".join(f"WHEN '{name}' THEN date_format(moment, '{form}')" for name, form in DIRECTIVES.items())
    + " WHEN '%%' THEN '%' ELSE CASE WHEN part LIKE '\\%%' "
    "THEN raise_error(concat('strftime does not know ', part)) ELSE part END END), '') END"
)


def run_sql(
    df: DataFrame, query: str, select_only: bool = False, double_quotes: bool = False
) -> DataFrame:
    """Run Spark SQL with the dataset as table ``sales_data``.

    Blank text gives an empty result. ``select_only`` refuses texts that do not
    start with SELECT; without it, commands run as soon as they are given.
    ``double_quotes`` reads "name" as an identifier, and not as a text.
    ``strftime(moment, pattern)`` knows the directives of ``DIRECTIVES`` and fails
    on others.
    """
    spark = df.sparkSession
    if select_only and not query.strip().lower().startswith("select"):
        raise ValueError("only SELECT queries are allowed")
    if not query.strip():
        return spark.createDataFrame([], T.StructType([]))
    # The text is bound to the view while it is analyzed, so threads take turns until then. Other threads that
    # call spark.sql themselves meanwhile see the quoting of this text; give them a session of their own.
    with BINDING:
        df.createOrReplaceTempView(TABLE_NAME)
        spark.sql(STRFTIME)
        before = spark.conf.get(DOUBLE_QUOTED_IDENTIFIERS)
        spark.conf.set(DOUBLE_QUOTED_IDENTIFIERS, str(double_quotes).lower())
        try:
            return spark.sql(query)
        finally:
            spark.conf.set(DOUBLE_QUOTED_IDENTIFIERS, before)


def sample_queries(settings: Settings, segment_col: str) -> dict[str, str]:
    """Ready-made query texts for the chosen columns."""
    day = quote_identifier(settings.date_col)
    revenue = quote_identifier(settings.revenue_col)
    order = quote_identifier(settings.order_col)
    segment = quote_identifier(segment_col)
    return {
        "Monthly revenue": (
            f"SELECT date_format(CAST({day} AS DATE), 'yyyy-MM') AS month, "
            f"round(sum({revenue}), 2) AS total_revenue "
            f"FROM {TABLE_NAME} GROUP BY ALL ORDER BY month"
        ),
        f"Revenue by {segment_col}": (
            f"SELECT {segment} AS segment, round(sum({revenue}), 2) AS total_revenue "
            f"FROM {TABLE_NAME} GROUP BY ALL ORDER BY total_revenue DESC"
        ),
        f"Orders by {segment_col}": (
            f"SELECT {segment} AS segment, count(DISTINCT {order}) AS total_orders "
            f"FROM {TABLE_NAME} GROUP BY ALL ORDER BY total_orders DESC"
        ),
        "Preview data": f"SELECT * FROM {TABLE_NAME} LIMIT {PREVIEW_ROWS}",
    }


def kpi_by_segment(
    df: DataFrame,
    settings: Settings,
    kpi_name: str,
    segment_col: str = "region",
    preview_instead: bool = False,
) -> DataFrame:
    """KPI of each segment over all months, highest first; rows without segment form a group.

    A column role that the KPI needs must be given, unless ``preview_instead``
    asks for some rows of the table in that case.
    """
    has_revenue = settings.revenue_col is not None
    has_orders = settings.order_col is not None
    if kpi_name == REVENUE and has_revenue:
        name, value = "total_revenue", round2(exact_sum(present(df, settings.revenue_col).cast("double")))
    elif kpi_name == ORDERS and has_orders:
        name, value = "total_orders", order_count(df, settings)
    elif kpi_name == AOV and has_revenue and has_orders:
        name = "average_order_value"
        value = round2(
            F.try_divide(
                exact_sum(present(df, settings.revenue_col).cast("double")),
                order_count(df, settings).cast("double"),
            )
        )
    elif preview_instead:
        return preview(df, PREVIEW_ROWS)
    else:
        raise ValueError(f"{kpi_name} needs column roles that the settings do not have")
    return df.groupBy(named(segment_col)).agg(value.alias(name)).orderBy(F.desc(name))
