"""Registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import AOV, ORDERS, REVENUE
from tallyframe.functions.columns import named
from tallyframe.functions.dates import (
    coerce_date,
    date_shape,
    filter_periods,
    format_hits,
    with_period,
)
from tallyframe.functions.numbers import format_kpi_value
from tallyframe.operators import (
    anomaly_count,
    compare_periods,
    compare_series,
    comparison_periods,
    detect_anomalies,
    driver_extremes,
    drivers_all_segments,
    estimate_error,
    forecast_kpi,
    kpi_by_segment,
    kpi_state,
    kpi_trend,
    latest_change,
    linear_fit,
    list_periods,
    monthly_kpi,
    monthly_kpis,
    period_changes,
    profile_columns,
    profile_dataset,
    quality_notes,
    read_trend,
    refresh_trend,
    roll_up,
    run_sql,
    sample_queries,
    segment_drivers,
    series_months,
    tag_questions,
    write_trend,
)
from tallyframe.operators.compare import CUSTOM, FIRST_VS_LATEST, LATEST_VS_PREVIOUS
from tallyframe.operators.trend import collect_periods
from tallyframe.plans import Investigation, kpi_summary
from tallyframe.session import durable, scratch_path
from tallyframe.settings import KPI_NAMES, Settings
from tallyframe.sources import (
    malformed_counts,
    malformed_rows,
    preview,
    read_dataset,
    read_report,
    read_store,
    replace_months,
    write_report,
    write_store,
)
from tallyframe.sources.star import (
    EVENTS_SETTINGS,
    ORDERS_SETTINGS,
    SALES_SETTINGS,
    TEXT_SETTINGS,
    load,
    sales,
    text_orders,
)
from tallyframe.workload.oracles import SURFACE_SQL

Query = Callable[[SparkSession, str], DataFrame]

# Months compared by the queries that name their months.
PREVIOUS = "2001-06"
CURRENT = "2001-07"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events")


def orders_trend(kpi_name: str) -> Query:
    return lambda spark, sf_dir: kpi_trend(orders(spark, sf_dir), ORDERS_SETTINGS, kpi_name)


def sales_trend(kpi_name: str, *by: str) -> Query:
    return lambda spark, sf_dir: kpi_trend(sales(spark, sf_dir, *by), SALES_SETTINGS, kpi_name, by)


def orders_drivers(kpi_name: str, segment: str, *periods: str) -> Query:
    return lambda spark, sf_dir: segment_drivers(
        orders(spark, sf_dir), ORDERS_SETTINGS, kpi_name, segment, *periods
    )


def sales_drivers(kpi_name: str, segment: str, *periods: str) -> Query:
    return lambda spark, sf_dir: segment_drivers(
        sales(spark, sf_dir, segment, months=periods), SALES_SETTINGS, kpi_name, segment, *periods
    )


def compared(mode: str, *periods: str) -> Query:
    """Compare two months, reading only those; their names are looked up only where not given."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = orders(spark, sf_dir)
        chosen = periods
        if mode != CUSTOM or len(periods) < 2:
            chosen = comparison_periods(collect_periods(table, ORDERS_SETTINGS), mode, *periods)
        rows = filter_periods(table, ORDERS_SETTINGS.date_col, *chosen)
        return compare_periods(monthly_kpi(rows, ORDERS_SETTINGS, REVENUE), *chosen)

    return query


def compared_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sales(spark, sf_dir, "n_name", months=(PREVIOUS, CURRENT))
    trend = monthly_kpi(rows, SALES_SETTINGS, AOV, ["n_name"])
    return compare_periods(trend, PREVIOUS, CURRENT, ["n_name"])


def flat_profile(profile: DataFrame) -> DataFrame:
    """The profile with its name lists as text."""
    return profile.select(
        "rows",
        "columns",
        "missing_total",
        "duplicate_rows",
        *[
            F.concat_ws(",", name).alias(name)
            for name in ("column_names", "numeric_columns", "categorical_columns")
        ],
    )


def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, and rows that parse in the format found for the text dates."""
    table = text_orders(spark, sf_dir)
    typed = coerce_date(table, "order_date")
    month_first = format_hits(named("order_date"), date_shape(named("order_date")))[3]
    counts = typed.agg(
        F.count(F.lit(1)).alias("rows"), F.count("order_date").alias("dated_rows")
    )
    tested = table.agg(month_first.alias("month_first_rows"))
    return counts.unionByName(tested, allowMissingColumns=True).agg(
        F.max("rows").alias("rows"),
        F.max("dated_rows").alias("dated_rows"),
        F.max("month_first_rows").alias("month_first_rows"),
    )


def csv_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text orders written as CSV with NA for missing, and read back."""
    path = scratch_path(spark, "text-orders-csv")
    text_orders(spark, sf_dir).write.option("header", True).option("nullValue", "NA").csv(path)
    return read_dataset(spark, path, fmt="csv")


def ragged_csv(spark: SparkSession, sf_dir: str) -> str:
    """The orders as CSV text, by status with a field too many (F), one too few (O) or all of them (P)."""
    fields = ["o_orderkey", F.col("o_totalprice").cast("decimal(18,2)"), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd")]
    line = F.concat_ws(
        ",",
        *fields,
        F.when(F.col("o_orderstatus") == "P", "in full"),
        F.when(F.col("o_orderstatus") == "F", F.lit('"in, full",extra')),
    )
    path = scratch_path(spark, "ragged")
    header = "order_id,amount,amount,order_date,note"
    orders(spark, sf_dir).select(line.alias(header)).write.option("header", True).option(
        "quote", ""
    ).option("sep", "\x01").csv(path)
    return path


def ragged_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of the rows that are left when those with a field too many are dropped."""
    rows = read_dataset(spark, ragged_csv(spark, sf_dir), fmt="csv", malformed="drop")
    return kpi_trend(rows, Settings("order_date", "amount", "order_id"), REVENUE)


def csv_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred types and missing values of the CSV copy."""
    return profile_columns(csv_copy(spark, sf_dir)).select(
        "column_name", "data_type", "missing_values", "is_date_like", "date_format"
    )


def distinct_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each estimate of distinct values is within 15 % of the exact number."""
    table = orders(spark, sf_dir)
    estimates = profile_columns(table, distinct_estimates=True).select("column_name", "approx_distinct")
    exact = None
    for name in table.columns:
        row = table.agg(F.count_distinct(named(name)).alias("exact")).select(F.lit(name).alias("column_name"), "exact")
        exact = row if exact is None else exact.unionByName(row)
    near = F.abs(F.col("approx_distinct") - F.col("exact")) <= 0.15 * F.col("exact")
    return estimates.join(exact, "column_name").select("column_name", near.alias("is_near"))


def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = ["o_orderpriority", "o_orderstatus"]
    return driver_extremes(
        drivers_all_segments(
            orders(spark, sf_dir),
            ORDERS_SETTINGS,
            REVENUE,
            segments,
            PREVIOUS,
            CURRENT,
            ordered=False,
        )
    )


def sample_sql(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = sample_queries(ORDERS_SETTINGS, "o_orderpriority")
        return run_sql(orders(spark, sf_dir), texts[name])

    return query


def surface_sql(name: str) -> Query:
    return lambda spark, sf_dir: run_sql(orders(spark, sf_dir), SURFACE_SQL[name])


def quoted_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query text with double-quoted names and strftime."""
    return run_sql(
        orders(spark, sf_dir).withColumnRenamed("o_orderdate", "Order Date"),
        """
        SELECT strftime(CAST("Order Date" AS DATE), '%Y-%m') AS month,
               ROUND(SUM("o_totalprice"), 2) AS total_revenue
        FROM sales_data GROUP BY month ORDER BY month;
        """,
        select_only=True,
        double_quotes=True,
    )


def summary(kpi_name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = orders(spark, sf_dir)
        rows = filter_periods(table, ORDERS_SETTINGS.date_col, PREVIOUS, CURRENT)
        change = compare_periods(monthly_kpi(rows, ORDERS_SETTINGS, kpi_name), PREVIOUS, CURRENT)
        drivers = segment_drivers(
            table,
            ORDERS_SETTINGS,
            kpi_name,
            "o_orderpriority",
            PREVIOUS,
            CURRENT,
            ordered=False,
        )
        return kpi_summary(change, kpi_name, drivers)

    return query


def summary_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary per region from one comparison and one driver job over two months."""
    regional = sales(spark, sf_dir, "r_name", months=(PREVIOUS, CURRENT))
    trend = monthly_kpi(regional, SALES_SETTINGS, REVENUE, ["r_name"])
    change = compare_periods(trend, PREVIOUS, CURRENT, ["r_name"])
    drivers = segment_drivers(
        sales(spark, sf_dir, "r_name", "p_brand", months=(PREVIOUS, CURRENT)),
        SALES_SETTINGS,
        REVENUE,
        "p_brand",
        PREVIOUS,
        CURRENT,
        ["r_name"],
        ordered=False,
    )
    return kpi_summary(change, REVENUE, drivers, ["r_name"])


def single_month_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi_summary(
        latest_change(monthly_kpi(events(spark, sf_dir), EVENTS_SETTINGS, REVENUE)), REVENUE
    )


def report_values(report: DataFrame, *keys: str) -> DataFrame:
    """Report rows with all fields of their payloads: label, numbers, flag and direction."""

    def field(*names: str):
        return F.coalesce(*[F.get_json_object("payload", f"$.{name}") for name in names])

    return report.select(
        *keys,
        "section",
        F.col("row_no").cast("int").alias("row_no"),
        field("segment", "period", "current_period", "summary", "kpi_name").alias("label"),
        field("z_score", "forecast_value", "absolute_change", "kpi_value")
        .cast("double")
        .alias("number"),
        *[
            field(name).cast("double").alias(name)
            for name in ("previous_value", "current_value", "percent_change", "mean_value")
        ],
        *[field(name).alias(name) for name in ("previous_period", "segment_column", "is_anomaly")],
        field("direction", "anomaly_direction").alias("direction"),
    )


def orders_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Investigation(
        orders(spark, sf_dir), ORDERS_SETTINGS, REVENUE, "o_orderpriority", PREVIOUS, CURRENT
    ).report


def sales_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Investigation(
        sales(spark, sf_dir),
        SALES_SETTINGS,
        AOV,
        "r_name",
        PREVIOUS,
        CURRENT,
        segment_rows=lambda *months: sales(spark, sf_dir, "r_name", months=months),
    ).report


def summary_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary for each customer; most bought in one of the two months only."""
    rows = filter_periods(orders(spark, sf_dir), ORDERS_SETTINGS.date_col, PREVIOUS, CURRENT)
    trend = monthly_kpi(rows, ORDERS_SETTINGS, REVENUE, ["o_custkey"])
    change = compare_periods(trend, PREVIOUS, CURRENT, ["o_custkey"])
    return kpi_summary(change, REVENUE, by=["o_custkey"])


def customer_investigation(spark: SparkSession, sf_dir: str) -> Investigation:
    """One investigation of every customer, each in the months in which it bought."""
    table, by = orders(spark, sf_dir), ["o_custkey"]
    return Investigation(table, ORDERS_SETTINGS, REVENUE, "o_orderpriority", by=by)


def written_customer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the customers' reports, written and read back."""
    path, table = scratch_path(spark, "customer-report"), orders(spark, sf_dir)
    found = Investigation(table, ORDERS_SETTINGS, REVENUE, "o_orderpriority", by=["o_custkey"], report_rows=2)
    write_report(found.report, path)
    return report_values(read_report(spark, path, keys="o_custkey bigint"), "o_custkey")


def own_months_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary for each customer from the last two months in which it bought, with drivers of the same months."""
    table, by = orders(spark, sf_dir), ["o_custkey"]
    trend = durable(monthly_kpi(table, ORDERS_SETTINGS, REVENUE, by))
    drivers = segment_drivers(
        table,
        ORDERS_SETTINGS,
        REVENUE,
        "o_orderpriority",
        by=by,
        ordered=False,
        months=series_months(trend, by),
    )
    return kpi_summary(compare_series(trend, by), REVENUE, drivers, by)


# Phrases that, by conversation, are put after the texts so that every tag occurs (see FIXTURES.md).
PHRASES = (
    "",
    " Why did revenue drop?",
    " Which region drove the change?",
    " Are there any unusual revenue anomalies?",
    " Forecast revenue for the next few months.",
    " Give me a business summary of performance.",
    " Run an SQL query, then compare",
)


def phrased_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("conv_id") % len(PHRASES) + 1).cast("int"))
    asked = load(spark, sf_dir, "conversations").withColumn("text", F.concat("text", phrase))
    tags = tag_questions(asked, "text")
    return tags.select("conv_id", "turn", F.array_join("analyses", ",").alias("analyses"))


def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    write_report(orders_report(spark, sf_dir), path)
    return report_values(read_report(spark, path))


def tagged(table: str, text_col: str, *keys: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tags = tag_questions(load(spark, sf_dir, table), text_col)
        return tags.select(*keys, F.array_join("analyses", ",").alias("analyses"))

    return query


def formatted_kpis(kpi_name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        trend = monthly_kpi(orders(spark, sf_dir), ORDERS_SETTINGS, kpi_name)
        return trend.select(
            "period", format_kpi_value(F.col("kpi_value"), kpi_name).alias("kpi_text")
        )

    return query


def rows_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = with_period(events(spark, sf_dir), "ts")
    return table.groupBy("period", "event_type").agg(F.count(F.lit(1)).alias("n_rows"))


def row_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders KPI without an order column: rows per month."""
    return kpi_trend(sales(spark, sf_dir), Settings("l_shipdate", "net_revenue"), ORDERS)


def stored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with text dates, stored typed by month."""
    path = scratch_path(spark, "store")
    write_store(text_orders(spark, sf_dir), TEXT_SETTINGS, path, ["channel"])
    return read_store(spark, path)


def store_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_periods(stored_orders(spark, sf_dir), TEXT_SETTINGS.date_col, PREVIOUS, CURRENT)
    return compare_periods(monthly_kpi(rows, TEXT_SETTINGS, AOV), PREVIOUS, CURRENT)


def late_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All KPIs by status, kept by month and refreshed after orders of one month came late."""
    table, by = orders(spark, sf_dir), ["o_orderstatus"]
    store, kept = scratch_path(spark, "store"), scratch_path(spark, "trend")
    late = filter_periods(table, ORDERS_SETTINGS.date_col, CURRENT).filter("o_orderkey % 2 = 0")
    write_store(table.join(late.select("o_orderkey"), "o_orderkey", "left_anti"), ORDERS_SETTINGS, store, by)
    write_trend(read_store(spark, store), ORDERS_SETTINGS, kept, by=by)
    replace_months(table, ORDERS_SETTINGS, store, [CURRENT], by)
    refresh_trend(read_store(spark, store), ORDERS_SETTINGS, kept, [CURRENT], by=by)
    return read_trend(spark, kept, by=by)


def all_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_kpis(sales(spark, sf_dir), SALES_SETTINGS, KPI_NAMES)


def rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by status from the state by status, priority and month, and how the estimates of orders do.

    Orders are counted by customer, of which many order in several months and priorities.
    """
    settings = Settings("o_orderdate", "o_totalprice", "o_custkey")
    state = durable(kpi_state(orders(spark, sf_dir), settings, ["o_orderstatus", "o_orderpriority"]))
    found = roll_up(state, ["o_orderstatus"]).select("o_orderstatus", REVENUE, ORDERS)
    exact = orders(spark, sf_dir).groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("exact"))
    off = F.abs(F.col(ORDERS) - F.col("exact")) / F.col("exact")
    near = (off <= 3 * estimate_error()).alias("is_near")
    return found.join(exact, "o_orderstatus").select("o_orderstatus", F.col(REVENUE).alias("revenue"), near)


ALL_QUERIES: dict[str, Query] = {
    # KPI trends
    "trend_revenue": orders_trend(REVENUE),
    "trend_orders": orders_trend(ORDERS),
    "trend_aov": orders_trend(AOV),
    "trend_revenue_sales": sales_trend(REVENUE),
    "trend_orders_sales": sales_trend(ORDERS),
    "trend_aov_sales": sales_trend(AOV),
    "trend_rows_sales": row_orders,
    "trend_by_segment": sales_trend(REVENUE, "r_name"),
    "trend_aov_by_segment": sales_trend(AOV, "c_mktsegment"),
    "trend_text_dates": lambda spark, sf_dir: kpi_trend(
        text_orders(spark, sf_dir), TEXT_SETTINGS, REVENUE
    ),
    "trend_csv": lambda spark, sf_dir: kpi_trend(csv_copy(spark, sf_dir), TEXT_SETTINGS, AOV),
    "list_periods": lambda spark, sf_dir: list_periods(orders(spark, sf_dir), ORDERS_SETTINGS),
    "rows_per_period": rows_per_period,
    "formatted_revenue": formatted_kpis(REVENUE),
    "formatted_orders": formatted_kpis(ORDERS),
    # Changes
    "latest_change": lambda spark, sf_dir: latest_change(
        monthly_kpi(orders(spark, sf_dir), ORDERS_SETTINGS, REVENUE)
    ),
    "latest_change_by_segment": lambda spark, sf_dir: latest_change(
        monthly_kpi(sales(spark, sf_dir, "n_name"), SALES_SETTINGS, ORDERS, ["n_name"]), ["n_name"]
    ),
    "latest_change_single_period": lambda spark, sf_dir: latest_change(
        monthly_kpi(events(spark, sf_dir), EVENTS_SETTINGS, REVENUE)
    ),
    "period_changes": lambda spark, sf_dir: period_changes(
        monthly_kpi(orders(spark, sf_dir), ORDERS_SETTINGS, AOV)
    ),
    "compare_latest_previous": compared(LATEST_VS_PREVIOUS),
    "compare_first_latest": compared(FIRST_VS_LATEST),
    "compare_custom": compared(CUSTOM, PREVIOUS, CURRENT),
    "compare_by_segment": compared_series,
    "compare_own_months": lambda spark, sf_dir: compare_series(
        monthly_kpi(orders(spark, sf_dir), ORDERS_SETTINGS, ORDERS, ["o_custkey"]),
        ["o_custkey"],
        FIRST_VS_LATEST,
    ),
    # Drivers
    "drivers_latest": orders_drivers(REVENUE, "o_orderpriority"),
    "drivers_priority_revenue": orders_drivers(REVENUE, "o_orderpriority", PREVIOUS, CURRENT),
    "drivers_status_orders": orders_drivers(ORDERS, "o_orderstatus", PREVIOUS, CURRENT),
    "drivers_region_aov": sales_drivers(AOV, "r_name", PREVIOUS, CURRENT),
    "drivers_brand_revenue": sales_drivers(REVENUE, "p_brand", PREVIOUS, CURRENT),
    "drivers_absent_period": orders_drivers(REVENUE, "o_orderstatus", "1990-01", CURRENT),
    "drivers_single_period": lambda spark, sf_dir: segment_drivers(
        events(spark, sf_dir), EVENTS_SETTINGS, REVENUE, "event_type"
    ),
    "drivers_all": lambda spark, sf_dir: drivers_all_segments(
        sales(spark, sf_dir, "r_name", "c_mktsegment", "p_brand", months=(PREVIOUS, CURRENT)),
        SALES_SETTINGS,
        ORDERS,
        ["r_name", "c_mktsegment", "p_brand"],
        PREVIOUS,
        CURRENT,
    ),
    "driver_extremes": extremes,
    "drivers_null_segment": lambda spark, sf_dir: segment_drivers(
        text_orders(spark, sf_dir), TEXT_SETTINGS, REVENUE, "channel", PREVIOUS, CURRENT
    ),
    "drivers_own_months": lambda spark, sf_dir: segment_drivers(
        orders(spark, sf_dir), ORDERS_SETTINGS, AOV, "o_orderpriority", by=["o_custkey"]
    ),
    "drivers_all_own_months": lambda spark, sf_dir: drivers_all_segments(
        orders(spark, sf_dir),
        ORDERS_SETTINGS,
        REVENUE,
        ["o_orderpriority", "o_orderstatus"],
        by=["o_custkey"],
    ),
    # Anomalies and forecast
    "anomalies_revenue": lambda spark, sf_dir: detect_anomalies(
        monthly_kpi(orders(spark, sf_dir), ORDERS_SETTINGS, REVENUE)
    ),
    "anomalies_by_segment": lambda spark, sf_dir: detect_anomalies(
        monthly_kpi(sales(spark, sf_dir, "n_name"), SALES_SETTINGS, REVENUE, ["n_name"]),
        by=["n_name"],
    ),
    "anomalies_single_period": lambda spark, sf_dir: detect_anomalies(
        monthly_kpi(events(spark, sf_dir), EVENTS_SETTINGS, REVENUE)
    ),
    "anomaly_count": lambda spark, sf_dir: anomaly_count(
        detect_anomalies(monthly_kpi(orders(spark, sf_dir), ORDERS_SETTINGS, ORDERS))
    ),
    "linear_fit": lambda spark, sf_dir: linear_fit(
        monthly_kpi(orders(spark, sf_dir), ORDERS_SETTINGS, ORDERS)
    ).select(
        F.round("slope", 6).alias("slope"),
        F.round("intercept", 6).alias("intercept"),
        "months",
        "last_period",
    ),
    "forecast_revenue": lambda spark, sf_dir: forecast_kpi(
        monthly_kpi(orders(spark, sf_dir), ORDERS_SETTINGS, REVENUE)
    ),
    "forecast_by_segment": lambda spark, sf_dir: forecast_kpi(
        monthly_kpi(sales(spark, sf_dir, "n_name"), SALES_SETTINGS, REVENUE, ["n_name"]),
        steps=6,
        by=["n_name"],
    ),
    # Several KPIs from one scan
    "trend_all_kpis": all_kpis,
    "change_all_kpis": lambda spark, sf_dir: latest_change(all_kpis(spark, sf_dir), ["kpi_name"]),
    "anomalies_all_kpis": lambda spark, sf_dir: detect_anomalies(
        all_kpis(spark, sf_dir), by=["kpi_name"]
    ),
    "forecast_all_kpis": lambda spark, sf_dir: forecast_kpi(
        all_kpis(spark, sf_dir), by=["kpi_name"]
    ),
    # Stored and kept tables
    "store_drivers": lambda spark, sf_dir: segment_drivers(
        stored_orders(spark, sf_dir), TEXT_SETTINGS, REVENUE, "channel", PREVIOUS, CURRENT
    ),
    "store_compare": store_compared,
    "store_profile": lambda spark, sf_dir: profile_columns(stored_orders(spark, sf_dir)).select(
        "column_name", "missing_values", "is_date_like"
    ),
    "trend_refreshed": late_orders,
    "orders_rolled_up": rolled_up,
    # Profile
    "profile_dataset": lambda spark, sf_dir: flat_profile(
        profile_dataset(load(spark, sf_dir, "lineitem"))
    ),
    "profile_duplicates": lambda spark, sf_dir: flat_profile(
        profile_dataset(text_orders(spark, sf_dir))
    ),
    "profile_columns": lambda spark, sf_dir: profile_columns(load(spark, sf_dir, "lineitem")),
    "profile_text_columns": lambda spark, sf_dir: profile_columns(text_orders(spark, sf_dir)),
    "distinct_estimates": distinct_estimates,
    "date_formats": date_formats,
    "csv_schema": csv_schema,
    "csv_malformed": lambda spark, sf_dir: malformed_counts(
        malformed_rows(spark, ragged_csv(spark, sf_dir))
    ),
    "csv_malformed_dropped": ragged_trend,
    "quality_notes": lambda spark, sf_dir: quality_notes(
        profile_dataset(text_orders(spark, sf_dir))
    ),
    "preview": lambda spark, sf_dir: preview(orders(spark, sf_dir).orderBy("o_orderkey")),
    # SQL
    "sql_monthly_revenue": sample_sql("Monthly revenue"),
    "sql_revenue_by_segment": sample_sql("Revenue by o_orderpriority"),
    "sql_orders_by_segment": sample_sql("Orders by o_orderpriority"),
    "sql_preview": lambda spark, sf_dir: run_sql(
        orders(spark, sf_dir).orderBy("o_orderkey"),
        sample_queries(ORDERS_SETTINGS, "o_orderstatus")["Preview data"],
    ),
    "sql_quoted_names": quoted_sql,
    "kpi_by_segment_revenue": lambda spark, sf_dir: kpi_by_segment(
        text_orders(spark, sf_dir), TEXT_SETTINGS, REVENUE, "channel"
    ),
    "kpi_by_segment_orders": lambda spark, sf_dir: kpi_by_segment(
        text_orders(spark, sf_dir), TEXT_SETTINGS, ORDERS, "channel"
    ),
    "kpi_by_segment_aov": lambda spark, sf_dir: kpi_by_segment(
        sales(spark, sf_dir, "n_name"), SALES_SETTINGS, AOV, "n_name"
    ),
    **{name: surface_sql(name) for name in SURFACE_SQL},
    # Narrative and report
    "kpi_summary": summary(REVENUE),
    "kpi_summary_orders": summary(ORDERS),
    "kpi_summary_by_region": summary_by_region,
    "kpi_summary_by_customer": summary_by_customer,
    "kpi_summary_own_months": own_months_summary,
    "kpi_summary_single_period": single_month_summary,
    "investigation_steps": lambda spark, sf_dir: Investigation(
        text_orders(spark, sf_dir), TEXT_SETTINGS, REVENUE
    ).steps,
    "report_bundle": lambda spark, sf_dir: report_values(orders_report(spark, sf_dir)),
    "report_written": written_report,
    "investigation_steps_by_customer": lambda spark, sf_dir: customer_investigation(
        spark, sf_dir
    ).steps,
    "report_by_customer": lambda spark, sf_dir: report_values(
        customer_investigation(spark, sf_dir).report, "o_custkey"
    ),
    "report_by_customer_written": written_customer_report,
    "report_sales": lambda spark, sf_dir: report_values(sales_report(spark, sf_dir)),
    # Question tagging
    "tag_conversations": tagged("conversations", "text", "conv_id", "turn"),
    "tag_phrases": phrased_tags,
    "tag_documents": tagged("documents", "text", "doc_id"),
}
