"""Reference SQL (DuckDB) for the registered queries.

Written from the definitions of the analyses, independently of the Spark code, but for two things:
the texts in ``SURFACE_SQL`` are run as they are by both engines, and the word lists of the question tags
are shared (``tag_phrases`` states its tags one by one). Estimates of distinct values are compared with exact
counts by their queries; the SQL only expects them to be near.
"""

from __future__ import annotations

from tallyframe.operators.tagging import (
    ANOMALY_WORDS,
    CHANGE_WORDS,
    FORECAST_WORDS,
    ROOT_CAUSE_WORDS,
    SQL_WORDS,
    SUMMARY_WORDS,
)

# SQL that users may send to run_sql, over the orders as sales_data. Keys are made
# distinct before they are matched, so that a hot key is combined before the shuffle.
SURFACE_SQL = {
    "sql_self_join": """
        WITH months AS (
          SELECT EXTRACT(YEAR FROM o_orderdate) * 12 + EXTRACT(MONTH FROM o_orderdate) AS month_no,
                 SUM(o_totalprice) AS revenue
          FROM sales_data
          GROUP BY EXTRACT(YEAR FROM o_orderdate) * 12 + EXTRACT(MONTH FROM o_orderdate)
        )
        SELECT CAST(a.month_no AS BIGINT) AS month_no, ROUND(a.revenue, 2) AS revenue,
               ROUND(b.revenue, 2) AS revenue_year_before
        FROM months a JOIN months b ON a.month_no = b.month_no + 12
    """,
    "sql_left_join": """
        SELECT p.o_orderpriority, COUNT(*) AS n_rows, COUNT(c.o_custkey) AS n_matched
        FROM sales_data p
        LEFT JOIN (SELECT DISTINCT o_custkey FROM sales_data WHERE o_orderstatus = 'P') c
          ON p.o_custkey = c.o_custkey
        GROUP BY p.o_orderpriority
    """,
    "sql_exists": """
        SELECT o_orderstatus, COUNT(*) AS n_orders FROM sales_data s
        WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM sales_data
                                     WHERE o_orderpriority = '1-URGENT') u
                      WHERE u.o_custkey = s.o_custkey)
        GROUP BY o_orderstatus
    """,
    "sql_not_exists": """
        SELECT o_orderpriority, COUNT(*) AS n_orders FROM sales_data s
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM sales_data
                                         WHERE o_orderstatus = 'F') u
                          WHERE u.o_custkey = s.o_custkey)
        GROUP BY o_orderpriority
    """,
    "sql_scalar_subquery": """
        SELECT o_orderpriority, COUNT(*) AS n_large FROM sales_data
        WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM sales_data)
        GROUP BY o_orderpriority
    """,
    "sql_window_rank": """
        WITH sums AS (
          SELECT EXTRACT(YEAR FROM o_orderdate) AS y, o_orderpriority, SUM(o_totalprice) AS revenue
          FROM sales_data GROUP BY EXTRACT(YEAR FROM o_orderdate), o_orderpriority
        )
        SELECT CAST(y AS BIGINT) AS year_no, o_orderpriority, ROUND(revenue, 2) AS revenue,
               CAST(RANK() OVER (PARTITION BY y ORDER BY revenue DESC) AS BIGINT) AS revenue_rank,
               ROUND(100 * revenue / SUM(revenue) OVER (PARTITION BY y), 2) AS revenue_share
        FROM sums
    """,
    "sql_union": """
        SELECT o_custkey FROM sales_data WHERE o_orderstatus = 'F'
        UNION
        SELECT o_custkey FROM sales_data WHERE o_orderpriority = '2-HIGH'
    """,
    "sql_union_all": """
        SELECT part, COUNT(*) AS n_rows FROM (
          SELECT o_orderstatus AS part FROM sales_data
          UNION ALL
          SELECT o_orderpriority AS part FROM sales_data
        ) parts GROUP BY part
    """,
    "sql_intersect": """
        SELECT DISTINCT o_custkey FROM sales_data WHERE o_orderstatus = 'F'
        INTERSECT
        SELECT DISTINCT o_custkey FROM sales_data WHERE o_orderstatus = 'O'
    """,
    "sql_except": """
        SELECT DISTINCT o_custkey FROM sales_data WHERE o_orderstatus = 'F'
        EXCEPT
        SELECT DISTINCT o_custkey FROM sales_data WHERE o_orderpriority = '1-URGENT'
    """,
    "sql_rollup": """
        SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n_orders,
               ROUND(SUM(o_totalprice), 2) AS revenue
        FROM sales_data GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
    """,
    "sql_cube": """
        SELECT o_orderstatus, o_orderpriority, COUNT(DISTINCT o_custkey) AS n_customers
        FROM sales_data GROUP BY CUBE (o_orderstatus, o_orderpriority)
    """,
    "sql_grouping_sets": """
        SELECT o_orderstatus, o_orderpriority, ROUND(AVG(o_totalprice), 2) AS mean_price
        FROM sales_data GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
    """,
    "sql_having_topk": """
        SELECT o_custkey, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS revenue
        FROM sales_data GROUP BY o_custkey HAVING COUNT(*) > 5
        ORDER BY revenue DESC, o_custkey LIMIT 20
    """,
    "sql_case_filter": """
        SELECT o_orderpriority,
               ROUND(SUM(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS f_revenue,
               COUNT(*) FILTER (WHERE o_totalprice BETWEEN 100000 AND 200000) AS n_middle
        FROM sales_data WHERE o_orderpriority LIKE '%-%' GROUP BY o_orderpriority
    """,
}

# Sources: a table expression with the columns day, revenue, order_id and segments.
ORDERS_ROWS = """(SELECT o_orderdate AS day, o_totalprice AS revenue, o_orderkey AS order_id,
  o_orderpriority, o_orderstatus FROM orders)"""
CUSTOMER_ROWS = """(SELECT o_orderdate AS day, o_totalprice AS revenue, o_orderkey AS order_id,
  o_orderpriority, o_orderstatus, o_custkey FROM orders)"""
EVENTS_ROWS = "(SELECT ts AS day, value AS revenue, event_id AS order_id, event_type FROM events)"
SALES_ROWS = """(SELECT l_shipdate AS day, l_extendedprice * (1 - l_discount) AS revenue,
  l_orderkey AS order_id, c_mktsegment, n_name, r_name, p_brand
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
TEXT_ONCE = """SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS day,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown'
       ELSE strftime(o_orderdate, '%-m/%-d/%Y') END AS order_date,
  o_orderkey AS order_id, o_totalprice AS revenue,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS channel,
  o_orderpriority AS "order priority" FROM orders"""
TEXT_ROWS = f"""({TEXT_ONCE} UNION ALL
  SELECT * FROM ({TEXT_ONCE}) urgent WHERE "order priority" = '1-URGENT')"""

# Values have 9 decimals, as decimals their sums are exact.
TOTAL = "CAST(CAST(sum(CAST(revenue AS DECIMAL(38, 9))) AS VARCHAR) AS DOUBLE)"
KPI = {
    "Revenue": f"coalesce({TOTAL}, 0.0)",
    "Orders": "CAST(count(DISTINCT order_id) AS DOUBLE)",
    "Average Order Value": f"coalesce({TOTAL} / nullif(count(DISTINCT order_id), 0), 0.0)",
}
ROWS_KPI = "CAST(count(*) AS DOUBLE)"


def r2(value: str) -> str:
    """Rounded to 2 decimals, halves of the shortest decimal form away from zero; adding 0.0 removes a negative zero."""
    return f"(CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 12)), 2) AS DOUBLE) + 0.0)"


def exact(total: str) -> str:
    """The double nearest to a decimal."""
    return f"CAST(CAST({total} AS VARCHAR) AS DOUBLE)"


def listed(names: tuple[str, ...]) -> str:
    return "".join(f"{name}, " for name in names)


def trend(rows: str, kpi_name: str, *by: str, value: str | None = None) -> str:
    return f"""SELECT {listed(by)}strftime(day, '%Y-%m') AS period, '{kpi_name}' AS kpi_name,
      {r2(value or KPI[kpi_name])} AS kpi_value
      FROM {rows} base WHERE day IS NOT NULL GROUP BY ALL"""


def percent(previous: str, current: str) -> str:
    return r2(f"({current} - {previous}) / nullif({previous}, 0) * 100")


def changes(trend_sql: str, *by: str) -> str:
    parts = f"PARTITION BY {', '.join(by)} " if by else ""
    return f"""SELECT {listed(by)}period AS current_period,
        lag(period) OVER w AS previous_period,
        kpi_value AS current_value, lag(kpi_value) OVER w AS previous_value,
        {r2('kpi_value - lag(kpi_value) OVER w')} AS absolute_change,
        {percent('lag(kpi_value) OVER w', 'kpi_value')} AS percent_change
      FROM ({trend_sql}) t WINDOW w AS ({parts}ORDER BY period)"""


def latest(trend_sql: str, *by: str) -> str:
    """Last change per series; a series of one month gives NULLs."""
    parts = f"PARTITION BY {', '.join(by)} " if by else ""
    blank = ", ".join(
        f"CASE WHEN previous_period IS NOT NULL THEN {field} END AS {field}"
        for field in (
            "current_period",
            "current_value",
            "previous_value",
            "absolute_change",
            "percent_change",
        )
    )
    return f"""SELECT {listed(by)}previous_period, {blank} FROM (
        SELECT *, row_number() OVER ({parts}ORDER BY current_period DESC) AS back
        FROM ({changes(trend_sql, *by)}) c) d WHERE back = 1"""


FIRST_PERIOD = "(SELECT min(strftime(day, '%Y-%m')) FROM {rows} b WHERE day IS NOT NULL)"
LAST_PERIOD = "(SELECT max(strftime(day, '%Y-%m')) FROM {rows} b WHERE day IS NOT NULL)"
PREVIOUS_PERIOD = """(SELECT max(strftime(day, '%Y-%m')) FROM {rows} b
  WHERE strftime(day, '%Y-%m') < (SELECT max(strftime(day, '%Y-%m')) FROM {rows} b2))"""


def compare(rows: str, kpi_name: str, previous: str, current: str, *by: str) -> str:
    """``previous`` and ``current`` are SQL expressions."""
    group = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""SELECT {listed(by)}previous_period, current_period, previous_value, current_value,
        {r2('current_value - previous_value')} AS absolute_change,
        {percent('previous_value', 'current_value')} AS percent_change,
        CASE WHEN current_value > previous_value THEN 'increased'
             WHEN current_value < previous_value THEN 'decreased'
             WHEN current_value = previous_value THEN 'stayed flat' END AS direction
      FROM (SELECT {listed(by)}{previous} AS previous_period, {current} AS current_period,
              max(kpi_value) FILTER (WHERE period = {previous}) AS previous_value,
              max(kpi_value) FILTER (WHERE period = {current}) AS current_value
            FROM ({trend(rows, kpi_name, *by)}) t
            WHERE period IN ({previous}, {current}) {group}) c"""


def drivers(
    rows: str, kpi_name: str, segment: str, previous: str, current: str, *by: str
) -> str:
    return f"""SELECT {listed(by)}'{segment}' AS segment_column, segment,
        {previous} AS previous_period, {current} AS current_period,
        {r2('a')} AS previous_value, {r2('b')} AS current_value,
        {r2('b - a')} AS absolute_change, {percent('a', 'b')} AS percent_change
      FROM (SELECT {listed(by)}segment,
              coalesce(max(v) FILTER (WHERE period = {previous}), 0.0) AS a,
              coalesce(max(v) FILTER (WHERE period = {current}), 0.0) AS b
            FROM (SELECT {listed(by)}{segment} AS segment, strftime(day, '%Y-%m') AS period,
                    {KPI[kpi_name]} AS v
                  FROM {rows} base
                  WHERE day IS NOT NULL AND {segment} IS NOT NULL GROUP BY ALL) g
            WHERE period IN ({previous}, {current}) GROUP BY ALL) s"""


def own_months(rows: str, by: str, back: int = 2) -> str:
    """The months of each series that has two: its last, and the one before or (0) its first."""
    other = "min(period)" if back == 0 else f"max(period) FILTER (WHERE back = {back})"
    return f"""SELECT {by}, {other} AS previous_period, max(period) AS current_period
      FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY period DESC) AS back
            FROM (SELECT DISTINCT {by}, strftime(day, '%Y-%m') AS period FROM {rows} base) p) r
      GROUP BY {by} HAVING count(*) >= 2"""


def own_drivers(rows: str, kpi_name: str, segment: str, by: str) -> str:
    return f"""SELECT {by}, '{segment}' AS segment_column, segment, previous_period, current_period,
        {r2('a')} AS previous_value, {r2('b')} AS current_value,
        {r2('b - a')} AS absolute_change, {percent('a', 'b')} AS percent_change
      FROM (SELECT {by}, segment, previous_period, current_period,
              coalesce(max(v) FILTER (WHERE period = previous_period), 0.0) AS a,
              coalesce(max(v) FILTER (WHERE period = current_period), 0.0) AS b
            FROM (SELECT {by}, {segment} AS segment, strftime(day, '%Y-%m') AS period, {KPI[kpi_name]} AS v
                  FROM {rows} base GROUP BY ALL) g
              JOIN ({own_months(rows, by)}) m USING ({by})
            WHERE period IN (previous_period, current_period) GROUP BY ALL) s"""


def own_compare(rows: str, kpi_name: str, by: str, back: int = 2) -> str:
    return f"""SELECT {by}, previous_period, current_period, previous_value, current_value,
        {r2('current_value - previous_value')} AS absolute_change,
        {percent('previous_value', 'current_value')} AS percent_change,
        CASE WHEN current_value > previous_value THEN 'increased'
             WHEN current_value < previous_value THEN 'decreased'
             WHEN current_value = previous_value THEN 'stayed flat' END AS direction
      FROM (SELECT {by}, previous_period, current_period,
              max(kpi_value) FILTER (WHERE period = previous_period) AS previous_value,
              max(kpi_value) FILTER (WHERE period = current_period) AS current_value
            FROM ({trend(rows, kpi_name, by)}) t LEFT JOIN ({own_months(rows, by, back)}) m USING ({by})
            GROUP BY ALL) c"""


def anomalies(trend_sql: str, *by: str, threshold: float = 1.5) -> str:
    parts = f"PARTITION BY {', '.join(by)}" if by else ""
    return f"""SELECT *, abs(z_score) >= {threshold} AND spread > 0 IS TRUE AS flagged FROM (
        SELECT *, CASE WHEN spread > 0 THEN {r2('(kpi_value - mean) / spread')}
          ELSE 0.0 END AS z_score
        FROM (SELECT *, {exact(f"sum(CAST(kpi_value AS DECIMAL(38, 2))) OVER ({parts})")}
                / count(*) OVER ({parts}) AS mean,
                stddev_samp(kpi_value) OVER ({parts}) AS spread
              FROM ({trend_sql}) t) m) z"""


def anomaly_table(trend_sql: str, *by: str, threshold: float = 1.5) -> str:
    return f"""SELECT {listed(by)}period, kpi_name, kpi_value, {r2('mean')} AS mean_value, z_score,
        flagged AS is_anomaly,
        CASE WHEN flagged AND z_score > 0 THEN 'unusually high'
             WHEN flagged THEN 'unusually low' ELSE 'normal' END AS anomaly_direction
      FROM ({anomalies(trend_sql, *by, threshold=threshold)}) f"""


def fit(trend_sql: str, *by: str) -> str:
    parts = f"PARTITION BY {', '.join(by)} " if by else ""
    return f"""SELECT {listed(by)}regr_slope(kpi_value, x) AS slope,
        regr_intercept(kpi_value, x) AS intercept, count(*) AS months, max(period) AS last_period,
        {exact('sum(CAST(kpi_value AS DECIMAL(38, 2)))')} AS y, {exact('sum(CAST(kpi_value AS DECIMAL(38, 2)) * x)')} AS xy
      FROM (SELECT *, row_number() OVER ({parts}ORDER BY period) - 1 AS x FROM ({trend_sql}) t) n
      GROUP BY ALL HAVING count(*) >= 2"""


def forecast(trend_sql: str, steps: int, *by: str) -> str:
    """The line's value as one fraction of the sums; n is the number of months."""
    n = "CAST(months AS DOUBLE)"
    line = f"(y * ({n} * {n} - 1) + 3 * (2 * xy - ({n} - 1) * y) * (2 * ({n} + step - 1) - ({n} - 1))) / ({n} * ({n} * {n} - 1))"
    return f"""SELECT {listed(by)}strftime(CAST(last_period || '-01' AS DATE)
          + to_months(CAST(step AS INTEGER)), '%Y-%m') AS period,
        {r2(line)} AS forecast_value
      FROM (SELECT *, unnest(range(1, {steps + 1})) AS step FROM ({fit(trend_sql, *by)}) f) s"""


def money(value: str) -> str:
    return f"format('${{:,.2f}}', {value})"


def whole(value: str) -> str:
    return f"format('{{:,.0f}}', {value})"


def kpi_text(value: str, kpi_name: str) -> str:
    return whole(value) if kpi_name == "Orders" else money(value)


def extremes_of(drivers_sql: str, *by: str) -> str:
    return f"""SELECT {listed(by)}segment_column,
        arg_min(segment, (absolute_change, segment)) AS low_segment,
        min(absolute_change) AS low_change,
        arg_max(segment, (absolute_change, segment)) AS high_segment,
        max(absolute_change) AS high_change
      FROM ({drivers_sql}) d GROUP BY ALL"""


def summary(compare_sql: str, drivers_sql: str, kpi_name: str, *by: str) -> str:
    join = "USING (" + ", ".join(by) + ")" if by else "ON TRUE"
    return f"""SELECT {listed(by)}'{kpi_name} ' || direction || ' from '
        || {kpi_text('previous_value', kpi_name)} || ' in ' || previous_period || ' to '
        || {kpi_text('current_value', kpi_name)} || ' in ' || current_period || '.'
        || coalesce(' This represents a ' || format('{{:.2f}}', percent_change) || '% change.', '')
        || ' By ' || segment_column || ', the biggest negative driver was ' || low_segment
        || ' with a change of ' || {kpi_text('low_change', kpi_name)}
        || '. The biggest positive driver was ' || high_segment
        || ' with a change of ' || {kpi_text('high_change', kpi_name)} || '.' AS summary
      FROM ({compare_sql}) c JOIN ({extremes_of(drivers_sql, *by)}) e {join}"""


def mentioned(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(q, '{word}')" for word in words) + ")"


def tags(table: str, *keys: str) -> str:
    return f"""SELECT {listed(keys)}concat_ws(',', 'profile_dataset', 'calculate_kpi_trend',
        CASE WHEN chg OR root OR NOT (anom OR fc OR ask OR summ) THEN 'compare_periods' END,
        CASE WHEN root THEN 'analyze_root_cause' END,
        CASE WHEN anom THEN 'detect_anomalies' END,
        CASE WHEN fc THEN 'forecast_kpi' END,
        CASE WHEN ask THEN 'run_sql_query' END,
        'generate_insight_summary') AS analyses
      FROM (SELECT *, {mentioned(CHANGE_WORDS)} AS chg, {mentioned(ROOT_CAUSE_WORDS)} AS root,
              {mentioned(ANOMALY_WORDS)} AS anom, {mentioned(FORECAST_WORDS)} AS fc,
              {mentioned(SQL_WORDS)} AS ask, {mentioned(SUMMARY_WORDS)} AS summ
            FROM (SELECT *, lower(trim(text)) AS q FROM {table}) l) f"""


MONTH_FIRST = "M/d/yyyy[ H:m[:s]]"


def column_rows(rows: str, columns: list[tuple]) -> str:
    """One row per column: name, type, numeric, categorical, date-like, format, ranks."""
    return "\nUNION ALL\n".join(
        f"""SELECT {number} AS column_no, '{name}' AS column_name, '{kind}' AS data_type,
          {kind in ('bigint', 'int', 'double')} AS is_numeric,
          {kind == 'string'} AS is_categorical,
          {date_like} AS is_date_like,
          CAST({date_format} AS VARCHAR) AS date_format,
          count(*) FILTER (WHERE "{source}" IS NULL) AS missing_values,
          {segment} AS is_segment_candidate,
          CAST({ranks[0]} AS INTEGER) AS date_rank, CAST({ranks[1]} AS INTEGER) AS revenue_rank,
          CAST({ranks[2]} AS INTEGER) AS order_rank, CAST({ranks[3]} AS INTEGER) AS segment_rank,
          CAST({ranks[4]} AS INTEGER) AS sql_segment_rank
        FROM {rows} base"""
        for number, (name, source, kind, date_like, date_format, segment, ranks) in enumerate(
            columns, start=1
        )
    )


def plain_column(name: str, kind: str, segment: bool, *ranks: str) -> tuple:
    return (name, name, kind, kind == "timestamp_ntz", "NULL", segment, ranks)


# Ranks: date, revenue, order, segment, segment for SQL.
LINEITEM_COLUMNS = [
    plain_column("l_orderkey", "bigint", False, "NULL", "2", "1", "NULL", "NULL"),
    plain_column("l_partkey", "bigint", False, "NULL", "3", "2", "NULL", "NULL"),
    plain_column("l_suppkey", "bigint", False, "NULL", "4", "3", "NULL", "NULL"),
    plain_column("l_linenumber", "int", False, "NULL", "5", "4", "NULL", "NULL"),
    plain_column("l_quantity", "double", False, "NULL", "6", "5", "NULL", "NULL"),
    plain_column("l_extendedprice", "double", False, "NULL", "1", "6", "NULL", "NULL"),
    plain_column("l_discount", "double", False, "NULL", "7", "7", "NULL", "NULL"),
    plain_column("l_tax", "double", False, "NULL", "8", "8", "NULL", "NULL"),
    plain_column("l_returnflag", "string", True, "NULL", "NULL", "9", "1", "1"),
    plain_column("l_linestatus", "string", True, "NULL", "NULL", "10", "2", "2"),
    plain_column("l_shipdate", "timestamp_ntz", False, "1", "NULL", "11", "NULL", "NULL"),
]
TEXT_DATE_LIKE = "count(day) > 0.7 * count(*)"
TEXT_COLUMNS = [
    (
        "order_date",
        "order_date",
        "string",
        TEXT_DATE_LIKE,
        f"CASE WHEN {TEXT_DATE_LIKE} THEN '{MONTH_FIRST}' END",
        True,
        ("1", "NULL", "5", "2", "2"),
    ),
    ("order_id", "order_id", "bigint", False, "NULL", False, ("NULL", "2", "1", "NULL", "NULL")),
    ("amount", "revenue", "double", False, "NULL", False, ("NULL", "1", "2", "NULL", "NULL")),
    ("channel", "channel", "string", False, "NULL", True, ("NULL", "NULL", "3", "1", "1")),
    (
        "order priority",
        "order priority",
        "string",
        False,
        "NULL",
        True,
        ("NULL", "NULL", "4", "3", "3"),
    ),
]

P, C = "'2001-06'", "'2001-07'"
ORDERS_REVENUE = trend(ORDERS_ROWS, "Revenue")
ORDERS_ORDERS = trend(ORDERS_ROWS, "Orders")
EVENTS_REVENUE = trend(EVENTS_ROWS, "Revenue")
NATION_REVENUE = trend(SALES_ROWS, "Revenue", "n_name")
PRIORITY_DRIVERS = drivers(ORDERS_ROWS, "Revenue", "o_orderpriority", P, C)

STEPS = f"""
WITH t AS ({trend(TEXT_ROWS, 'Revenue')}),
  c AS ({latest('SELECT * FROM t')}),
  a AS ({anomalies('SELECT * FROM t')}),
  q AS (SELECT count(*) - count(DISTINCT (order_date, order_id, revenue, channel, "order priority"))
          AS repeats, count(*) - count(channel) AS missing FROM {TEXT_ROWS} r)
SELECT 1 AS step_no, 'Data Quality Agent' AS agent,
  'Checked missing values, duplicates, and column types.' AS task,
  'Detected ' || repeats || ' duplicate rows. Detected ' || missing
    || ' missing values across the dataset.' AS output FROM q
UNION ALL SELECT 2, 'KPI Agent', 'Calculated monthly Revenue.',
  'Generated ' || count(*) || ' monthly KPI records.' FROM t
UNION ALL SELECT 3, 'Change Detection Agent',
  'Compared current period against previous period.',
  'Revenue changed by ' || CAST(absolute_change AS VARCHAR) || ' ('
    || CAST(percent_change AS VARCHAR) || '%).' FROM c
UNION ALL SELECT 4, 'Anomaly Agent',
  'Checked for unusual KPI values using z-score detection.',
  'Detected ' || count(*) FILTER (WHERE flagged) || ' anomalies.' FROM a
UNION ALL SELECT 5, 'Forecast Agent', 'Generated a baseline KPI forecast.',
  'Forecasted ' || count(*) || ' future periods.' FROM ({forecast('SELECT * FROM t', 3)}) f
"""

def report(rows: str, kpi_name: str, segment: str, previous: str, current: str) -> str:
    driver_rows = drivers(rows, kpi_name, segment, previous, current)
    text = summary(compare(rows, kpi_name, previous, current), driver_rows, kpi_name)
    return f"""
WITH t AS ({trend(rows, kpi_name)}), d AS ({driver_rows}), s AS ({text}),
  c AS ({compare(rows, kpi_name, previous, current)}),
  a AS ({anomaly_table('SELECT * FROM t')}), f AS ({forecast('SELECT * FROM t', 3)}),
  rows_of AS (
    SELECT 'kpi' AS section, 1 AS row_no, '{kpi_name}' AS label, CAST(NULL AS DOUBLE) AS number
    UNION ALL BY NAME SELECT 'summary' AS section, 1 AS row_no, summary AS label FROM s
    UNION ALL BY NAME SELECT 'change' AS section, 1 AS row_no, current_period AS label,
      absolute_change AS number, previous_period, previous_value, current_value, percent_change,
      direction FROM c
    UNION ALL BY NAME SELECT 'trend' AS section, row_number() OVER (ORDER BY period) AS row_no,
      period AS label, kpi_value AS number FROM t
    UNION ALL BY NAME SELECT 'drivers' AS section,
      row_number() OVER (ORDER BY absolute_change, segment) AS row_no, segment AS label,
      absolute_change AS number, previous_period, previous_value, current_value, percent_change,
      segment_column FROM d
    UNION ALL BY NAME SELECT 'anomalies' AS section, row_number() OVER (ORDER BY period) AS row_no,
      period AS label, z_score AS number, mean_value, CAST(is_anomaly AS VARCHAR) AS is_anomaly,
      anomaly_direction AS direction FROM a
    UNION ALL BY NAME SELECT 'forecast' AS section, row_number() OVER (ORDER BY period) AS row_no,
      period AS label, forecast_value AS number FROM f)
SELECT section, CAST(row_no AS INTEGER) AS row_no, label, number, previous_value, current_value,
  percent_change, mean_value, previous_period, segment_column, is_anomaly, direction FROM rows_of
"""


# One sentence for each customer, also of those with one of the two months only.
BY_CUSTOMER = f"""SELECT o_custkey, CASE
    WHEN a IS NULL THEN 'Revenue has no value in ' || {P} || ' and is ' || {money('b')} || ' in ' || {C} || '.'
    WHEN b IS NULL THEN 'Revenue was ' || {money('a')} || ' in ' || {P} || ' and no value in ' || {C} || '.'
    ELSE 'Revenue ' || CASE WHEN b > a THEN 'increased' WHEN b < a THEN 'decreased' ELSE 'stayed flat' END
      || ' from ' || {money('a')} || ' in ' || {P} || ' to ' || {money('b')} || ' in ' || {C} || '.'
      || coalesce(' This represents a ' || format('{{:.2f}}', {percent('a', 'b')}) || '% change.', '') END AS summary
  FROM (SELECT o_custkey, {r2("sum(o_totalprice) FILTER (WHERE strftime(o_orderdate, '%Y-%m') = " + P + ")")} AS a,
          {r2("sum(o_totalprice) FILTER (WHERE strftime(o_orderdate, '%Y-%m') = " + C + ")")} AS b
        FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ({P}, {C}) GROUP BY 1) t"""

BY = "o_custkey"
CUSTOMER_TREND = trend(CUSTOMER_ROWS, "Revenue", BY)
CUSTOMER_DRIVERS = own_drivers(CUSTOMER_ROWS, "Revenue", "o_orderpriority", BY)
CUSTOMER_SUMMARY = f"""SELECT o_custkey, coalesce(summary,
      'Not enough period data is available to generate a KPI summary.') AS summary
    FROM (SELECT DISTINCT o_custkey FROM orders) k LEFT JOIN (
      {summary(own_compare(CUSTOMER_ROWS, 'Revenue', BY), CUSTOMER_DRIVERS, 'Revenue', BY)}) s USING (o_custkey)"""


def customer_report(rows: int | None = None) -> str:
    """The report of every customer, with notes for its empty sections."""
    number = f"row_number() OVER (PARTITION BY {BY} ORDER BY"
    return f"""
WITH t AS ({CUSTOMER_TREND}), d AS ({CUSTOMER_DRIVERS}), s AS ({CUSTOMER_SUMMARY}),
  c AS ({own_compare(CUSTOMER_ROWS, 'Revenue', BY)}),
  a AS ({anomaly_table('SELECT * FROM t', BY)}), f AS ({forecast('SELECT * FROM t', 3, BY)}),
  k AS (SELECT DISTINCT {BY} FROM t),
  rows_of AS (
    SELECT {BY}, 'kpi' AS section, 1 AS row_no, 'Revenue' AS label, CAST(NULL AS DOUBLE) AS number FROM k
    UNION ALL BY NAME SELECT {BY}, 'summary' AS section, 1 AS row_no, summary AS label FROM s
    UNION ALL BY NAME SELECT {BY}, 'change' AS section, 1 AS row_no, current_period AS label,
      absolute_change AS number, previous_period, previous_value, current_value, percent_change, direction FROM c
    UNION ALL BY NAME SELECT {BY}, 'trend' AS section, {number} period) AS row_no, period AS label, kpi_value AS number FROM t
    UNION ALL BY NAME SELECT {BY}, 'drivers' AS section, {number} absolute_change, segment) AS row_no, segment AS label,
      absolute_change AS number, previous_period, previous_value, current_value, percent_change, segment_column FROM d
    UNION ALL BY NAME SELECT {BY}, 'anomalies' AS section, {number} period) AS row_no, period AS label, z_score AS number,
      mean_value, CAST(is_anomaly AS VARCHAR) AS is_anomaly, anomaly_direction AS direction FROM a
    UNION ALL BY NAME SELECT {BY}, 'forecast' AS section, {number} period) AS row_no, period AS label,
      forecast_value AS number FROM f),
  empty AS (
    SELECT {BY}, section, 0 AS row_no
    FROM k CROSS JOIN (VALUES ('kpi'), ('summary'), ('change'), ('trend'), ('drivers'), ('anomalies'), ('forecast')) AS n(section)
    WHERE NOT EXISTS (SELECT 1 FROM rows_of r WHERE r.{BY} = k.{BY} AND r.section = n.section))
SELECT {BY}, section, CAST(row_no AS INTEGER) AS row_no, label, number, previous_value, current_value,
  percent_change, mean_value, previous_period, segment_column, is_anomaly, direction
FROM (SELECT * FROM rows_of {f'WHERE row_no <= {rows}' if rows else ''} UNION ALL BY NAME SELECT * FROM empty) u
"""


CUSTOMER_STEPS = f"""
WITH t AS ({CUSTOMER_TREND}), c AS ({latest('SELECT * FROM t', BY)}), a AS ({anomalies('SELECT * FROM t', BY)}),
  f AS ({forecast('SELECT * FROM t', 3, BY)}), k AS (SELECT DISTINCT {BY} FROM t),
  q AS (SELECT CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN
          'No major data quality issues detected from basic profiling.' END AS note FROM orders)
SELECT {BY}, 1 AS step_no, 'Data Quality Agent' AS agent,
  'Checked missing values, duplicates, and column types.' AS task, note AS output FROM k CROSS JOIN q
UNION ALL SELECT {BY}, 2, 'KPI Agent', 'Calculated monthly Revenue.', 'Generated ' || count(*) || ' monthly KPI records.' FROM t GROUP BY {BY}
UNION ALL SELECT {BY}, 3, 'Change Detection Agent', 'Compared current period against previous period.',
  'Revenue changed by ' || coalesce(CAST(absolute_change AS VARCHAR), 'None') || ' (' || coalesce(CAST(percent_change AS VARCHAR), 'None') || '%).' FROM c
UNION ALL SELECT {BY}, 4, 'Anomaly Agent', 'Checked for unusual KPI values using z-score detection.',
  'Detected ' || count(*) FILTER (WHERE flagged) || ' anomalies.' FROM a GROUP BY {BY}
UNION ALL SELECT k.{BY}, 5, 'Forecast Agent', 'Generated a baseline KPI forecast.',
  CASE WHEN count(f.{BY}) > 0 THEN 'Forecasted ' || count(f.{BY}) || ' future periods.' ELSE 'Not enough data to forecast.' END
FROM k LEFT JOIN f USING ({BY}) GROUP BY k.{BY}
"""

# The analyses of the phrases by conversation, stated one by one.
PHRASE_TAGS = """SELECT conv_id, turn, 'profile_dataset,calculate_kpi_trend,' || CASE conv_id % 7
    WHEN 0 THEN 'compare_periods,' WHEN 1 THEN 'compare_periods,analyze_root_cause,'
    WHEN 2 THEN 'compare_periods,analyze_root_cause,' WHEN 3 THEN 'detect_anomalies,'
    WHEN 4 THEN 'forecast_kpi,' WHEN 5 THEN '' ELSE 'compare_periods,run_sql_query,' END
    || 'generate_insight_summary' AS analyses FROM conversations"""


ORACLES = {
    "trend_revenue": ORDERS_REVENUE,
    "trend_orders": ORDERS_ORDERS,
    "trend_aov": trend(ORDERS_ROWS, "Average Order Value"),
    "trend_revenue_sales": trend(SALES_ROWS, "Revenue"),
    "trend_orders_sales": trend(SALES_ROWS, "Orders"),
    "trend_aov_sales": trend(SALES_ROWS, "Average Order Value"),
    "trend_rows_sales": trend(SALES_ROWS, "Orders", value=ROWS_KPI),
    "trend_by_segment": trend(SALES_ROWS, "Revenue", "r_name"),
    "trend_aov_by_segment": trend(SALES_ROWS, "Average Order Value", "c_mktsegment"),
    "trend_text_dates": trend(TEXT_ROWS, "Revenue"),
    "trend_csv": trend(TEXT_ROWS, "Average Order Value"),
    "list_periods": f"SELECT DISTINCT strftime(day, '%Y-%m') AS period FROM {ORDERS_ROWS} b",
    "rows_per_period": "SELECT strftime(ts, '%Y-%m') AS period, event_type, count(*) AS n_rows "
    "FROM events GROUP BY ALL",
    "formatted_revenue": f"SELECT period, {money('kpi_value')} AS kpi_text "
    f"FROM ({ORDERS_REVENUE}) t",
    "formatted_orders": f"SELECT period, {whole('kpi_value')} AS kpi_text FROM ({ORDERS_ORDERS}) t",
    "latest_change": latest(ORDERS_REVENUE),
    "latest_change_by_segment": latest(trend(SALES_ROWS, "Orders", "n_name"), "n_name"),
    "latest_change_single_period": latest(EVENTS_REVENUE),
    "period_changes": changes(trend(ORDERS_ROWS, "Average Order Value")),
    "compare_latest_previous": compare(
        ORDERS_ROWS,
        "Revenue",
        PREVIOUS_PERIOD.format(rows=ORDERS_ROWS),
        LAST_PERIOD.format(rows=ORDERS_ROWS),
    ),
    "compare_first_latest": compare(
        ORDERS_ROWS,
        "Revenue",
        FIRST_PERIOD.format(rows=ORDERS_ROWS),
        LAST_PERIOD.format(rows=ORDERS_ROWS),
    ),
    "compare_custom": compare(ORDERS_ROWS, "Revenue", P, C),
    "compare_by_segment": compare(SALES_ROWS, "Average Order Value", P, C, "n_name"),
    "drivers_latest": drivers(
        ORDERS_ROWS,
        "Revenue",
        "o_orderpriority",
        PREVIOUS_PERIOD.format(rows=ORDERS_ROWS),
        LAST_PERIOD.format(rows=ORDERS_ROWS),
    ),
    "drivers_priority_revenue": PRIORITY_DRIVERS,
    "drivers_status_orders": drivers(ORDERS_ROWS, "Orders", "o_orderstatus", P, C),
    "drivers_region_aov": drivers(SALES_ROWS, "Average Order Value", "r_name", P, C),
    "drivers_brand_revenue": drivers(SALES_ROWS, "Revenue", "p_brand", P, C),
    "drivers_absent_period": drivers(ORDERS_ROWS, "Revenue", "o_orderstatus", "'1990-01'", C),
    "drivers_single_period": drivers(EVENTS_ROWS, "Revenue", "event_type", "''", "''"),
    "drivers_all": " UNION ALL ".join(
        drivers(SALES_ROWS, "Orders", segment, P, C)
        for segment in ("r_name", "c_mktsegment", "p_brand")
    ),
    "driver_extremes": " UNION ALL ".join(
        f"""SELECT segment_column, low_segment AS biggest_negative_driver,
          low_change AS biggest_negative_change, high_segment AS biggest_positive_driver,
          high_change AS biggest_positive_change
        FROM ({extremes_of(drivers(ORDERS_ROWS, 'Revenue', segment, P, C))}) e"""
        for segment in ("o_orderpriority", "o_orderstatus")
    ),
    "anomalies_revenue": anomaly_table(ORDERS_REVENUE),
    "anomalies_by_segment": anomaly_table(NATION_REVENUE, "n_name"),
    "anomalies_single_period": anomaly_table(EVENTS_REVENUE),
    "anomaly_count": f"SELECT count(*) FILTER (WHERE flagged) AS anomalies "
    f"FROM ({anomalies(ORDERS_ORDERS)}) a",
    "linear_fit": f"SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, months, "
    f"last_period FROM ({fit(ORDERS_ORDERS)}) f",
    "forecast_revenue": forecast(ORDERS_REVENUE, 3),
    "forecast_by_segment": forecast(NATION_REVENUE, 6, "n_name"),
    "profile_dataset": """SELECT count(*) AS rows, 11 AS columns,
        CAST(0 AS BIGINT) + sum(CASE WHEN l_shipdate IS NULL THEN 1 ELSE 0 END)::BIGINT
          AS missing_total,
        (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem) d)
          AS duplicate_rows,
        'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,'
          || 'l_returnflag,l_linestatus,l_shipdate' AS column_names,
        'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax'
          AS numeric_columns,
        'l_returnflag,l_linestatus' AS categorical_columns FROM lineitem""",
    "profile_duplicates": f"""SELECT count(*) AS rows, 5 AS columns,
        count(*) - count(channel) AS missing_total,
        count(*) - count(DISTINCT (order_date, order_id, revenue, channel, "order priority"))
          AS duplicate_rows,
        'order_date,order_id,amount,channel,order priority' AS column_names,
        'order_id,amount' AS numeric_columns,
        'order_date,channel,order priority' AS categorical_columns FROM {TEXT_ROWS} r""",
    "profile_columns": column_rows("lineitem", LINEITEM_COLUMNS),
    "profile_text_columns": column_rows(TEXT_ROWS, TEXT_COLUMNS),
    "distinct_estimates": "SELECT column_name, TRUE AS is_near FROM (DESCRIBE orders) d",
    "date_formats": f"""SELECT count(*) AS rows, count(day) AS dated_rows,
        count(try_strptime(order_date, '%-m/%-d/%Y')) AS month_first_rows FROM {TEXT_ROWS} r""",
    "csv_schema": f"""SELECT column_name, data_type, missing_values, is_date_like, date_format
        FROM ({column_rows(TEXT_ROWS, TEXT_COLUMNS)}) c""",
    "quality_notes": f"""SELECT 'Detected ' || repeats || ' duplicate rows. Detected ' || missing
          || ' missing values across the dataset.' AS quality_notes
        FROM (SELECT count(*) - count(channel) AS missing, count(*) - count(DISTINCT
          (order_date, order_id, revenue, channel, "order priority")) AS repeats
          FROM {TEXT_ROWS} r) q""",
    "preview": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5",
    "sql_monthly_revenue": "SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS month, "
    "round(sum(o_totalprice), 2) AS total_revenue FROM orders GROUP BY 1",
    "sql_revenue_by_segment": "SELECT o_orderpriority AS segment, "
    "round(sum(o_totalprice), 2) AS total_revenue FROM orders GROUP BY 1",
    "sql_orders_by_segment": "SELECT o_orderpriority AS segment, "
    "count(DISTINCT o_orderkey) AS total_orders FROM orders GROUP BY 1",
    "sql_preview": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
    "sql_quoted_names": "SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS month, "
    "round(sum(o_totalprice), 2) AS total_revenue FROM orders GROUP BY 1",
    "kpi_by_segment_revenue": f"SELECT channel, round(sum(revenue), 2) AS total_revenue "
    f"FROM {TEXT_ROWS} r GROUP BY 1",
    "kpi_by_segment_orders": f"SELECT channel, count(DISTINCT order_id) AS total_orders "
    f"FROM {TEXT_ROWS} r GROUP BY 1",
    "kpi_by_segment_aov": f"SELECT n_name, round(sum(revenue) / count(DISTINCT order_id), 2) "
    f"AS average_order_value FROM {SALES_ROWS} r GROUP BY 1",
    "kpi_summary": summary(compare(ORDERS_ROWS, "Revenue", P, C), PRIORITY_DRIVERS, "Revenue"),
    "kpi_summary_orders": summary(
        compare(ORDERS_ROWS, "Orders", P, C),
        drivers(ORDERS_ROWS, "Orders", "o_orderpriority", P, C),
        "Orders",
    ),
    "kpi_summary_by_region": summary(
        compare(SALES_ROWS, "Revenue", P, C, "r_name"),
        drivers(SALES_ROWS, "Revenue", "p_brand", P, C, "r_name"),
        "Revenue",
        "r_name",
    ),
    "trend_all_kpis": " UNION ALL ".join(trend(SALES_ROWS, name) for name in KPI),
    "change_all_kpis": " UNION ALL ".join(
        f"SELECT '{name}' AS kpi_name, * FROM ({latest(trend(SALES_ROWS, name))}) c" for name in KPI
    ),
    "anomalies_all_kpis": " UNION ALL ".join(anomaly_table(trend(SALES_ROWS, name)) for name in KPI),
    "forecast_all_kpis": " UNION ALL ".join(
        f"SELECT '{name}' AS kpi_name, * FROM ({forecast(trend(SALES_ROWS, name), 3)}) f" for name in KPI
    ),
    "store_drivers": drivers(TEXT_ROWS, "Revenue", "channel", P, C),
    "store_compare": compare(TEXT_ROWS, "Average Order Value", P, C),
    "store_profile": f"""SELECT column_name, missing_values + CASE column_name
          WHEN 'order_date' THEN (SELECT count(*) FILTER (WHERE day IS NULL) FROM {TEXT_ROWS} r) ELSE 0 END
          AS missing_values, is_date_like FROM ({column_rows(TEXT_ROWS, TEXT_COLUMNS)}) c""",
    "trend_refreshed": " UNION ALL ".join(trend(ORDERS_ROWS, name, "o_orderstatus") for name in KPI),
    # The estimates are compared with exact counts by the query itself; here they are only expected to be near.
    "orders_rolled_up": f"SELECT o_orderstatus, {r2('sum(o_totalprice)')} AS revenue, TRUE AS is_near "
    "FROM orders GROUP BY 1",
    "csv_malformed": """SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS surplus,
        count(*) FILTER (WHERE o_orderstatus = 'O') AS missing, CAST(0 AS BIGINT) AS value FROM orders""",
    "csv_malformed_dropped": trend(
        """(SELECT o_orderdate AS day, round(o_totalprice, 2) AS revenue, o_orderkey AS order_id
        FROM orders WHERE o_orderstatus <> 'F')""", "Revenue"),
    "compare_own_months": own_compare(CUSTOMER_ROWS, "Orders", "o_custkey", back=0),
    "drivers_own_months": own_drivers(
        CUSTOMER_ROWS, "Average Order Value", "o_orderpriority", "o_custkey"
    ),
    "drivers_all_own_months": " UNION ALL ".join(
        own_drivers(CUSTOMER_ROWS, "Revenue", segment, "o_custkey")
        for segment in ("o_orderpriority", "o_orderstatus")
    ),
    "kpi_summary_own_months": CUSTOMER_SUMMARY,
    "investigation_steps_by_customer": CUSTOMER_STEPS,
    "report_by_customer": customer_report(),
    "report_by_customer_written": customer_report(2),
    "drivers_null_segment": drivers(TEXT_ROWS, "Revenue", "channel", P, C),
    "kpi_summary_by_customer": BY_CUSTOMER,
    "tag_phrases": PHRASE_TAGS,
    "kpi_summary_single_period": "SELECT CASE WHEN count(DISTINCT strftime(ts, '%Y-%m')) < 2 THEN "
    "'Not enough period data is available to generate a KPI summary.' END AS summary FROM events",
    "investigation_steps": STEPS,
    "report_bundle": report(ORDERS_ROWS, "Revenue", "o_orderpriority", P, C),
    "report_written": report(ORDERS_ROWS, "Revenue", "o_orderpriority", P, C),
    "report_sales": report(SALES_ROWS, "Average Order Value", "r_name", P, C),
    "tag_conversations": tags("conversations", "conv_id", "turn"),
    "tag_documents": tags("documents", "doc_id"),
    **{
        name: f"WITH sales_data AS (SELECT * FROM orders) SELECT * FROM ({text}) q"
        for name, text in SURFACE_SQL.items()
    },
}
