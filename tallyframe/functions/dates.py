"""Date parsing, months and month predicates."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import data_type, is_categorical, is_temporal, named

# Candidate formats for string dates, in order of preference: at equal hits the
# earlier one wins, so month-first beats day-first. Each comes with the shapes
# (see ``date_shape``) of the texts it is tried on; a failed parse is far dearer
# than a comparison of shapes.
DATE_FORMATS = (
    ("yyyy-M-d[ H:m[:s[.SSSSSSSSS]]]", ("Y-d-d", "Y-d-D")),
    ("yyyy-M-d'T'H:m[:s[.SSSSSSSSS]][XXX]", ("Y-d-dT", "Y-d-DT")),
    ("yyyy/M/d[ H:m[:s]]", ("Y/d/d", "Y/d/D")),
    ("M/d/yyyy[ H:m[:s]]", ("d/d/Y", "d/D/Y")),
    ("d/M/yyyy[ H:m[:s]]", ("d/d/Y", "D/d/Y")),
    ("M/d/yyyy h:m[:s] a", ("d/d/Yp", "d/D/Yp")),
    ("M/d/yy[ H:m[:s]]", ("d/d/d", "d/D/d", "d/d/D", "d/D/D")),
    ("M-d-yyyy[ H:m[:s]]", ("d-d-Y", "d-D-Y")),
    ("d-M-yyyy[ H:m[:s]]", ("d-d-Y", "D-d-Y")),
    ("d.M.yyyy[ H:m[:s]]", ("d.d.Y", "D.d.Y")),
    ("yyyyMMdd", ("YY",)),
    ("yyyy-M", ("Y-d",)),
    ("MMM d, yyyy", ("m d, Y", "m D, Y")),
    ("MMMM d, yyyy", ("m d, Y", "m D, Y")),
    ("d MMM yyyy", ("d m Y", "D m Y")),
    ("d MMMM yyyy", ("d m Y", "D m Y")),
    ("d-MMM-yyyy", ("d-m-Y", "D-m-Y")),
)

# The month by which a stored table is partitioned, and its last column.
STORED_MONTH = "__stored_month"

PERIOD_TEXT = re.compile(r"^(\d{4})-(\d{2})$")


def parse_date(text: Column, date_format: str) -> Column:
    """Wall-clock timestamp of a text, NULL where the format does not fit."""
    return F.try_to_timestamp(text, F.lit(date_format)).cast("timestamp_ntz")


def date_shape(text: Column) -> Column:
    """Outline of the date in a text, without the time of day.

    Y is four digits, D a number from 13 to 31 (no month), d any other one or two
    digits, m a word and p the end of a 12-hour time.
    """
    shape = F.regexp_replace(text, "[A-Za-z]{3,}", "m")
    shape = F.regexp_replace(shape, "[0-9]{4}", "Y")
    shape = F.regexp_replace(shape, "(?<![0-9])(?:1[3-9]|2[0-9]|3[01])(?![0-9])", "D")
    shape = F.regexp_replace(shape, "[0-9]{1,2}", "d")
    shape = F.regexp_replace(shape, " [dD]:.* [AaPp][Mm]$", "p")
    return F.regexp_replace(shape, "(?:(?<=T)| )[dD]:.*", "")


def format_hits(text: Column, shape: Column) -> list[Column]:
    """For each candidate format, how many values it parses (aggregates).

    ``shape`` should be a column made beforehand, so that it is computed once.
    """
    return [
        F.count(F.when(shape.isin(*shapes), parse_date(text, date_format)))
        for date_format, shapes in DATE_FORMATS
    ]


def best_format(hits: list[Column]) -> Column:
    """The candidate with most hits, the earlier one on ties; NULL without hits."""
    ranked = F.array_max(
        F.array(
            *[
                F.struct(hit.alias("hits"), F.lit(-position).alias("preference"))
                for position, hit in enumerate(hits)
            ]
        )
    )
    formats = F.array(*[F.lit(date_format) for date_format, _ in DATE_FORMATS])
    return F.when(ranked["hits"] > 0, F.element_at(formats, 1 - ranked["preference"]))


def detect_date_format(df: DataFrame, date_col: str) -> str | None:
    """Format that parses most of a string date column: one job, one row back."""
    texts = df.select(named(date_col).alias("text"), date_shape(named(date_col)).alias("shape"))
    hits = format_hits(F.col("text"), F.col("shape"))
    counted = texts.agg(*[hit.alias(f"hits_{position}") for position, hit in enumerate(hits)])
    return counted.select(best_format([F.col(name) for name in counted.columns])).first()[0]


def coerce_date(df: DataFrame, date_col: str, date_format: str | None = None) -> DataFrame:
    """Make the date column a date or timestamp; unparseable values become NULL.

    Typed columns are left as they are, so predicates on them reach the scan.
    """
    dtype = data_type(df, date_col)
    if is_temporal(dtype):
        return df
    if not is_categorical(dtype):
        raise ValueError(f"column {date_col!r} of type {dtype.simpleString()} is not a date")
    chosen = date_format or detect_date_format(df, date_col)
    if chosen is None:
        return df.withColumn(date_col, F.lit(None).cast("timestamp_ntz"))
    return df.withColumn(date_col, parse_date(named(date_col), chosen))


def drop_undated(df: DataFrame, date_col: str) -> DataFrame:
    return df.filter(named(date_col).isNotNull())


def month_of(date_col: str) -> Column:
    """First day of the month.

    A 4-byte grouping key: the ``yyyy-MM`` text is only made after aggregation,
    once per month and not once per row.
    """
    return F.trunc(named(date_col).cast("date"), "MM")


def period_of(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def without_stored_month(df: DataFrame) -> DataFrame:
    return df.drop(STORED_MONTH)


def with_period(df: DataFrame, date_col: str, name: str = "period") -> DataFrame:
    """Add the calendar month as ``yyyy-MM``."""
    return df.withColumn(name, period_of(named(date_col)))


def month_start(period: str) -> date | None:
    """First day of a ``yyyy-MM`` period, None if the text is no period."""
    match = PERIOD_TEXT.match(period)
    if match is None or not 1 <= int(match[2]) <= 12 or int(match[1]) < 1:
        return None
    return date(int(match[1]), int(match[2]), 1)


def month_runs(periods: Iterable[str]) -> list[tuple[date, date]]:
    """First days of the first and last month of each run of neighbouring months; other texts are left out."""
    runs: list[tuple[date, date]] = []
    for start in sorted({month_start(period) for period in periods} - {None}):
        if runs and following_month(runs[-1][1]) == start:
            runs[-1] = (runs[-1][0], start)
        else:
            runs.append((start, start))
    return runs


def following_month(start: date) -> date | None:
    """First day of the next month, None beyond the last month that a date can have."""
    if (start.year, start.month) == (date.max.year, date.max.month):
        return None
    return date(start.year + start.month // 12, start.month % 12 + 1, 1)


def in_months(df: DataFrame, date_col: str, first: date, last: date) -> Column:
    """Whether the date falls into the months from ``first`` to ``last``, as a range on the raw column.

    A range with literals of the column's own type is pushed to the Parquet
    scan; a test on the formatted text would not be. A table stored by month is
    also asked for its partitions.
    """
    dtype = data_type(df, date_col)
    inside = named(date_col) >= F.lit(first.isoformat()).cast(dtype)
    if STORED_MONTH in df.columns:
        inside = F.col(STORED_MONTH).between(F.lit(first), F.lit(last)) & inside
    after = following_month(last)
    if after is None:
        return inside
    return inside & (named(date_col) < F.lit(after.isoformat()).cast(dtype))


def filter_periods(df: DataFrame, date_col: str, *periods: str) -> DataFrame:
    """Rows of the named months; ``date_col`` must already be typed.

    Neighbouring months are one range, so many months make a short predicate.
    """
    wanted = F.lit(False)
    for first, last in month_runs(periods):
        wanted = wanted | in_months(df, date_col, first, last)
    return df.filter(wanted)
