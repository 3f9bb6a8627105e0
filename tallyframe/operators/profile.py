"""Dataset profile: size, missing values, duplicates, column classes and roles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import (
    has_date_name,
    is_categorical,
    is_missing,
    is_numeric,
    is_temporal,
    named,
)
from tallyframe.functions.dates import (
    best_format,
    date_shape,
    detect_date_format,
    format_hits,
    without_stored_month,
)
from tallyframe.settings import Settings

# Column names that suggest a role, most telling first (fixed values).
ROLE_KEYWORDS = {
    "date": ("order_date", "date", "created_at", "timestamp"),
    "revenue": ("revenue", "sales", "amount", "total", "price", "order_value"),
    "order": ("order_id", "transaction_id", "invoice_id", "receipt_id"),
    "segment": ("region", "category", "channel", "segment", "department"),
    "sql_segment": ("region", "category", "channel", "segment", "product"),
}

COLUMN_FACTS = (
    "array<struct<column_no:int,column_name:string,data_type:string,is_numeric:boolean,"
    "is_categorical:boolean,is_date_like:boolean,is_segment_candidate:boolean,"
    + ",".join(f"{role}_match:int" for role in ROLE_KEYWORDS)
    + ">>"
)

# More than this share of all rows must parse for a string column to be a date.
DATE_PARSE_RATIO = 0.7

# Words of 64 bits that tell which row hashes repeat: a power of two, 8 MB with their numbers.
HASH_WORDS = 1 << 19

# Texts of the quality notes (fixed values).
DUPLICATES_FOUND = "Detected %d duplicate rows."
MISSING_FOUND = "Detected %d missing values across the dataset."
NOT_CHECKED = "Duplicate rows were not checked."
NOTHING_FOUND = "No major data quality issues detected from basic profiling."


def column_counts(df: DataFrame, distinct_estimates: bool = False) -> DataFrame:
    """One row of counts behind both profiles: rows, missing values, date format hits."""
    df = without_stored_month(df)
    fields = list(enumerate(df.schema.fields))
    shaped = df.select(
        "*",
        *[
            date_shape(named(field.name)).alias(f"__shape_{position}")
            for position, field in fields
            if maybe_date_text(field)
        ],
    )
    measures: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for position, field in fields:
        measures.append(F.count_if(is_missing(df, field.name)).alias(f"missing_{position}"))
        if maybe_date_text(field):
            hits = format_hits(named(field.name), F.col(f"__shape_{position}"))
            measures += [
                hit.alias(f"hits_{position}_{candidate}") for candidate, hit in enumerate(hits)
            ]
        if distinct_estimates:
            measures.append(distinct_estimate(field).alias(f"distinct_{position}"))
    return shaped.agg(*measures)


def profile_columns(
    df: DataFrame, distinct_estimates: bool = False, counts: DataFrame | None = None
) -> DataFrame:
    """One row per column, from one aggregation over the table.

    Class flags, missing values, date format with most hits, whether the column
    is a segment candidate, and for each role its rank among the candidates (1
    is the suggestion). ``distinct_estimates`` adds ``approx_distinct``.
    ``counts`` is the result of ``column_counts`` if it is there already.
    """
    df = without_stored_month(df)
    if counts is None:
        counts = column_counts(df, distinct_estimates)
    fields = list(enumerate(df.schema.fields))
    facts = json.dumps([column_facts(position, field) for position, field in fields])
    columns = counts.select("*", F.inline(F.from_json(F.lit(facts), COLUMN_FACTS)))

    def counted(prefix: str) -> Column:
        values = ", ".join(f"{prefix}_{position}" for position, _ in fields)
        return F.expr(f"element_at(array({values}), column_no)")

    date_like, date_format = F.col("is_date_like"), F.lit(None).cast("string")
    for position, field in fields:
        if maybe_date_text(field):
            this = F.col("column_no") == position + 1
            hits = hit_columns(counts, position)
            enough = F.try_divide(F.greatest(*hits), F.col("rows")) > DATE_PARSE_RATIO
            date_like = F.when(this, F.coalesce(enough, F.lit(False))).otherwise(date_like)
            date_format = F.when(this & enough, best_format(hits)).otherwise(date_format)

    matches = [f"{role}_match" for role in ROLE_KEYWORDS]
    columns = columns.select(
        "column_no",
        "column_name",
        "data_type",
        "is_numeric",
        "is_categorical",
        date_like.alias("is_date_like"),
        date_format.alias("date_format"),
        counted("missing").alias("missing_values"),
        "is_segment_candidate",
        *([counted("distinct").alias("approx_distinct")] if distinct_estimates else []),
        *matches,
    )
    return rank_roles(columns).drop(*matches).orderBy("column_no")


def maybe_date_text(field: T.StructField) -> bool:
    return is_categorical(field.dataType) and has_date_name(field.name)


def distinct_estimate(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.MapType):
        return F.lit(None).cast("bigint")
    return F.approx_count_distinct(named(field.name))


def counted_date_format(df: DataFrame, settings: Settings, counts: DataFrame) -> str | None:
    """Best format of the date column by ``column_counts``, or by a pass of its own."""
    position = df.columns.index(settings.date_col)
    hits = hit_columns(counts, position)
    if not hits:
        return detect_date_format(df, settings.date_col)
    return counts.select(best_format(hits)).first()[0]


def hit_columns(counts: DataFrame, position: int) -> list[Column]:
    return [F.col(name) for name in counts.columns if name.startswith(f"hits_{position}_")]


def column_facts(position: int, field: T.StructField) -> dict:
    """What the schema alone tells about a column."""
    categorical = is_categorical(field.dataType)
    return {
        "column_no": position + 1,
        "column_name": field.name,
        "data_type": field.dataType.simpleString(),
        "is_numeric": is_numeric(field.dataType),
        "is_categorical": categorical,
        "is_date_like": is_temporal(field.dataType),
        "is_segment_candidate": categorical and "id" not in field.name.lower(),
        **{f"{role}_match": role_match(field.name, role) for role in ROLE_KEYWORDS},
    }


def role_match(name: str, role: str) -> int:
    """How well a name fits a role, lower is better: equal to a keyword, holding one, neither.

    Among equals the earlier keyword is better.
    """
    keywords = ROLE_KEYWORDS[role]
    normal = name.lower().replace(" ", "_").replace("-", "_")
    if normal in keywords:
        return keywords.index(normal)
    held = [place for place, keyword in enumerate(keywords) if keyword in normal]
    return len(keywords) + (held[0] if held else len(keywords))


def rank_roles(columns: DataFrame) -> DataFrame:
    """Add a rank per role: best match first, then the earlier column.

    The table has one row per column of the profiled table, so its windows need
    no partitions.
    """
    never = F.lit(0)

    def rank(role: str, candidate: Column, last: Column = never) -> Column:
        match = F.col(f"{role}_match")
        order = Window.orderBy(candidate.desc(), last, match, "column_no")
        return F.when(candidate, F.row_number().over(order))

    segment = F.col("is_segment_candidate")
    no_segment = F.max(segment).over(Window.partitionBy()) == F.lit(False)
    columns = columns.withColumns(
        {
            "date_rank": rank("date", F.col("is_date_like")),
            "revenue_rank": rank("revenue", F.col("is_numeric")),
            "segment_rank": rank("segment", segment),
            "__sql_segment": segment | (no_segment & (F.col("column_no") == 1)),
        }
    )
    # Without a matching name the first column that is not the date is taken.
    unmatched = F.col("order_match") >= 2 * len(ROLE_KEYWORDS["order"])
    last = (unmatched & F.coalesce(F.col("date_rank") == 1, F.lit(False))).cast("int")
    ranked = columns.withColumns(
        {
            "order_rank": rank("order", F.lit(True), last),
            "sql_segment_rank": rank("sql_segment", F.col("__sql_segment")),
        }
    )
    return ranked.drop("__sql_segment")


def suggest_settings(columns: DataFrame) -> Settings:
    """Settings from the rank-1 columns of ``profile_columns`` (one row per column is read)."""
    rows = columns.select(
        "column_name", "date_format", "date_rank", "revenue_rank", "order_rank"
    ).collect()
    first = {
        role: next((row for row in rows if row[f"{role}_rank"] == 1), None)
        for role in ("date", "revenue", "order")
    }
    if first["date"] is None:
        raise ValueError("no date-like column: KPI trends need one")
    return Settings(
        date_col=first["date"].column_name,
        revenue_col=first["revenue"].column_name if first["revenue"] else None,
        order_col=first["order"].column_name if first["order"] else None,
        date_format=first["date"].date_format,
    )


def duplicate_rows(df: DataFrame) -> int:
    """Rows equal to an earlier row in all columns, missing equal to missing; runs a job."""
    return duplicate_count(df).first()[0]


def duplicate_count(df: DataFrame) -> DataFrame:
    """The number of duplicates as one row (duplicate_rows), in one plan for every table.

    An 8-byte hash of each row is counted first, the only thing shuffled for a row that is like no
    other. The hashes that repeat set bits in ``HASH_WORDS`` words, which is all that is broadcast,
    whatever the size of the table. Only rows whose bit is set are grouped by all columns, copies being
    combined before their shuffle; that also sorts out hashes and bits that agree by chance. While there
    are far fewer repeated hashes than bits, few other rows get that far.
    """
    hashed = [
        named(field.name) for field in df.schema.fields if not holds_map(field.dataType)
    ]
    if not hashed:
        return count_repeats(df)
    row_hash = F.xxhash64(*hashed)
    repeated = df.groupBy(row_hash.alias("row_hash")).count().filter("count > 1")
    word, bit = hash_place(F.col("row_hash"))
    words = repeated.groupBy(word.alias("__word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__bits")
    )
    word, bit = hash_place(row_hash)
    is_set = F.call_function("shiftright", F.col("__bits"), bit).bitwiseAND(F.lit(1)) == 1
    maybe = df.join(F.broadcast(words), (word == F.col("__word")) & is_set, "left_semi")
    return count_repeats(maybe)


def hash_place(row_hash: Column) -> tuple[Column, Column]:
    """The word and the bit that stand for a hash."""
    word = F.call_function("shiftrightunsigned", row_hash, F.lit(6)).bitwiseAND(F.lit(HASH_WORDS - 1))
    return word, row_hash.bitwiseAND(F.lit(63)).cast("int")


def holds_map(dtype: T.DataType) -> bool:
    """Maps can be grouped but not hashed."""
    if isinstance(dtype, T.StructType):
        return any(holds_map(field.dataType) for field in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return holds_map(dtype.elementType)
    return isinstance(dtype, T.MapType)


def count_repeats(df: DataFrame) -> DataFrame:
    """Duplicates by grouping on all columns; copies are combined before the shuffle."""
    counted = df.groupBy(*[named(name) for name in df.columns]).agg(
        F.count(F.lit(1)).alias("__copies")
    )
    return counted.agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicate_rows"))


def profile_dataset(
    df: DataFrame, duplicates: bool = True, counts: DataFrame | None = None
) -> DataFrame:
    """One row about the whole table; ``duplicates=False`` skips the only wide step."""
    df = without_stored_month(df)
    if counts is None:
        counts = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[
                F.count_if(is_missing(df, name)).alias(f"missing_{position}")
                for position, name in enumerate(df.columns)
            ],
        )
    missing = [F.col(f"missing_{position}") for position in range(len(df.columns))]
    repeats = duplicate_count(df).scalar() if duplicates else F.lit(None)
    fields = df.schema.fields
    return counts.select(
        "rows",
        F.lit(len(fields)).alias("columns"),
        text_array([field.name for field in fields]).alias("column_names"),
        text_array([f.name for f in fields if is_numeric(f.dataType)]).alias("numeric_columns"),
        text_array([f.name for f in fields if is_categorical(f.dataType)]).alias(
            "categorical_columns"
        ),
        sum_of(missing).alias("missing_total"),
        repeats.cast("bigint").alias("duplicate_rows"),
    )


def sum_of(terms: list[Column]) -> Column:
    total = F.lit(0).cast("bigint")
    for term in terms:
        total = total + term
    return total


def text_array(texts: list[str]) -> Column:
    return F.array(*[F.lit(text) for text in texts]).cast("array<string>")


def quality_notes(profile: DataFrame) -> DataFrame:
    """Sentences about duplicates and missing values, from ``profile_dataset``.

    Duplicates that were not looked for are said to be unchecked.
    """
    duplicated = F.when(
        F.col("duplicate_rows") > 0,
        F.format_string(DUPLICATES_FOUND, "duplicate_rows"),
    ).when(F.col("duplicate_rows").isNull(), NOT_CHECKED)
    missing = F.when(
        F.col("missing_total") > 0,
        F.format_string(MISSING_FOUND, "missing_total"),
    )
    notes = F.concat_ws(" ", duplicated, missing)
    return profile.select(
        F.when(notes != "", notes).otherwise(NOTHING_FOUND).alias("quality_notes")
    )
