"""Which analyses a question asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import named

# Words that point to an analysis, matched anywhere in the text (fixed values).
CHANGE_WORDS = (
    "change",
    "changed",
    "drop",
    "dropped",
    "decrease",
    "decreased",
    "increase",
    "increased",
    "grew",
    "growth",
    "decline",
    "declined",
    "compare",
    "comparison",
)
ROOT_CAUSE_WORDS = (
    "why",
    "root cause",
    "cause",
    "driver",
    "drivers",
    "contributed",
    "contribution",
    "region",
    "category",
    "channel",
    "segment",
)
ANOMALY_WORDS = ("anomaly", "anomalies", "unusual", "spike", "dip", "outlier", "weird")
FORECAST_WORDS = (
    "forecast",
    "predict",
    "prediction",
    "future",
    "next month",
    "next few months",
    "next quarter",
)
SQL_WORDS = ("sql", "query", "duckdb")
SUMMARY_WORDS = ("summary", "summarize", "explain", "insight", "insights", "business")


def mentions(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any word occurs in the text; a word holding another one adds nothing."""
    found = F.lit(False)
    for word in words:
        if not any(other != word and other in word for other in words):
            found = found | text.contains(word)
    return found


def tag_questions(questions: DataFrame, text_col: str, name: str = "analyses") -> DataFrame:
    """Add the ordered list of analyses each question asks for; one pass, no shuffle.

    Three projections on purpose: the lower-cased text and the flags are used
    several times, and Spark keeps such values instead of computing them anew
    in every test.
    """
    text = F.col("__text")
    flags = {
        "__change": CHANGE_WORDS,
        "__root_cause": ROOT_CAUSE_WORDS,
        "__anomaly": ANOMALY_WORDS,
        "__forecast": FORECAST_WORDS,
        "__sql": SQL_WORDS,
        "__summary": SUMMARY_WORDS,
    }
    lowered = F.coalesce(F.lower(F.trim(named(text_col))), F.lit(""))
    flagged = questions.withColumn("__text", lowered).withColumns(
        {flag: mentions(text, words) for flag, words in flags.items()}
    )
    change, root_cause, anomaly, forecast, sql, summary = [F.col(flag) for flag in flags]
    general = ~(change | root_cause | anomaly | forecast | sql | summary)
    analyses = F.array_compact(
        F.array(
            F.lit("profile_dataset"),
            F.lit("calculate_kpi_trend"),
            F.when(change | root_cause | general, "compare_periods"),
            F.when(root_cause, "analyze_root_cause"),
            F.when(anomaly, "detect_anomalies"),
            F.when(forecast, "forecast_kpi"),
            F.when(sql, "run_sql_query"),
            F.lit("generate_insight_summary"),
        )
    )
    return flagged.withColumn(name, analyses).drop("__text", *flags)
