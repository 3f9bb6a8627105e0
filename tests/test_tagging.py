"""Question tagging."""

import itertools

import pytest

from helpers import rows_of
from tallyframe.operators import tag_questions
from tallyframe.operators.tagging import (
    ANOMALY_WORDS,
    CHANGE_WORDS,
    FORECAST_WORDS,
    ROOT_CAUSE_WORDS,
    SQL_WORDS,
    SUMMARY_WORDS,
)

QUESTIONS = {
    "Why did revenue drop?": ["compare_periods", "analyze_root_cause"],
    "Which region drove the change?": ["compare_periods", "analyze_root_cause"],
    "Are there any unusual revenue anomalies?": ["detect_anomalies"],
    "Forecast revenue for the next few months.": ["forecast_kpi"],
    "Give me a business summary of performance.": [],
    "Show revenue": ["compare_periods"],
    "Run an SQL query, then compare": ["compare_periods", "run_sql_query"],
    "  BECAUSE  ": ["compare_periods", "analyze_root_cause"],
    "": ["compare_periods"],
}


def tagged(spark, texts):
    questions = spark.createDataFrame([(text,) for text in texts], "question string")
    return {row[0]: row[1] for row in rows_of(tag_questions(questions, "question"))}


def test_questions(spark):
    found = tagged(spark, QUESTIONS)
    for text, between in QUESTIONS.items():
        assert found[text] == [
            "profile_dataset",
            "calculate_kpi_trend",
            *between,
            "generate_insight_summary",
        ]


def stepwise(change, root, anomaly, forecast, sql, summary):
    """The rules one after the other: analyses are added once, the summary if there is any reason."""
    plan = ["profile_dataset", "calculate_kpi_trend"]
    plan += ["compare_periods"] if change or root else []
    plan += ["analyze_root_cause"] if root else []
    plan += ["detect_anomalies"] if anomaly else []
    plan += ["forecast_kpi"] if forecast else []
    plan += ["run_sql_query"] if sql else []
    if summary or len(plan) > 2:
        return [*plan, "generate_insight_summary"]
    return [*plan, "compare_periods", "generate_insight_summary"]


def test_all_combinations_of_words(spark):
    lists = (CHANGE_WORDS, ROOT_CAUSE_WORDS, ANOMALY_WORDS, FORECAST_WORDS, SQL_WORDS, SUMMARY_WORDS)
    cases = {
        " / ".join(words[0] for words, use in zip(lists, flags) if use): flags
        for flags in itertools.product([False, True], repeat=6)
    }
    found = tagged(spark, cases)
    assert found == {text: stepwise(*flags) for text, flags in cases.items()}


@pytest.mark.parametrize("words", [CHANGE_WORDS, ROOT_CAUSE_WORDS, FORECAST_WORDS, SUMMARY_WORDS])
def test_every_word_counts(spark, words):
    plans = {tuple(plan) for plan in tagged(spark, [word.upper() for word in words]).values()}
    assert len(plans) == 1


def test_missing_text(spark):
    questions = spark.createDataFrame([(None,)], "question string")
    assert rows_of(tag_questions(questions, "question"))[0][1] == [
        "profile_dataset",
        "calculate_kpi_trend",
        "compare_periods",
        "generate_insight_summary",
    ]
