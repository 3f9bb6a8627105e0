"""Poisson mixing: against its reference SQL, rates, shuffling."""

from collections import Counter

import pytest
from llm_tables import documents, oracle_rows, sorted_rows
from pyspark.sql import functions as F

from tallyframe.llm.mixing import mix, rates, source_mix
from tallyframe.llm.oracles import LLM_ORACLES

TEXTS = ["x" * (i % 40 + 1) for i in range(900)] + ["", None]


def test_equal_to_the_reference_sql(spark):
    docs = documents(spark, TEXTS, sources=("a", "a", "a", "b", None), ids=[*range(898), 5, None, None, 7])
    assert sorted_rows(source_mix(docs)) == oracle_rows(LLM_ORACLES["op6_source_mix"], documents=docs)


def test_characters_follow_the_targets(spark):
    docs = documents(spark, ["y" * 50] * 6000, sources=("a", "a", "a", "b"))
    found = mix(docs, {"a": 1.0, "b": 3.0}, epochs=2.0).groupBy("_doc.source").agg(F.sum(F.length("_doc.text"))).collect()
    sizes = {r[0]: r[1] / (6000 * 50) for r in found}
    assert sizes["a"] == pytest.approx(0.5, rel=0.1) and sizes["b"] == pytest.approx(1.5, rel=0.1)


def test_large_means_are_split(spark):
    docs = documents(spark, ["z" * 10] * 400, sources=["rare"] * 4 + ["big"] * 396)
    table = {r["_source"]: r for r in rates(docs, {"rare": 1.0, "big": 0.0}).collect()}
    assert table["rare"]["rate"] == pytest.approx(100) and table["rare"]["parts"] == 7
    counts = Counter(r["doc_id"] for r in mix(docs, {"rare": 1.0, "big": 0.0}).select("_doc.doc_id").collect())
    assert len(counts) == 4 and all(60 < n < 140 for n in counts.values())


def test_copies_keep_all_columns_and_are_spread(spark):
    docs = documents(spark, TEXTS)
    mixed = mix(docs, epochs=3.0)
    assert mixed.select("_doc.*").columns == docs.columns
    places = [r["_place"] for r in mixed.select("_place").collect()]
    assert len(set(places)) == len(places)


def test_sources_without_characters_and_empty_tables(spark):
    assert mix(documents(spark, ["", None])).count() == 0
    assert source_mix(documents(spark, [])).count() == 0
