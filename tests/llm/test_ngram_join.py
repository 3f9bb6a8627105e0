"""The n-gram join against a comparison of all pairs."""

import pytest
from llm_tables import documents, near_copies, plain_components, some_words

from tallyframe.llm import ngram_join as nj
from tallyframe.llm.components import contracted


def rows_of(found):
    return sorted(tuple(r)[:3] for r in found.select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (3, 60)])
def test_equal_to_all_pairs(spark, monkeypatch, width, percent):
    monkeypatch.setattr(nj, "BLOCK_ENTRIES", 200)
    monkeypatch.setattr(nj, "HELD_ENTRIES", 500)
    texts = near_copies()
    found = nj.jaccard_components(documents(spark, texts), width, percent)
    assert rows_of(found) == sorted(plain_components(list(enumerate(texts)), width, percent))


def test_no_pivot_rounds(spark, monkeypatch):
    monkeypatch.setattr(nj, "ROUNDS", 0)
    texts = near_copies(8)
    assert rows_of(nj.jaccard_components(documents(spark, texts))) == sorted(plain_components(list(enumerate(texts)), 4, 85))


def test_hot_columns_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(nj, "HOT_LEAST", 2)
    texts = near_copies(9)
    assert rows_of(nj.jaccard_components(documents(spark, texts))) == sorted(plain_components(list(enumerate(texts)), 4, 85))


@pytest.mark.parametrize("most", [0, 5, 100])
def test_hot_columns_are_bounded_by_a_number(spark, monkeypatch, most):
    monkeypatch.setattr(nj, "HOT_LEAST", 2)
    monkeypatch.setattr(nj, "HOT_MOST", most, raising=False)
    texts = near_copies(9)
    docs = documents(spark, texts)
    found = nj.membership(docs, "doc_id", "text", 4)
    values, times = nj.hot_columns(found, len(texts))
    counts = {r[0]: r[1] for r in found.where("n is null").groupBy("shingle").sum("m").collect()}
    assert len(values) <= most < len(counts) and sorted(values.tolist()) == values.tolist()
    assert [counts[v] for v in values.tolist()] == times.tolist()
    if most == 100:
        assert len(values) and rows_of(nj.jaccard_components(docs)) == sorted(plain_components(list(enumerate(texts)), 4, 85))


def test_repeated_and_null_ids(spark):
    base = " ".join(some_words(1, 40))
    texts, ids = [base, base + " x", base, "lonely words here now", base], [None, 7, 7, None, 3]
    found = nj.ngram_jaccard_join(documents(spark, texts, ids=ids)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in found) == [(0, 0), (0, 3), (3, 3), (7, 3), (7, 3)]


def test_empty_tables(spark):
    assert nj.ngram_jaccard_join(documents(spark, [])).count() == 0
    assert rows_of(nj.ngram_jaccard_join(documents(spark, [None, ""]))) == [(0, 0, 0), (1, 0, 1)]


def test_a_long_chain(spark):
    links = spark.createDataFrame([(f"{i * 7919 % 101:03d}", f"{(i + 1) * 7919 % 101:03d}") for i in range(100)], "a string, b string")
    labels = spark.createDataFrame([(f"{i:03d}", f"{i:03d}") for i in range(103)], "node string, label string")
    found = dict(map(tuple, contracted(labels, links).collect()))
    assert len(found) == 103 and {found[f"{i:03d}"] for i in range(101)} == {"000"} and found["102"] == "102"


def test_packing_round_trip():
    values = nj.shingles(" ".join(some_words(1, 50)), 4, nj.WordHashes()) & nj._LOW48
    assert (nj.unpack(nj.pack(values)) == values).all()
