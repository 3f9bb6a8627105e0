"""The pipeline against plain versions of its stages, and its queries on the given tables."""

import importlib
import uuid
from collections import Counter

import pytest
from llm_tables import documents, near_copies, plain_components, plain_secrets, some_words, sorted_rows
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm.oracles import LLM_ORACLES
from tallyframe.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = [*near_copies(3), *(" ".join(some_words(700 + i, 50, 9000)) for i in range(30)), "token=abcdef123456 " + " ".join(some_words(1, 40, 9000)), " ".join(["spam"] * 60)]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_keep_the_columns(spark, tmp_path):
    docs = documents(spark, TEXTS, ids=[*range(len(TEXTS) - 2), None, 0])
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(path := str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(path)
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids.count() == docs.count()


def test_one_document_of_each_group_stays(spark, tmp_path):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3])]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    docs.write.parquet(str(tmp_path / "docs"))
    kept = [r["doc_id"] for r in stage("n-gram Jaccard join")(spark, spark.read.parquet(str(tmp_path / "docs")), SF).collect()]
    want = {c for _, _, c in plain_components(rows, corpus_pipeline.WIDTH, corpus_pipeline.PERCENT)}
    assert Counter(kept) == Counter(want)


def test_groups_stay_right_when_rows_are_read_in_another_order(spark):
    order = F.udf(lambda: uuid.uuid4().hex).asNondeterministic()
    docs = documents(spark, TEXTS).withColumn("_order", order()).orderBy("_order").drop("_order")
    kept = [r["doc_id"] for r in stage("n-gram Jaccard join")(spark, docs, SF).collect()]
    want = {c for _, _, c in plain_components(list(enumerate(TEXTS)), corpus_pipeline.WIDTH, corpus_pipeline.PERCENT)}
    assert Counter(kept) == Counter(want)


def test_secrets_are_gone(spark):
    rows = {r["doc_id"]: r for r in stage("secret scans")(spark, documents(spark, TEXTS), SF).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        if text is not None:
            assert plain_secrets(rows[i]["text"]) == "" and rows[i]["n_chars"] == len(rows[i]["text"])
            assert (rows[i]["text"] == text) == (plain_secrets(text) == "")


def test_empty_table(spark):
    docs = documents(spark, [])
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, SF).count() == 0


def test_run(spark):
    found = corpus_pipeline.run(spark, SF).collect()
    assert found and all(r["n_tokens"] == len(r["ids"]) for r in found)


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_queries_equal_their_reference_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "conversations", "embeddings", "pages", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert sorted_rows(LLM_QUERIES[name](spark, SF)) == sorted_rows(connection.execute(LLM_ORACLES[name]).to_arrow_table())


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    assert set(LLM_QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
