"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, mixing, BPE encoding.

Each stage works on all rows that its predecessor kept, written as Parquet and read again. All but
the last return the columns of ``documents``; the last returns the ids of each text of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.bpe import encode
from tallyframe.llm.mixing import mix
from tallyframe.llm.ngram_join import jaccard_components
from tallyframe.llm.quality import WORD, quality_filter
from tallyframe.llm.runtime import whole_text, written
from tallyframe.llm.secrets_scan import fitted, redact_secrets

#: Near-duplicates: five words, a similarity of 0.8 or more.
WIDTH, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_filter(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, null last.

    A row is known by its id and a digest of its text, which, unlike a number, stay the same when the
    table is read again with other splits. Of repeated rows of one id and text any one stays; texts
    without words are linked with nothing and all stay. The table of kept rows grows with the input, so
    it is never broadcast, however small it is.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.md5(whole_text()).alias("digest"))
    groups = jaccard_components(docs.select(key.alias("id"), "text"), WIDTH, PERCENT, id_column="id")
    kept = written(groups.where("id = component_id").select(F.col("id").alias("_key")), "kept")
    alone = F.when(~whole_text().rlike(WORD), F.monotonically_increasing_id())
    # In a struct, columns of the caller can't clash with those made here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), key.alias("_key"), alone.alias("_alone"))
    once = rows.join(kept.hint("merge"), "_key", "left_semi").groupBy("_key", "_alone").agg(F.first("_doc").alias("_doc"))
    return once.select("_doc.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by marks; n_chars follows the text."""
    done = redact_secrets(docs, fitted(docs))
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by the Poisson draws of their sources, shuffled."""
    return mix(docs).select("_doc.*")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text of the mix."""
    return encode(docs, keep=["doc_id", "lang", "source"]).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixing),
    ("BPE encoding", bpe_encoding),
]

#: The network of the secret scans can't be expressed in SQL; the tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
