"""Shared helpers: worker set-up, Arrow slices, durable tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import scratch_path

#: Rows handled at once inside a Python task, so that memory doesn't follow the Arrow batch.
SLICE_ROWS = 256


def ready_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by ``sys.path``."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [x for x in environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def map_arrow(df: DataFrame, task, schema: str) -> DataFrame:
    """``mapInArrow`` over small slices: ``task(slices)`` yields record batches."""
    ready_workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return task(sliced(batches))

    return df.mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts_of(batch: pa.RecordBatch, column: int = 0) -> list[str]:
    """The texts of a column; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there.

    It cuts the lineage like a checkpoint, and lets Spark see the size of the result.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(keep: list[str], name: str = "_text") -> str:
    """A name for a column of our own that no kept column has."""
    while name in keep:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
