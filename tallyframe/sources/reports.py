"""Writing the report table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REPORT_SCHEMA = "row_no int, payload string, section string"


def write_report(report: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a report (section, row_no, payload) with one folder per section."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"a report is written as parquet or json, not {fmt}")
    report.write.mode(mode).partitionBy("section").format(fmt).save(path)


def read_report(
    spark: SparkSession, path: str, fmt: str = "parquet", keys: str | None = None
) -> DataFrame:
    """A written report; ``keys`` names and types the columns of its series, as in ``region string``."""
    schema = f"{keys}, {REPORT_SCHEMA}" if keys else REPORT_SCHEMA
    report = spark.read.schema(schema).format(fmt).load(path)
    own = [name for name in report.columns if name not in ("section", "row_no", "payload")]
    return report.select(*own, "section", "row_no", "payload")
