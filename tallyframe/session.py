"""Session set-up and durable intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine.

    On a cluster the session comes from ``spark-submit`` and names a shared
    folder in ``spark.checkpoint.dir``; ``split_hot_keys`` makes the other setting.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    split_hot_keys(spark)
    return spark


def split_hot_keys(spark: SparkSession) -> None:
    """Let AQE split the hot keys of sort-merge joins.

    Forced, because by default Spark keeps a skewed partition whole when the
    next step could reuse the join's partitioning; one more shuffle of
    aggregated rows is cheaper than one task with a third of the table.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, used for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyframe-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there.

    For small results used several times: a lost executor then costs a re-read
    of the small result, not another scan of the base table.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
