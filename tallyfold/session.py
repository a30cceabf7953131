"""Session defaults and the shared folder used for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("tallyfold")
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    b = (
        b.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
    )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests, laptops) is a local folder made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = os.environ.get("TALLYFOLD_SCRATCH")
    if not path:
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        os.environ["TALLYFOLD_SCRATCH"] = path
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one run's output."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The table written below the shared folder and read back, so that its several readers do not compute it again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slice_count(spark: SparkSession) -> int:
    """How many ordered slices a distributed scan cuts a table into."""
    return max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
