"""Start a stream, let it drain what is there, and read back what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyfold.operators.dedupe import top_per_key
from tallyfold.session import scratch_path


def files(spark: SparkSession, path: str, schema: T.StructType, per_batch: int | None = None) -> DataFrame:
    """A growing folder of Parquet files as a stream; ``per_batch`` limits the files of a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)


def append(stream: DataFrame, label: str, base: str | None = None) -> DataFrame:
    """Run to the end of the available input into a file sink (exactly once) and read it."""
    spark = stream.sparkSession
    base = base or scratch_path(spark, label)
    q = (
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def batches(stream: DataFrame, label: str, step: Callable[[DataFrame, int, str], None], mode: str = "append", base: str | None = None) -> str:
    """Drain through a per-batch function; a replayed batch gets the same id and folder."""
    base = base or scratch_path(stream.sparkSession, label)
    q = (
        stream.writeStream.foreachBatch(lambda df, i: step(df, i, base)).option("checkpointLocation", f"{base}/checkpoint")
        .outputMode(mode).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return base


def updates(stream: DataFrame, label: str, keys: Sequence[str | Column], base: str | None = None) -> DataFrame:
    """Drain an update-mode aggregate and return the newest row of every key."""

    def step(df: DataFrame, i: int, b: str) -> None:
        df.write.mode("overwrite").parquet(f"{b}/out/batch={i}")

    base = batches(stream, label, step, "update", base)
    rows = stream.sparkSession.read.parquet(f"{base}/out")
    return top_per_key(rows, list(keys), [F.col("batch").desc()]).drop("batch")


def final(stream: DataFrame, label: str, base: str | None = None) -> DataFrame:
    """Drain an aggregate in complete mode and return its last state, so rows in any order of arrival count."""

    def step(df: DataFrame, i: int, b: str) -> None:
        df.write.mode("overwrite").parquet(f"{b}/out/batch={i}")

    base = batches(stream, label, step, "complete", base)
    rows = stream.sparkSession.read.parquet(f"{base}/out")
    return rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")
