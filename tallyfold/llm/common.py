"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyfold.session import scratch_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write a table below the shared folder and read it back: what follows neither recomputes it nor depends on one executor."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``fn`` (record batch in, columns out) to every Arrow batch; ``schema`` is the DDL of what it returns."""
    return map_stream(df, lambda batches: (fn(b) for b in batches), schema)


def map_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """As ``map_batches``, with the whole stream of a partition's batches at hand."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)
