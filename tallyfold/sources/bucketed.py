"""Tables whose upserts rewrite only what they touch: rows are dealt into hash buckets of their key, one folder each.

An upsert reads the buckets of the new keys, merges them, and replaces those folders by dynamic partition overwrite. The merged
rows are written aside first, so nothing is read while it is replaced; the files of all other buckets stay as they are. The number of buckets is part
of the table and is kept beside it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfold.session import written
from tallyfold.sources import sinks

BUCKET = "bucket"
LAYOUT = "key array<string>, buckets int"


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(buckets)).cast("int")


def _replace(df: DataFrame, path: str) -> None:
    """Write whole buckets; those that ``df`` doesn't hold are left alone. Large buckets become several files."""
    out = df.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(BUCKET).parquet(f"{path}/data")


def create(df: DataFrame, path: str, key: Sequence[str], buckets: int) -> None:
    df.sparkSession.createDataFrame([(list(key), buckets)], LAYOUT).coalesce(1).write.parquet(f"{path}/layout")
    _replace(df.withColumn(BUCKET, bucket_of(key, buckets)), path)


def layout(spark: SparkSession, path: str) -> tuple[list[str], int]:
    r = spark.read.schema(LAYOUT).parquet(f"{path}/layout").first()
    return list(r["key"]), r["buckets"]


def _rows(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    d = spark.read.parquet(f"{path}/data")
    return d if buckets is None else d.where(F.col(BUCKET).isin(buckets))


def read(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path).drop(BUCKET)


def _touched(new: DataFrame) -> list[int]:
    """The buckets of the new rows: no more than the table has."""
    return sorted(r[0] for r in new.select(BUCKET).distinct().collect())


def upsert(spark: SparkSession, path: str, new: DataFrame, update: Sequence[str]) -> list[int]:
    """Insert-or-update the chosen columns (none: insert-or-ignore); ``new`` has one row per key. Returns the buckets that were rewritten."""
    key, n = layout(spark, path)
    dealt = written(new.withColumn(BUCKET, bucket_of(key, n)), "bucket-new")  # computed once for its buckets and the merge
    hit = _touched(dealt)
    if hit:
        _replace(written(sinks.upsert(_rows(spark, path, hit), dealt, [*key, BUCKET], update), "bucket-merge"), path)
    return hit


def replace_children(spark: SparkSession, path: str, new: DataFrame, parents: DataFrame | None = None) -> list[int]:
    """Delete-then-insert in a table keyed by the parent: all children of the touched parents are replaced.

    ``parents`` names touched parents beyond those that ``new`` has children of; they lose theirs.
    """
    key, n = layout(spark, path)
    dealt = written(new.withColumn(BUCKET, bucket_of(key, n)), "bucket-new")  # computed once for its parents and the merge
    touched = dealt.select(*key) if parents is None else dealt.select(*key).unionByName(parents.select(*key))
    touched = written(touched.distinct().withColumn(BUCKET, bucket_of(key, n)), "bucket-touched")
    hit = _touched(touched)
    if hit:
        kept = _rows(spark, path, hit).join(touched, [*key, BUCKET], "left_anti")
        merged = written(kept.unionByName(dealt), "bucket-merge")
        _replace(merged, path)
        empty = set(hit) - {r[0] for r in merged.select(BUCKET).distinct().collect()}
        if empty:  # a bucket that lost its last row has nothing to be replaced with
            _clear(spark, path, sorted(empty))
    return hit


def _clear(spark: SparkSession, path: str, buckets: list[int]) -> None:
    """Leave buckets without rows: a file without rows is put in place of theirs."""
    kind = spark.read.parquet(f"{path}/data").drop(BUCKET).schema
    for b in buckets:
        spark.createDataFrame([], kind).write.mode("overwrite").parquet(f"{path}/data/{BUCKET}={b}")


def rebucket(spark: SparkSession, path: str, target: str, buckets: int) -> None:
    """The table again with another number of buckets."""
    create(read(spark, path), target, layout(spark, path)[0], buckets)
