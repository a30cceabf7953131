"""Keep-one-row-per-key operators and ranked picks.

All filter ``row_number() <= k`` right after the window, which Spark turns into a
group limit on the map side: a hot key ships at most k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def keep_latest_per_site(df: DataFrame) -> DataFrame:
    """One row per (hand_id, site): the last by time then id; an undated row counts as last."""
    site = F.upper(F.coalesce(F.col("site_name"), F.lit("UNKNOWN")))
    return top_per_key(
        df.withColumn("site_name", site), ["hand_id", "site_name"], [F.col("date_utc").desc_nulls_first(), F.col("id").desc()]
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, keys, order)


def label_per_fact(labels: DataFrame) -> DataFrame:
    """The most severe, then most confident label of every fact."""
    return top_per_key(
        labels,
        ["hand_id"],
        [F.col("study_severity_score").desc(), F.col("study_confidence").desc(), F.col("study_leak_code").asc()],
    )


def most_common(df: DataFrame, item: Column, name: str, k: int | None = None) -> DataFrame:
    """Multiset counts, largest first, ties by item; the k largest if k is given."""
    out = df.groupBy(item.alias(name)).agg(F.count("*").alias("n"))
    return out.orderBy(F.col("n").desc(), F.col(name)).limit(k) if k else out


def distinct_in_order(arr: Column) -> Column:
    return F.array_distinct(arr)
