"""Sinks: exports, append logs, and table upserts expressed as joins and overwrites.

Plain files have no MERGE, so an upsert writes the merged table to a new version folder and the
reader moves on to it; nothing is changed in place, so a failed run leaves the old version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def export_sections(sections: dict[str, DataFrame], path: str) -> None:
    """One CSV folder per report section. Sections are small reports, so one file each."""
    for name, df in sections.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/stats_{name}")


def export_table(df: DataFrame, path: str, parquet: bool = True, csv: bool = True) -> None:
    if csv:
        df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{path}/csv")
    if parquet:
        df.write.mode("overwrite").parquet(f"{path}/parquet")


def append_log(df: DataFrame, path: str) -> None:
    """Append JSON lines; a row is one self-contained entry."""
    df.write.mode("append").json(path)


def insert_missing(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: target plus the first new row of every unseen key."""
    keys = list(key)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in new.columns])
    one = new.withColumn("_rn", F.row_number().over(w)).where("_rn <= 1").drop("_rn")
    return target.unionByName(one.join(target.select(*keys), keys, "left_anti"))


def upsert(target: DataFrame, new: DataFrame, key: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Insert-or-update of chosen columns; the others keep the stored value.

    ``new`` must hold one row per key.
    """
    keys = list(key)
    n = new.withColumn("_new", F.lit(True))
    o = target.withColumn("_old", F.lit(True))
    rest = [c for c in target.columns if c not in keys]
    j = o.join(n.select(*keys, "_new", *[F.col(c).alias(f"_n_{c}") for c in rest if c in new.columns]), keys, "full")
    out = []
    for c in rest:
        if c not in new.columns:
            out.append(F.col(c))
        elif c in update:
            out.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c))
    return j.select(*keys, *out)


def replace_children(target: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Delete-then-insert: all child rows of the touched parents are replaced."""
    return target.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def write_version(df: DataFrame, base: str, version: int) -> str:
    path = f"{base}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path
