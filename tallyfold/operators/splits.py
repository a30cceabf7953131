"""Walk-forward splits by session start."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyfold.operators.scan import running_totals


def session_splits(rows: DataFrame, at: str = "date_utc") -> DataFrame:
    """train / val / test per session: the first 60 %, next 20 %, rest by first activity."""
    f = F.col
    s = rows.groupBy("session_id").agg(F.min(at).alias("started"))
    s = running_totals(s, [], [f("started"), f("session_id")], {"place": F.lit(1)}, F.unix_micros(f("started").cast("timestamp")), totals=True, tie=f("session_id"))
    n = f("place_total")
    train = F.greatest(F.lit(1), F.floor(n * 0.6))
    val = F.greatest(train + 1, F.floor(n * 0.8))
    split = F.when(f("place") <= train, "train").when(f("place") <= val, "val").otherwise("test")
    return s.select("session_id", split.alias("split"))


def walk_forward(rows: DataFrame, at: str = "date_utc") -> DataFrame:
    return rows.join(session_splits(rows, at), "session_id")


def split_baseline(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Majority label of the training rows and its accuracy on the test rows."""
    f = F.col
    c = labelled.groupBy("split", label).agg(F.count("*").alias("n"))
    top = c.where("split = 'train'").agg(F.max_by(label, F.struct(f("n"))).alias("m"))
    t = c.withColumn("_m", top.scalar()).where("split = 'test'")
    return t.agg(F.max("_m").alias("baseline_label"), (F.sum(F.when(f(label) == f("_m"), f("n")).otherwise(0)) / F.sum("n")).alias("baseline_accuracy"))
