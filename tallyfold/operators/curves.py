"""Threshold sweeps and exact ROC / precision-recall curves from score counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyfold.operators.scan import running_totals

THRESHOLDS = [round(0.10 + 0.05 * i, 2) for i in range(17)]


def threshold_sweep(rows: DataFrame, score: Column, truth: Column, money: Column | None = None, thresholds=THRESHOLDS) -> DataFrame:
    """Confusion counts and money per threshold.

    Each row is counted once, under the highest threshold it reaches; suffix sums over that
    handful of buckets give every threshold, so rows are never multiplied by thresholds.
    """
    f = F.col
    m = money if money is not None else F.lit(0)
    reached = F.size(F.filter(F.array(*[F.lit(x) for x in thresholds]), lambda x: x <= score))
    b = rows.groupBy(reached.alias("bucket")).agg(
        F.sum(F.when(truth, 1).otherwise(0)).alias("p"), F.sum(F.when(truth, 0).otherwise(1)).alias("q"),
        F.sum(F.when(truth, m).otherwise(0)).alias("mp"), F.sum(F.when(truth, 0).otherwise(m)).alias("mq"),
    )
    grid = rows.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate([0.0, *thresholds])], "bucket int, threshold double")
    g = grid.join(b, "bucket", "left").fillna(0)
    above = Window.partitionBy(F.lit(1)).orderBy(f("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(1))
    s = g.select("bucket", "threshold", *[F.sum(x).over(above).alias(x) for x in ("p", "q", "mp", "mq")], *[F.sum(x).over(whole).alias(f"all_{x}") for x in ("p", "q", "mp")])
    s = s.where("bucket > 0")
    prec = f("p") / (f("p") + f("q") + 1e-9)
    rec = f("p") / (f("all_p") + 1e-9)
    return s.select(
        "threshold", f("p").alias("tp"), f("q").alias("fp"), (f("all_p") - f("p")).alias("fn"), (f("all_q") - f("q")).alias("tn"),
        prec.alias("precision"), rec.alias("recall"), (2 * prec * rec / (prec + rec + 1e-9)).alias("f1"),
        f("mp").alias("caught"), (f("all_mp") - f("mp")).alias("missed"), f("mq").alias("false_alarm"),
    )


def best_f1(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.col("f1").desc(), "threshold").limit(1).select("threshold", "f1")


def _ranked(rows: DataFrame, score: Column, truth: Column) -> DataFrame:
    f = F.col
    h = rows.groupBy(score.cast("double").alias("score")).agg(F.sum(F.when(truth, 1).otherwise(0)).alias("pos"), F.sum(F.when(truth, 0).otherwise(1)).alias("neg"))
    return running_totals(h, [], [f("score").desc()], {"tp": f("pos"), "fp": f("neg")}, -f("score"), totals=True)


def curve_points(rows: DataFrame, score: Column, truth: Column) -> DataFrame:
    f = F.col
    return _ranked(rows, score, truth).select(
        "score", (f("tp") / f("tp_total")).alias("tpr"), (f("fp") / f("fp_total")).alias("fpr"), (f("tp") / (f("tp") + f("fp"))).alias("precision")
    )


def curve_areas(rows: DataFrame, score: Column, truth: Column) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision."""
    f = F.col
    r = _ranked(rows, score, truth)
    auc = F.sum(f("pos") * (f("fp_total") - f("fp") + f("neg") / 2.0)) / F.max(f("tp_total") * f("fp_total"))
    ap = F.sum(f("pos") / f("tp_total") * (f("tp") / (f("tp") + f("fp"))))
    return r.agg(auc.alias("auc"), ap.alias("average_precision"))
