"""Week-over-week comparison: both weeks carry a label column and run through one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyfold.functions import fixed_values as fv, play
from tallyfold.functions.numeric import count_where, finite
from tallyfold.operators.streaks import tilt
from tallyfold.plans import leaks as lk

PREVIOUS, CURRENT = "Semana Anterior", "Semana Atual"


def network_filter(network: str, column: str = "source_file") -> Column:
    """Source filter by network name; unknown names keep everything."""
    src = F.upper(F.coalesce(F.col(column), F.lit("")))
    n = (network or "WPN").upper()
    if n in ("WPN", "ACR"):
        return src.like("%ACR%")
    if n in ("POKERSTARS", "PS"):
        return src.like("%POKERSTARS%")
    return F.lit(True)


def with_week(hands: DataFrame) -> DataFrame:
    """Label the last seven days and the seven before, anchored at the newest day; drop the rest."""
    anchor = hands.agg(F.max(F.to_date("date_utc")).alias("a"))
    d = hands.where(F.col("date_utc").isNotNull()).withColumn("_a", anchor.scalar())
    day = F.to_date("date_utc")
    week = F.when((day > F.date_sub("_a", 7)) & (day <= F.col("_a")), CURRENT).when((day > F.date_sub("_a", 14)) & (day <= F.date_sub("_a", 7)), PREVIOUS)
    return d.withColumn("week_label", week).where("week_label IS NOT NULL").drop("_a")


def bb100() -> Column:
    """Big blinds per hundred rows; rows without a blind add zero."""
    won = F.coalesce(F.try_divide(F.col("won_cents").cast("double"), F.nullif(F.col("big_blind"), F.lit(0))), F.lit(0.0))
    return F.sum(won) / F.greatest(F.count("*"), F.lit(1)) * 100.0


def kpis(weeks: DataFrame) -> DataFrame:
    stack = F.coalesce(F.try_divide(F.col("hero_stack_start").cast("double"), F.nullif(F.col("big_blind"), F.lit(0))), F.lit(0.0))
    in_band = (play.seat("hero_position") == "SB") & stack.between(15, 25)
    return weeks.groupBy("week_label").agg(
        F.count("*").alias("hands"), F.round(bb100(), 4).alias("bb100"), F.round(F.coalesce(F.avg(F.when(in_band, finite("hero_pfr"))), F.lit(0.0)), 4).alias("sb_pfr_15_25bb")
    )


def position_delta(weeks: DataFrame) -> DataFrame:
    """Per seat: current, previous and their difference; a seat missing from a week counts as zero."""
    g = weeks.groupBy("week_label", play.seat("hero_position").alias("position")).agg(F.round(bb100(), 4).alias("v"))
    cur = g.where(F.col("week_label") == CURRENT).select("position", F.col("v").alias("current_bb100"))
    prev = g.where(F.col("week_label") == PREVIOUS).select("position", F.col("v").alias("previous_bb100"))
    j = cur.join(prev, "position", "full").fillna(0.0)
    return j.withColumn("delta_bb100", F.round(F.col("current_bb100") - F.col("previous_bb100"), 4))


def error_counts(prep: DataFrame, key: str, min_rows: int = 12) -> DataFrame:
    """Detections per slice (day or week); slices under the minimum report zero."""
    det = lk.detect(prep, [key])
    c = det.groupBy(key).agg(F.count("*").alias("e"), count_where(F.col("leak_code").isin(*fv.ICM_CODES)).alias("i"), count_where(F.col("leak_code") == "ICM_SUICIDE").alias("s"))
    n = prep.groupBy(key).agg(F.count("*").alias("n"))
    t = tilt(prep, [key]).select(key, F.lit(1).alias("t"))
    j = n.join(c, key, "left").join(t, key, "left").withColumn("e", F.coalesce("e", F.lit(0)) + F.coalesce("t", F.lit(0)))
    small = F.col("n") < min_rows
    return j.select(
        key, "n", *[F.when(small, 0).otherwise(F.coalesce(x, F.lit(0))).alias(y) for x, y in (("e", "technical_errors"), ("i", "icm_errors"), ("s", "icm_suicide"))]
    )


def series(day_counts: DataFrame, weeks: DataFrame) -> DataFrame:
    """Previous week's daily errors followed by the current week's."""
    days = weeks.select("hand_date", "week_label").distinct()
    j = day_counts.join(days, "hand_date")
    prev, cur = j.where(F.col("week_label") == PREVIOUS), j.where(F.col("week_label") == CURRENT)
    return prev.unionByName(cur)


def report(weeks: DataFrame, prep: DataFrame) -> DataFrame:
    """One row per KPI: previous, current, delta."""
    f = F.col
    k = kpis(weeks).join(error_counts(prep, "week_label").select("week_label", f("icm_suicide").cast("double").alias("icm_suicide")), "week_label", "left")
    names = ["hands", "bb100", "sb_pfr_15_25bb", "icm_suicide"]
    long = k.select("week_label", F.explode(F.array(*[F.struct(F.lit(n).alias("kpi"), f(n).cast("double").alias("v")) for n in names])).alias("x")).select("week_label", "x.*")
    g = long.groupBy("kpi").agg(*[F.coalesce(F.max(F.when(f("week_label") == w, f("v"))), F.lit(0.0)).alias(n) for n, w in (("previous", PREVIOUS), ("current", CURRENT))])
    return g.withColumn("delta", F.round(f("current") - f("previous"), 4))


def tilt_note(rows: DataFrame, column: str) -> DataFrame:
    """Discipline label from the mean risk."""
    a = rows.agg(F.avg(finite(column)).alias("a"))
    kind = F.when(F.col("a") < 15, "Excelente").when(F.col("a") < 30, "Moderada").otherwise("Critica")
    return a.select(
        F.when(F.col("a").isNull(), "Sem dados suficientes para nota de disciplina de tilt.").otherwise(
            F.concat(F.lit("Disciplina de Tilt: "), kind, F.lit(" (media "), F.format_string("%.1f", F.bround("a", 1)), F.lit("%)."))
        ).alias("note")
    )
