"""Loss streaks (gaps and islands) and what follows them, per entity or over everything.

Positions and streak ids come from distributed running counts, so one entity with a third of
all rows is scanned in slices instead of in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyfold.operators.scan import running_totals
from tallyfold.session import written


def positioned(rows: DataFrame, keys: Sequence[str], loss: Column, at: str = "date_utc", tie: str = "id") -> DataFrame:
    """Adds pos (1-based place in time), wins (non-losses so far) and n (rows of the key)."""
    by = F.unix_micros(F.col(at).cast("timestamp"))
    rows = written(rows.withColumn("_loss", loss), "places")  # the scan reads its input three times
    r = running_totals(
        rows, keys, [F.col(at), F.col(tie)], {"pos": F.lit(1), "wins": F.when(F.col("_loss"), 0).otherwise(1)}, by, totals=True, tie=F.col(tie)
    )
    return r.withColumnRenamed("pos_total", "n").drop("wins_total")


def loss_streaks(pos: DataFrame, keys: Sequence[str], min_len: int = 3) -> DataFrame:
    """Runs of consecutive losses: the count of non-losses so far is constant inside a run."""
    g = pos.where("_loss").groupBy(*keys, "wins", "n").agg(
        F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count("*").alias("streak_len"), F.min_by("id", "pos").alias("first_id")
    )
    return g.where(F.col("streak_len") >= min_len).drop("wins")


def baseline(pos: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Means over the first max(20, min(80, n/2)) rows of each entity."""
    k = F.greatest(F.lit(20), F.least(F.lit(80), F.floor(F.col("n") / 2)))
    return pos.where(F.col("pos") <= k).groupBy(*keys).agg(*[F.avg(m).alias(f"base_{m}") for m in measures])


def after_streaks(pos: DataFrame, streaks: DataFrame, keys: Sequence[str], measures: Sequence[str], window: int = 6) -> DataFrame:
    """Means of the rows right after each streak; a streak at the very end has none."""
    want = streaks.select(*keys, "end_pos", F.explode(F.sequence(F.col("end_pos") + 1, F.col("end_pos") + window)).alias("pos"))
    got = want.join(pos.select(*keys, "pos", *measures), [*keys, "pos"])
    g = got.groupBy(*keys, "end_pos").agg(*[F.avg(m).alias(f"next_{m}") for m in measures])
    return streaks.join(g, [*keys, "end_pos"], "left")


def tilt(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Play-style shift after losing runs, one row per entity that shows it.

    Needs amount_bb, vpip, date_utc and id.
    """
    f = F.col
    keys = list(keys)
    pos = positioned(rows.select(*keys, "id", "date_utc", "amount_bb", "vpip"), keys, f("amount_bb") < 0)
    pos = written(pos, "tilt")  # what follows reads the places five times
    s = loss_streaks(pos, keys).where("n >= 30")
    s = after_streaks(pos, s, keys, ["vpip", "amount_bb"])
    b = baseline(pos, keys, ["vpip", "amount_bb"])
    total = pos.groupBy(*keys).agg(F.sum("amount_bb").alias("ev_real"))
    if keys:
        s = s.join(b, keys)
    else:
        one = b.select(F.struct("base_vpip", "base_amount_bb").alias("b"))
        s = s.withColumn("b", one.scalar()).select("*", "b.*").drop("b")
    dv, de = f("next_vpip") - f("base_vpip"), f("base_amount_bb") - f("next_amount_bb")
    score = F.when(f("next_vpip").isNotNull(), F.greatest(F.lit(0.0), dv) * 100.0 + F.greatest(F.lit(0.0), de) * 15.0 + f("streak_len") * 6.0)
    s = s.withColumns({"dv": dv, "de": de, "score": score})
    g = s.groupBy(*keys).agg(
        F.count("*").alias("streaks"), F.max("streak_len").alias("max_streak"), F.coalesce(F.avg("dv"), F.lit(0.0)).alias("vpip_delta"),
        F.coalesce(F.avg("de"), F.lit(0.0)).alias("ev_delta"), F.max("n").alias("sample_size"), F.max("score").alias("worst_score"),
        F.max_by("first_id", F.struct(f("score"), -f("start_pos"))).alias("hand_id"),
    )
    g = g.where((f("worst_score") > 0) & ~((f("vpip_delta") < 0.08) & (f("max_streak") < 4)))
    up = F.greatest(F.lit(0.0), f("vpip_delta"))
    g = g.withColumns({
        "confidence": F.least(F.lit(0.95), F.lit(0.45) + f("streaks") / 20.0 + F.least(F.lit(0.25), f("vpip_delta"))),
        "error_severity": F.least(F.lit(1.0), F.lit(0.55) + F.least(F.lit(0.25), f("max_streak") / 10.0) + F.least(F.lit(0.2), up)),
        "deviation_pct": F.least(F.lit(100.0), up * 100.0),
    })
    if keys:
        return g.join(total, keys)
    return g.withColumn("ev_real", total.scalar())
