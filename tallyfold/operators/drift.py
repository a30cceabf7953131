"""Distribution drift: population stability, two-sample distance, retraining decision.

Input is long: (feature, v, is_current). Equal values collapse into counts before any
shuffle, and the cumulative distributions come from distributed running counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyfold.functions import fixed_values as fv
from tallyfold.operators.scan import exact_quantiles, running_totals


def long_form(df: DataFrame, columns: list[str], is_current: Column) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("v")) for x in columns])
    return df.select(is_current.alias("is_current"), F.explode(pairs).alias("p")).select("p.feature", "p.v", "is_current")


def _counts(long: DataFrame) -> DataFrame:
    return long.where(F.col("v").isNotNull()).groupBy("feature", "v").agg(
        F.sum(F.when(F.col("is_current"), 0).otherwise(1)).alias("nb"), F.sum(F.when(F.col("is_current"), 1).otherwise(0)).alias("nc")
    )


def ks(long: DataFrame) -> DataFrame:
    """Largest gap between the two cumulative shares, with the asymptotic p-value."""
    f = F.col
    r = running_totals(_counts(long), ["feature"], [f("v")], {"cb": f("nb"), "cc": f("nc")}, f("v"), totals=True)
    d = r.groupBy("feature").agg(
        F.max(F.abs(f("cb") / f("cb_total") - f("cc") / f("cc_total"))).alias("ks"), F.max("cb_total").alias("n_base"), F.max("cc_total").alias("n_current")
    )
    lam = F.sqrt(f("n_base") * f("n_current") / (f("n_base") + f("n_current")).cast("double")) * f("ks")
    d = d.withColumn("_l", lam)
    tail = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * k * k * f("_l") * f("_l"))
    )
    return d.withColumn("p_value", F.when(f("_l") < 0.05, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))).drop("_l")


def mean_shift(long: DataFrame) -> DataFrame:
    """Plain fallback test: mean difference in baseline deviations, capped at one."""
    f = F.col
    g = moments(long)
    stat = F.least(F.abs(f("base_mean") - f("cur_mean")) / (f("base_std") + 1e-9), F.lit(1.0))
    return g.select("feature", stat.alias("stat"), F.when(stat > 0.3, 0.01).otherwise(0.99).alias("p_value"))


def moments(long: DataFrame) -> DataFrame:
    b = F.when(~F.col("is_current"), F.col("v"))
    c = F.when(F.col("is_current"), F.col("v"))
    return long.where(F.col("v").isNotNull()).groupBy("feature").agg(
        F.avg(b).alias("base_mean"), F.stddev_pop(b).alias("base_std"), F.avg(c).alias("cur_mean"), F.stddev_pop(c).alias("cur_std")
    )


def psi(long: DataFrame, buckets: int = 10) -> DataFrame:
    """Stability index over baseline quantile bins; values outside the baseline range fall out,
    the last bin is closed on the right, shares are smoothed with half a row per bin."""
    f = F.col
    names = {f"e{i}": i / buckets for i in range(buckets + 1)}
    q = exact_quantiles(long.where(~f("is_current")), ["feature"], f("v"), names)
    edges = q.select("feature", F.array_distinct(F.array(*names)).alias("edges"))
    bins = F.size("edges") - 1
    h = _counts(long)
    totals = h.groupBy("feature").agg(F.sum("nb").alias("tb"), F.sum("nc").alias("tc"))
    place = F.size(F.filter("edges", lambda e: e <= f("v")))
    j = h.join(edges, "feature").withColumn("bin", F.when(f("v") == F.array_max("edges"), bins).otherwise(place))
    c = j.where((f("bin") >= 1) & (f("bin") <= bins)).groupBy("feature", "bin").agg(F.sum("nb").alias("b"), F.sum("nc").alias("c"))
    grid = edges.where(bins >= 1).select("feature", F.explode(F.sequence(F.lit(1), bins)).alias("bin"))
    x = grid.join(c, ["feature", "bin"], "left").join(totals, "feature")
    half = buckets * 0.5
    bp = (F.coalesce(f("b"), F.lit(0)) + 0.5) / (f("tb") + half)
    cp = (F.coalesce(f("c"), F.lit(0)) + 0.5) / (f("tc") + half)
    s = x.groupBy("feature").agg(F.sum((cp - bp) * F.log(cp / bp)).alias("psi"))
    return totals.select("feature").join(s, "feature", "left").select("feature", F.greatest(F.lit(0.0), F.coalesce("psi", F.lit(0.0))).alias("psi"))


def check(long: DataFrame, min_current: int = 10) -> DataFrame:
    """One row per feature: moments, distance, p-value, stability and the drift flag."""
    f = F.col
    j = ks(long).where(f("n_current") >= min_current).join(psi(long), "feature").join(moments(long), "feature")
    return j.withColumn("drift_detected", (f("p_value") < fv.KS_ALPHA) | (f("psi") > fv.PSI_LIMIT))


def decision(report: DataFrame, critical: list[str] | None = None) -> DataFrame:
    """Retrain when at least two critical features drifted."""
    crit = F.col("drift_detected") & F.col("feature").isin(*(critical or fv.CRITICAL_FEATURES))
    r = report.agg(F.count("*").alias("features"), F.array_sort(F.collect_set(F.when(crit, F.col("feature")))).alias("c"))
    return r.select("features", F.array_join("c", ",").alias("critical_features"), (F.size("c") >= 2).alias("should_retrain"))
