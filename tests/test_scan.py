"""Ordered scans against plain windows, with one key holding most rows."""

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from tallyfold.operators import curves, drift, scan, splits, streaks


@pytest.fixture(scope="module")
def skewed(spark):
    """6,000 rows; key 0 holds two thirds and a third of all values are equal."""
    d = spark.range(6000).withColumn("k", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7))
    d = d.withColumn("v", F.when(F.col("id") % 3 == 1, 5.0).otherwise((F.col("id") * 7919 % 1009).cast("double")))
    return d.withColumn("date_utc", F.expr("timestamp_seconds(1700000000 + id * 61 % 86400)")).cache()


def test_running_totals_match_a_window(skewed):
    r = scan.running_totals(skewed, ["k"], [F.col("v"), F.col("id")], {"pos": F.lit(1), "tot": F.col("v")}, F.col("v"), totals=True)
    w = W.partitionBy("k").orderBy("v", "id").rowsBetween(W.unboundedPreceding, 0)
    want = skewed.select("id", F.row_number().over(W.partitionBy("k").orderBy("v", "id")).alias("p"), F.sum("v").over(w).alias("t"), F.count("*").over(W.partitionBy("k")).alias("n"))
    bad = r.join(want, "id").where((F.col("pos") != F.col("p")) | (F.abs(F.col("tot") - F.col("t")) > 1e-6) | (F.col("pos_total") != F.col("n")))
    assert r.count() == 6000 and bad.count() == 0


def test_slices_split_a_hot_key(skewed):
    s = scan.add_slice(skewed.where("k = 0 AND v <> 5"), F.col("v"), 16)
    sizes = [r["count"] for r in s.groupBy(scan.SLICE).count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 3 * 2000 / 16


def test_a_repeated_sort_value_is_cut_by_the_tie(skewed):
    d = skewed.where("k = 0").withColumn("t", F.when(F.col("id") % 4 < 3, 100).otherwise(F.col("id")))
    sizes = [r["count"] for r in scan.add_slice(d, F.col("t"), 16, tie=F.col("id")).groupBy(scan.SLICE).count().collect()]
    n = d.count()
    assert sum(sizes) == n and max(sizes) < 3 * n / 16
    r = scan.running_totals(d, ["k"], [F.col("t"), F.col("id")], {"pos": F.lit(1)}, F.col("t"), tie=F.col("id"), slices=16)
    want = d.select("id", F.row_number().over(W.partitionBy("k").orderBy("t", "id")).alias("p"))
    assert r.join(want, "id").where(F.col("pos") != F.col("p")).count() == 0


def test_exact_quantiles_match_numpy(skewed):
    q = {r["k"]: r for r in scan.exact_quantiles(skewed, ["k"], F.col("v"), {"a": 0.1, "b": 0.5, "c": 0.9}).collect()}
    for k, part in skewed.toPandas().groupby("k"):
        for name, p in (("a", 10), ("b", 50), ("c", 90)):
            assert q[k][name] == pytest.approx(np.percentile(part.v, p))


def test_carry_forward(skewed):
    d = skewed.withColumn("x", F.when(F.col("id") % 50 == 0, F.col("id")))
    got = scan.carry_forward(d, ["k"], ["date_utc", "id"], ["x"], F.unix_micros("date_utc"))
    w = W.partitionBy("k").orderBy("date_utc", "id").rowsBetween(W.unboundedPreceding, 0)
    want = d.select("id", F.last("x", ignorenulls=True).over(w).alias("y"))
    assert got.join(want, "id").where(~F.col("x").eqNullSafe(F.col("y"))).count() == 0


def test_streaks_by_brute_force(skewed):
    loss = F.col("v") < 500
    pos = streaks.positioned(skewed, ["k"], loss)
    got = {(r["k"], r["start_pos"], r["end_pos"]) for r in streaks.loss_streaks(pos, ["k"]).collect()}
    want = set()
    for k, part in skewed.toPandas().sort_values(["date_utc", "id"]).groupby("k"):
        run = 0
        flags = list(part.v < 500) + [False]
        for i, f in enumerate(flags, 1):
            if f:
                run += 1
            else:
                if run >= 3:
                    want.add((k, i - run, i - 1))
                run = 0
    assert got == want


def test_walk_forward_orders_sessions(spark):
    d = spark.range(100).select((F.col("id") % 10).alias("session_id"), F.expr("timestamp_seconds(1700000000 + (id % 10) * 100 + id)").alias("date_utc"))
    s = {r["session_id"]: r["split"] for r in splits.session_splits(d).collect()}
    assert [s[i] for i in range(10)] == ["train"] * 6 + ["val"] * 2 + ["test"] * 2


def test_psi_and_ks_match_numpy(spark):
    rng = np.random.default_rng(3)
    base, cur = rng.normal(60, 15, 300).clip(0, 100), rng.normal(15, 5, 100).clip(0, 100)
    rows = [("x", float(v), False) for v in base] + [("x", float(v), True) for v in cur]
    long = spark.createDataFrame(rows, "feature string, v double, is_current boolean")
    edges = np.unique(np.percentile(base, np.linspace(0, 100, 11)))
    b = (np.histogram(base, edges)[0] + 0.5) / (len(base) + 5)
    c = (np.histogram(cur, edges)[0] + 0.5) / (len(cur) + 5)
    assert drift.psi(long).first()["psi"] == pytest.approx(max(0, ((c - b) * np.log(c / b)).sum()))
    both = np.sort(np.concatenate([base, cur]))
    d = np.abs(np.searchsorted(np.sort(base), both, "right") / len(base) - np.searchsorted(np.sort(cur), both, "right") / len(cur)).max()
    k = drift.ks(long).first()
    assert k["ks"] == pytest.approx(d) and k["p_value"] < 1e-6
    r = drift.check(long)
    assert r.first()["drift_detected"] and drift.decision(r, ["x"]).first()["should_retrain"] is False


def test_no_drift_on_same_distribution(spark):
    rng = np.random.default_rng(5)
    rows = [("x", float(v), i >= 300) for i, v in enumerate(rng.normal(60, 15, 400))]
    long = spark.createDataFrame(rows, "feature string, v double, is_current boolean")
    assert not drift.check(long).first()["drift_detected"]


def test_curve_areas_with_ties(spark):
    d = spark.createDataFrame([(0.9, True), (0.8, True), (0.8, False), (0.3, True), (0.1, False)], "s double, y boolean")
    r = curves.curve_areas(d, F.col("s"), F.col("y")).first()
    assert r["auc"] == pytest.approx((2 + 1.5 + 1) / 6)
    assert r["average_precision"] == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)
