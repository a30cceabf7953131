"""The leak chain on repeated hands and several sizing columns; what a player had seen before acting."""

import re

import pytest
from pyspark.sql import functions as F

from tallyfold.plans import decisions as dc, leaks as lk

from test_play import SPOT


def test_repeated_hands_change_nothing(spark):
    one = spark.range(40).selectExpr(*SPOT, "CONCAT('H', id) AS hand_id", "'acr' AS site_name")
    older = one.withColumns({"date_utc": F.expr("date_utc - INTERVAL 1 DAY"), "hero_vpip": F.lit(0), "hero_action_preflop": F.lit("folds"), "site_name": F.lit("ACR"), "id": F.col("id") + 1000})
    key = lambda d: sorted((r["leak_code"], r["sample_size"], round(r["metric"], 9)) for r in lk.detect(d, tilt=False).collect())
    assert key(lk.prepare_once(one.unionByName(older))) == key(lk.prepare_once(one)) and key(lk.prepare_once(one))


def test_validation_stands_beside_the_detections(spark):
    d = spark.range(40).selectExpr(*SPOT, "CONCAT('H', id) AS hand_id", "'win' AS hero_result")
    det, issues = lk.validated(d)
    assert {(r["validation_ok"], r["validation_issues"]) for r in det.collect()} == {(True, 0)} and issues.count() == 0
    det, issues = lk.validated(d.withColumn("hero_stack_start", F.when(F.col("id") == 3, 0).otherwise(F.col("hero_stack_start"))))
    assert {(r["validation_ok"], r["validation_issues"]) for r in det.collect()} == {(False, 1)} and issues.first()["code"] == "invalid_stack_bb"


def test_every_sizing_column_counts(spark):
    d = spark.range(15).selectExpr(*SPOT, "CAST(id AS DOUBLE) AS bet_size", "CAST(id AS STRING) AS Raise_Size_bb", "CAST(NULL AS INT) AS flop_sizing", "IF(id < 14, id, NULL) AS amount_bet")
    found = lk.sizing_detection(lk.prepare(d)).collect()
    assert sorted(r["evidence"][0] for r in found) == ["Raise_Size_bb high frequency=0.13", "bet_size high frequency=0.13"]  # fourteen sizes are too few
    assert [r["sample_size"] for r in found] == [15, 15]
    assert lk.sizing_detection(lk.prepare(spark.range(15).selectExpr(*SPOT))).count() == 0


@pytest.mark.parametrize("acts,want", [
    ([("A", "CALL", 100), ("B", "CALL", 100), ("H", "CHECK", 0)], (2, 0.0, False)),
    ([("A", "CALL", 100), ("B", "RAISE", 350), ("C", "CALL", 350), ("H", "FOLD", 0), ("A", "RAISE", 900)], (1, 3.5, True)),
    ([("H", "RAISE", 250), ("A", "CALL", 250), ("H", "CALL", 0)], (0, 0.0, False)),
    ([("A", "RAISE", 200)], None),
])
def test_seen_before_acting(spark, acts, want):
    rows = [("r", i + 1, "PREFLOP", a, k, float(x)) for i, (a, k, x) in enumerate(acts)] + [("r", 90, "FLOP", "A", "CALL", 1.0), ("q", 1, "FLOP", "H", "CALL", 1.0)]
    d = spark.createDataFrame(rows, "record string, action_order int, street string, actor_id string, action_type string, amount double")
    got = dc.before_acting(d, "H", spark.createDataFrame([("r", 100)], "record string, big_blind int")).collect()
    assert [tuple(r)[1:] for r in got] == ([want] if want else [])


def test_play_of_one_sizing_column_is_not_one_task(spark):
    """The percentile of a column is joined by broadcast: a shuffle by the column's name would send all of its play to one task."""
    d = spark.range(40).selectExpr(*SPOT, "CAST(id AS DOUBLE) AS bet_size")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        shares = lk.sizing_shares(lk.prepare(d))
        plan = shares._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"SortMergeJoin \[size_name#\d+\]", plan) and re.search(r"BroadcastHashJoin \[size_name#\d+\]", plan)
        assert [(r["size_name"], r["n"], r["ratio"]) for r in shares.collect()] == [("bet_size", 40, 0.1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_play_is_not_dealt_by_opponent(spark):
    """Clusters of few opponents are known to be small before the join, and what needs no cluster does not join them."""
    d = spark.range(4000).selectExpr(*SPOT, "CAST(id AS DOUBLE) AS bet_size", "CONCAT('V', id % 3) AS villain_id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        prep = lk.prepare_once(d)
        groups = lk.base_groups(prep)
        plan = groups._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and re.search(r"BroadcastHashJoin \[opponent_key#\d+\]", plan)
        assert not re.search(r"Join \[opponent_key#\d+\]", lk.sizing_shares(prep)._jdf.queryExecution().executedPlan().toString())
        assert groups.agg(F.sum("s_n")).first()[0] == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
