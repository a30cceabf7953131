"""Model queries: rows and metric floors, no SQL twins except the deterministic parts."""

import datetime as dt

from pyspark.sql import functions as F

from tallyfold.catalog import ingest as ci
from tallyfold.catalog.accounts import PROFILE, features
from tallyfold.catalog.registry import query
from tallyfold.functions import fixed_values as fv
from tallyfold.plans import decisions as dc, leaks as lk, models as md
from tallyfold.session import scratch_path
from tallyfold.sources import play_log as pl

AS_OF = dt.date(2024, 1, 31)


def training(t):
    return md.labelled_accounts(features(t), F.expr(PROFILE))


@query("f06_churn_model", "F6 F10 F11 B4 D11 A51")
def _(t):
    d = training(t)
    model, m = md.fit(d, md.churn_pipeline(), fv.CHURN_FEATURES, "renovado")
    return md.score_accounts(model, d).select("account_id", "churn_risk", "retention_prob", "risk_level", "mrr_at_risk", F.lit(float(m["auc"])).alias("auc"))


@query("f07_expansion_model", "F7 F11")
def _(t):
    d = training(t)
    model, m = md.fit(d, md.expansion_pipeline(), fv.EXPANSION_FEATURES, "fez_upsell", weighted=True)
    return md.importance_rows(d, model, fv.EXPANSION_FEATURES).withColumn("auc", F.lit(float(m["auc"])))


@query("f08_policy_model", "F8 F12 D26")
def _(t):
    model, m = md.train_policy(t.spots)
    return md.policy_decisions(model, md.policy_rows(t.spots)).withColumns({"test_accuracy": F.lit(float(m["accuracy"])), "passes": F.lit(m["accuracy"] >= 0.4)})


@query("f09_value_models", "F9")
def _(t):
    rows = md.value_models(dc.model_features(t.spots))
    return t.spark.createDataFrame([(*r.values(), r["win_auc"] >= 0.5 and r["brier"] <= 0.26) for r in rows], "scope string, mae double, win_auc double, raw_brier double, brier double, passes boolean")


@query("f13_cross_validation", "F13")
def _(t):
    auc = md.cross_validated(training(t), fv.CHURN_FEATURES, "renovado")
    return t.spark.createDataFrame([(i, a) for i, a in enumerate(auc)], "setting int, auc double")


@query("f13_cross_validated_values", "F13 F9")
def _(t):
    """Five folds by session: mean absolute error and F1, which must not fall behind a constant answer by more than a tenth."""
    rows = md.cross_validated_values(dc.model_features(t.spots, "session_id"), "session_id")
    ok = {"mae": lambda r: r["mean"] <= 1.1 * r["constant"], "f1": lambda r: r["mean"] >= 0.0}
    return t.spark.createDataFrame([(*r.values(), bool(ok[r["metric"]](r))) for r in rows], "metric string, mean double, std double, constant double, folds int, passes boolean")


@query("f08_seen_before_acting", "F8 P20", uses="", ctes=ci.LINES, sql="""SELECT CAST(event_id AS VARCHAR) AS hand_id, CAST(v='CALL' AS BIGINT) AS limpers, CASE WHEN v='RAISE' THEN ROUND(amt/(100*(1+event_id%4)),6) ELSE 0.0 END AS open_size_bb, v='RAISE' AS is_3bet_spot
 FROM la WHERE actor='Hero' AND street='PREFLOP'""")
def _(t):
    """What the third player of a logged hand had seen: the second one's call or raise."""
    blocks = pl.split_blocks(t.blocks.select(F.col("raw").alias("value"), "file_name")).withColumn("hand_id", F.regexp_extract("raw", r"Game Hand #(\d+)", 1))
    blinds = blocks.select("hand_id", F.regexp_extract("raw", r"\(\d+\.?\d*/(\d+\.?\d*)\)", 1).alias("big_blind"))
    d = dc.before_acting(pl.block_actions(blocks, "hand_id"), "Ann", blinds, "hand_id")
    return d.select("hand_id", "limpers", F.round("open_size_bb", 6).alias("open_size_bb"), "is_3bet_spot")


@query("f05_opponent_clusters", "F5")
def _(t):
    return md.cluster_opponents(lk.opponent_rates(t.spots)).select("opponent_key", "samples", "opponent_cluster_id", "opponent_cluster")


@query("f10_scaled_features", "F10 U4", uses="features", sql="""SELECT account_id, ROUND((mrr_cents-(SELECT AVG(mrr_cents) FROM b_features))/(SELECT stddev_samp(mrr_cents) FROM b_features),6) AS mrr_z, ROUND((max_users-(SELECT AVG(max_users) FROM b_features))/(SELECT stddev_samp(max_users) FROM b_features),6) AS users_z FROM b_features""")
def _(t):
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = VectorAssembler(inputCols=["mrr_cents", "max_users"], outputCol="raw").transform(t.features)
    d = StandardScaler(withMean=True, inputCol="raw", outputCol="z").fit(d).transform(d).withColumn("z", vector_to_array("z"))
    return d.select("account_id", F.round(F.col("z")[0], 6).alias("mrr_z"), F.round(F.col("z")[1], 6).alias("users_z"))


@query("b13_retrain_on_drift", "B13 K10 U7 M31")
def _(t):
    d = training(t)
    recent = d.withColumns({"engajamento_pct": F.col("engajamento_pct") * 0.4 + 50, "nps_score": F.col("nps_score") * 0.5})
    return md.retrain_on_drift(d, recent, ["engajamento_pct", "nps_score", "mrr"], ["engajamento_pct", "nps_score"], scratch_path(t.spark, "registry"), md.churn_pipeline(trees=20))


@query("k10_dataset_fingerprint", "K10", uses="features", sql="SELECT COUNT(*) AS rows, 4 AS versions FROM b_features")
def _(t):
    """The version of a table, of the table with a row repeated twice more, with two rows repeated, and with a null: all differ."""
    d = t.features.select("account_id", "segment", "mrr_cents")
    first = d.where(F.col("account_id") == d.agg(F.min("account_id")).scalar())
    last = d.where(F.col("account_id") == d.agg(F.max("account_id")).scalar())
    changed = d.withColumn("segment", F.when(F.col("account_id") == d.agg(F.min("account_id")).scalar(), None).otherwise(F.col("segment")))
    versions = [md.fingerprint(x).select("dataset_version") for x in (d, d.unionByName(first).unionByName(first), d.unionByName(last).unionByName(last), changed)]
    every = versions[0].unionByName(versions[1]).unionByName(versions[2]).unionByName(versions[3])
    return every.agg(F.count_distinct("dataset_version").cast("int").alias("versions")).select(d.agg(F.count("*")).scalar().alias("rows"), "versions")
