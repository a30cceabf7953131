"""Churn, expansion, policy and value models on pyspark.ml pipelines."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from tallyfold.functions import fixed_values as fv
from tallyfold.plans import accounts as ac
from tallyfold.session import written


def draw(key: Column, seed: int) -> Column:
    """A repeatable uniform draw per key, independent of row order and partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0


def labelled_accounts(features: DataFrame, profile: Column) -> DataFrame:
    """Training rows: the model features with renewal and upsell labels drawn from their probabilities."""
    renew, up = ac.label_probability(profile, F.col("engajamento_pct"), F.col("nps_score"))
    return features.select(
        "account_id", "segment", *[c for c in fv.CHURN_FEATURES if c not in ("mrr", "segment_encoded")],
        (F.col("mrr_cents") / 100.0).alias("mrr"), ac.segment_code(F.col("segment")).alias("segment_encoded"),
        (draw(F.col("account_id"), 1) < renew).cast("int").alias("renovado"), (draw(F.col("account_id"), 2) < up).cast("int").alias("fez_upsell"),
    )


def holdout(df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Stratified split by a hash of the key: the same rows land on the same side every run."""
    test = draw(F.concat_ws(":", F.col(key), F.col(label)), seed) < share
    return df.where(~test), df.where(test)


def aligned(df: DataFrame, names: list[str]) -> DataFrame:
    """Fill missing model columns with zero and nulls with zero."""
    have = set(df.columns)
    return df.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in have else F.lit(0.0) for n in names})


def _scaled(names: list[str]) -> list:
    return [VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(withMean=True, inputCol="raw", outputCol="features")]


def churn_pipeline(names=fv.CHURN_FEATURES, trees: int = 100, depth: int = 5, rate: float = 0.1) -> Pipeline:
    return Pipeline(stages=[*_scaled(list(names)), GBTClassifier(labelCol="renovado", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.85, seed=42)])


def expansion_pipeline(names=fv.EXPANSION_FEATURES, trees: int = 200, depth: int = 6) -> Pipeline:
    return Pipeline(stages=[*_scaled(list(names)), RandomForestClassifier(labelCol="fez_upsell", numTrees=trees, maxDepth=depth, weightCol="w", seed=42)])


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Class weights n / (classes * class size) in column w; the class table has a row for each class."""
    c = df.groupBy(label).agg(F.count("*").alias("_c"))
    t = c.agg(F.sum("_c").alias("n"), F.count("*").alias("k")).select((F.col("n") / F.col("k")).alias("s"))
    return df.join(F.broadcast(c), label).withColumn("w", t.scalar() / F.col("_c")).drop("_c")


def fit(df: DataFrame, pipeline: Pipeline, names: list[str], label: str, key: str = "account_id", weighted: bool = False) -> tuple[PipelineModel, dict]:
    """Fit on the training side, measured on the rest; the features are written once for the fit and all measures.

    With ``weighted`` classes are balanced by weights of the training side alone.
    """
    train, test = holdout(written(aligned(df, list(names)), "features"), label, key)
    if weighted:
        train = balanced(train, label)
    model = pipeline.fit(train)
    scored = model.transform(test)
    ev = BinaryClassificationEvaluator(labelCol=label)
    return model, {
        "auc": ev.evaluate(scored, {ev.metricName: "areaUnderROC"}), "avg_precision": ev.evaluate(scored, {ev.metricName: "areaUnderPR"}),
        "train_rows": train.count(), "test_rows": test.count(),
    }


def score_accounts(model: PipelineModel, df: DataFrame, names=fv.CHURN_FEATURES) -> DataFrame:
    """Churn risk (probability of not renewing), level and money at risk per account."""
    p = vector_to_array("probability")
    d = model.transform(aligned(df, list(names))).withColumns({"churn_risk": F.round(p[0], 4), "retention_prob": F.round(p[1], 4)})
    return d.withColumns({"risk_level": ac.risk_level(F.col("churn_risk")), "mrr_at_risk": F.round(F.col("mrr") * F.col("churn_risk"), 2)})


def importances(model: PipelineModel, names: list[str], k: int = 8) -> list[tuple[str, float]]:
    v = model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, map(float, v)), key=lambda t: -t[1])[:k]


def importance_rows(df: DataFrame, model: PipelineModel, names: list[str], k: int = 8) -> DataFrame:
    return df.sparkSession.createDataFrame(importances(model, list(names), k), "feature string, importance double")


# ---- ex-ante policy ----

POLICY_NUMERIC = ["stack_bb", "pot_bb_before", "num_players", "limpers", "open_size_bb", "ante_bb", "bb_chips", "effective_stack_bb", "spr", "open_to_stack_ratio", "board_cards_count", "is_3bet_spot"]
POLICY_TEXT = ["hand", "position", "street", "board_texture"]


def policy_rows(hands: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Ex-ante rows: only what is known before acting, labelled by the action taken.

    ``seen`` has id, limpers, open_size_bb and is_3bet_spot, as ``decisions.before_acting`` folds them from action rows.
    """
    from tallyfold.functions import cards, play

    if seen is not None:
        hands = hands.drop("limpers", "open_size_bb", "is_3bet_spot").join(seen.select("id", "limpers", "open_size_bb", "is_3bet_spot"), "id", "left")
    f = F.col
    bb = f("big_blind").cast("double")
    given = lambda name: F.coalesce(f(name).cast("double"), F.lit(0.0)) if name in hands.columns else F.lit(0.0)
    stack = F.when(bb > 0, f("hero_stack_start") / bb).otherwise(0.0)
    d = hands.select(
        "id", "session_id", "date_utc", play.training_action("hero_action_preflop").alias("label_action"),
        cards.label_from_pair("hero_cards").alias("hand"), play.seat("hero_position").alias("position"), F.lit("PREFLOP").alias("street"), F.lit("NO_BOARD").alias("board_texture"),
        stack.alias("stack_bb"), F.lit(0.0).alias("pot_bb_before"), f("num_players").cast("double").alias("num_players"), given("limpers").alias("limpers"), given("open_size_bb").alias("open_size_bb"),
        F.when(bb > 0, f("ante") / bb).otherwise(0.0).alias("ante_bb"), F.when(bb > 0, bb).otherwise(100.0).alias("bb_chips"), stack.alias("effective_stack_bb"),
        F.lit(0.0).alias("spr"), F.coalesce(F.try_divide(given("open_size_bb"), stack), F.lit(0.0)).alias("open_to_stack_ratio"), F.lit(0.0).alias("board_cards_count"), given("is_3bet_spot").alias("is_3bet_spot"),
    )
    return d.where("label_action IS NOT NULL")


def policy_pipeline(most_frequent: dict[str, str]) -> Pipeline:
    """Medians for missing numbers, the training rows' most frequent value for missing text."""
    cats = [f"{c}_i" for c in POLICY_TEXT]
    quoted = {c: v.replace("'", "''") for c, v in most_frequent.items()}
    filled = ", ".join(f"coalesce({c}, '{quoted[c]}') AS {c}_f" for c in POLICY_TEXT)
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        StringIndexer(inputCol="label_action", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"),
        Imputer(strategy="median", inputCols=POLICY_NUMERIC, outputCols=[f"{c}_n" for c in POLICY_NUMERIC]),
        VectorAssembler(inputCols=[f"{c}_n" for c in POLICY_NUMERIC], outputCol="nums"),
        StandardScaler(withMean=True, inputCol="nums", outputCol="nums_s"),
        StringIndexer(inputCols=[f"{c}_f" for c in POLICY_TEXT], outputCols=cats, handleInvalid="keep"),
        OneHotEncoder(inputCols=cats, outputCols=[f"{c}_h" for c in POLICY_TEXT], handleInvalid="keep"),
        VectorAssembler(inputCols=["nums_s", *[f"{c}_h" for c in POLICY_TEXT]], outputCol="features"),
        LogisticRegression(maxIter=100, family="multinomial", weightCol="w"),
    ])


def train_policy(hands: DataFrame) -> tuple[PipelineModel, dict]:
    """Walk-forward training: fit on the oldest sessions, measure on the newest."""
    from tallyfold.operators.splits import walk_forward

    rows = written(walk_forward(policy_rows(hands)), "policy")
    train, test = balanced(rows.where("split = 'train'"), "label_action"), rows.where("split = 'test'")
    modes = train.agg(*[F.coalesce(F.mode(c), F.lit("")).alias(c) for c in POLICY_TEXT]).first().asDict()
    model = policy_pipeline(modes).fit(train)
    scored = model.transform(test)
    ev = MulticlassClassificationEvaluator()
    n = rows.count()
    return model, {
        "accuracy": ev.evaluate(scored, {ev.metricName: "accuracy"}), "f1": ev.evaluate(scored, {ev.metricName: "f1"}), "log_loss": ev.evaluate(scored, {ev.metricName: "logLoss"}),
        "rows": n, "confidence": "high" if n >= 2000 else "medium" if n >= 500 else "low",
    }


def policy_decisions(model: PipelineModel, rows: DataFrame, floor: float = 0.55) -> DataFrame:
    """Most likely action per row; below the floor the row abstains."""
    names = model.stages[1].labels
    p = vector_to_array("probability")
    top = F.array_max(F.array(*[F.struct(p[i].alias("p"), F.lit(n).alias("k")) for i, n in enumerate(names)]))
    d = model.transform(rows.withColumn("w", F.lit(1.0))).withColumn("_t", top)
    return d.select("id", F.when(F.col("_t.p") < floor, "WARNING").otherwise(F.col("_t.k")).alias("action"), F.round("_t.p", 3).alias("confidence"), (F.col("_t.p") < floor).alias("abstained"))


# ---- value models, clustering, registry ----

VALUE_FEATURES = ["position_ord", "stack_zone", "m_zone", "m_ratio", "vpip", "pfr", "aggressor", "went_allin", "board_texture", "num_players", "hand_tier", "level", "wtsd"]


def value_models(features: DataFrame, trees: int = 20, depth: int = 4, min_rows: int = 120) -> list[dict]:
    """A value regressor and a win classifier over everything and per stack zone with enough rows.

    The classifier is fitted on three quarters of the training rows; a sigmoid fitted on the rest calibrates its probability.
    """
    rows = written(aligned(features.withColumn("target_amount", F.col("target_amount").cast("double")), VALUE_FEATURES), "values")
    sizes = {r["stack_zone"]: r["count"] for r in rows.groupBy("stack_zone").count().collect()}  # at most three rows
    out = []
    for name, part in [("all", rows), *[(f"zone{int(z)}", rows.where(F.col("stack_zone") == z)) for z, n in sorted(sizes.items()) if n >= min_rows]]:
        train, test = holdout(part, "target_win", "id")
        vec = VectorAssembler(inputCols=VALUE_FEATURES, outputCol="features")
        reg = Pipeline(stages=[vec, GBTRegressor(labelCol="target_amount", maxIter=trees, maxDepth=depth, seed=42)]).fit(train)
        grow, held = holdout(train, "target_win", "id", 0.25, 7)
        win = Pipeline(stages=[vec, RandomForestClassifier(labelCol="target_win", numTrees=trees, maxDepth=depth, seed=42)]).fit(grow)
        raw = vector_to_array("probability")[1]
        own = lambda d: win.transform(d).withColumn("raw_win", raw).select("target_win", "rawPrediction", "raw_win")
        sigmoid = Pipeline(stages=[
            VectorAssembler(inputCols=["raw_win"], outputCol="score"), LogisticRegression(featuresCol="score", labelCol="target_win", rawPredictionCol="sigmoid_raw", probabilityCol="sigmoid", predictionCol="sigmoid_class"),
        ])
        scored = sigmoid.fit(own(held)).transform(own(test)).withColumn("win_probability", vector_to_array("sigmoid")[1])
        off = lambda p: F.avg((F.col(p) - F.col("target_win")) ** 2)
        brier = scored.agg(off("raw_win").alias("raw"), off("win_probability").alias("calibrated")).first()
        mae = RegressionEvaluator(labelCol="target_amount", metricName="mae").evaluate(reg.transform(test))
        auc = BinaryClassificationEvaluator(labelCol="target_win").evaluate(scored)
        out.append({"scope": name, "mae": float(mae), "win_auc": float(auc), "raw_brier": float(brier["raw"]), "brier": float(brier["calibrated"])})
    return out


def cross_validated(df: DataFrame, names: list[str], label: str, folds: int = 3) -> list[float]:
    """Mean AUC of each setting. The rows are written once: every fold and fit reads them, and none repeats the joins behind them and their broadcasts."""
    rows = written(aligned(df, list(names)).select(label, *names), "folds")
    vec = VectorAssembler(inputCols=list(names), outputCol="features")
    lr = LogisticRegression(labelCol=label)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1]).build()
    cv = CrossValidator(estimator=Pipeline(stages=[vec, lr]), estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, seed=42)
    return [float(x) for x in cv.fit(rows).avgMetrics]


def cross_validated_values(features: DataFrame, key: str, folds: int = 5, trees: int = 10, depth: int = 3) -> list[dict]:
    """MAE of the value regressor and F1 of the win classifier over folds by ``key``, beside those of the best constant answer.

    Rows of one key (a session) stay in one fold, so play of a session never predicts itself.
    """
    rows = features.withColumn("target_amount", F.col("target_amount").cast("double")).withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(folds)).cast("int"))
    rows = written(aligned(rows, VALUE_FEATURES).select("fold", "target_amount", "target_win", *VALUE_FEATURES), "folds")
    vec = VectorAssembler(inputCols=VALUE_FEATURES, outputCol="features")
    wins = MulticlassClassificationEvaluator(labelCol="target_win", metricName="fMeasureByLabel", metricLabel=1.0)
    jobs = [
        ("mae", GBTRegressor(labelCol="target_amount", maxIter=trees, maxDepth=depth, seed=42), RegressionEvaluator(labelCol="target_amount", metricName="mae")),
        ("f1", RandomForestClassifier(labelCol="target_win", numTrees=trees, maxDepth=depth, seed=42), wins),
    ]
    middle = rows.agg(F.percentile_approx("target_amount", 0.5).alias("m"))
    constant = rows.agg(F.avg(F.abs(F.col("target_amount") - middle.scalar())).alias("mae"), F.avg("target_win").alias("share")).first()
    floors = {"mae": float(constant["mae"]), "f1": float(2 * constant["share"] / (1 + constant["share"]))}  # F1 of always answering win
    out = []
    for name, model, evaluator in jobs:
        cv = CrossValidator(estimator=Pipeline(stages=[vec, model]), estimatorParamMaps=[{}], evaluator=evaluator, numFolds=folds, foldCol="fold").fit(rows)
        out.append({"metric": name, "mean": float(cv.avgMetrics[0]), "std": float(cv.stdMetrics[0]), "constant": floors[name], "folds": folds})
    return out


RATES = ["aggression_rate", "call_rate", "fold_rate", "cbet_rate"]


def cluster_opponents(rates: DataFrame, k: int = 3) -> DataFrame:
    """K-means styles named by the centre's dominant rate; too few opponents fall back to the rule."""
    from tallyfold.plans.leaks import cluster_by_rule

    if len(rates.take(max(3, k))) < max(3, k):
        return cluster_by_rule(rates).withColumn("opponent_cluster_id", F.lit(0))
    vec = VectorAssembler(inputCols=RATES, outputCol="v")
    model = KMeans(k=k, seed=42, featuresCol="v", predictionCol="opponent_cluster_id").fit(vec.transform(rates))
    names = []
    for a, c, f, _ in model.clusterCenters():
        names.append("Aggro" if a >= max(c, f) else "Station" if c >= max(a, f) else "Passive")
    pick = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("opponent_cluster_id") + 1)
    return model.transform(vec.transform(rates)).withColumn("opponent_cluster", pick).drop("v")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free dataset fingerprint: the count, the exact sum and the XOR of row hashes.

    The sum tells repeated rows apart, which cancel out in the XOR; columns are hashed with their names and nulls as such, so neither
    can take another's place.
    """
    cells = [F.concat_ws("=", F.lit(c), F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("null"))) for c in sorted(df.columns)]
    h = F.xxhash64(*cells)
    total = df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
    text = F.concat_ws(":", F.col("rows").cast("string"), F.coalesce(F.col("s").cast("string"), F.lit("")), F.coalesce(F.col("x").cast("string"), F.lit("")))
    return total.select("rows", F.substring(F.sha2(text, 256), 1, 12).alias("dataset_version"))


def register(model: PipelineModel, df: DataFrame, name: str, metrics: dict, base: str) -> str:
    """Save the model and its manifest row below the registry folder."""
    version = fingerprint(df).first()["dataset_version"]
    path = f"{base}/{name}-{version}"
    model.write().overwrite().save(f"{path}/model")
    spark = df.sparkSession
    body = json.dumps({"model_name": name, "model_version": f"{name}-{version}", "metrics": metrics, "features": df.columns})
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return path


def retrain_on_drift(baseline: DataFrame, recent: DataFrame, columns: list[str], critical: list[str], base: str, pipeline: Pipeline | None = None) -> DataFrame:
    """Check drift; if enough critical features moved, train on both sets and register the model."""
    from tallyfold.operators import drift

    both = baseline.withColumn("_cur", F.lit(False)).unionByName(recent.withColumn("_cur", F.lit(True)), allowMissingColumns=True)
    d = drift.decision(drift.check(drift.long_form(both, columns, F.col("_cur"))), critical).first()
    row = (bool(d["should_retrain"]), d["critical_features"], None, None)
    if d["should_retrain"]:
        rows = both.drop("_cur")
        model, m = fit(rows, pipeline or churn_pipeline(), fv.CHURN_FEATURES, "renovado")
        row = (True, d["critical_features"], float(m["auc"]), register(model, rows, "churn", m, base))
    return baseline.sparkSession.createDataFrame([row], "should_retrain boolean, critical_features string, auc double, path string")
