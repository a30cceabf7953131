"""Audit-log and feedback queries over logs with JSON details."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyfold.functions.numeric import count_where, ratio

DETAILS = "risk_pct INT, risk_level STRING, mrr_at_risk_cents BIGINT, actions STRING, channels STRING, ok STRING"


def parsed(log: DataFrame) -> DataFrame:
    """The log with its details decoded once, columns pruned to what the schema names."""
    return log.withColumn("d", F.from_json("details", DETAILS))


def predictions(log: DataFrame) -> DataFrame:
    return parsed(log.where("event_type = 'prediction'"))


def summary(log: DataFrame) -> DataFrame:
    is_pred = F.col("event_type") == "prediction"
    return parsed(log).agg(
        F.count("*").alias("total_entries"),
        count_where(is_pred).alias("predictions"),
        F.round(F.avg(F.when(is_pred, F.col("d.risk_pct"))) / 100, 4).alias("avg_churn_risk"),
        count_where(is_pred & (F.col("d.risk_level") == "HIGH")).alias("high_risk_count"),
        F.sum(F.when(is_pred, F.col("d.mrr_at_risk_cents"))).alias("total_mrr_at_risk_cents"),
    )


def riskiest_accounts(log: DataFrame, k: int = 10) -> DataFrame:
    return (
        predictions(log).where("d.risk_level = 'HIGH'").groupBy("account_id").agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "account_id").limit(k)
    )


def mrr_at_risk_by_day(log: DataFrame) -> DataFrame:
    return predictions(log).groupBy(F.to_date("logged_at").alias("date")).agg(F.sum("d.mrr_at_risk_cents").alias("mrr_at_risk_cents"))


def risk_shares(log: DataFrame) -> DataFrame:
    """Share of predictions per level: counts first, then a scalar total."""
    c = predictions(log).groupBy(F.col("d.risk_level").alias("risk_level")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    return c.withColumn("_t", total.scalar()).select("risk_level", "n", (F.col("n") / F.col("_t")).alias("share"))


def interventions(log: DataFrame) -> DataFrame:
    d = parsed(log.where("event_type = 'intervention'"))
    return d.select(
        "entry_id", "logged_at", "account_id", F.col("d.risk_level").alias("risk_level"), F.col("d.risk_pct").alias("risk_pct"),
        F.col("d.mrr_at_risk_cents").alias("mrr_at_risk_cents"),
        F.split("d.actions", r"\|").alias("actions_taken"), F.split("d.channels", r"\|").alias("channels_used"),
        F.transform(F.split("d.ok", r"\|"), lambda x: x.cast("int")).alias("ok"),
    )


def dispatch_success(log: DataFrame) -> DataFrame:
    """Mean per-record success rate and the success share of each channel position."""
    i = interventions(log)
    rate = F.aggregate("ok", F.lit(0), lambda a, x: a + x) / F.size("ok")
    overall = i.agg(F.avg(rate).alias("v")).select(F.lit("overall").alias("channel"), F.col("v").alias("success_rate"))
    sent = i.select(F.explode(F.arrays_zip("channels_used", "ok")).alias("z")).where("z.ok IS NOT NULL AND z.channels_used IS NOT NULL")
    per = sent.groupBy(F.col("z.channels_used").alias("channel")).agg(F.avg("z.ok").alias("success_rate"))
    return overall.unionByName(per)


def last_entries(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.col("logged_at").desc(), F.col("entry_id").desc()).limit(n)


def alert_history(log: DataFrame, n: int = 20) -> DataFrame:
    i = interventions(log).orderBy(F.col("logged_at").desc(), F.col("entry_id").desc()).limit(n)
    return i.select("entry_id", "account_id", F.array_join("actions_taken", "|").alias("actions"), F.array_join("channels_used", "|").alias("channels"), "risk_pct", "risk_level", "mrr_at_risk_cents")


def entries_of(log: DataFrame, account_id: int) -> DataFrame:
    return log.where(F.col("account_id") == account_id).orderBy("logged_at", "entry_id")


def outcome_counts(feedback: DataFrame, as_of, since_days: int = 30) -> DataFrame:
    start = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {since_days} DAYS")
    return feedback.where(F.col("recorded_at") >= start).groupBy("outcome").agg(F.count("*").alias("n"))


def feedback_for(feedback: DataFrame, **key) -> DataFrame:
    (name, value), = key.items()
    return feedback.where(F.col(name) == value).orderBy(F.col("recorded_at").desc(), "feedback_id")


def retention(log: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Entries still inside the retention window."""
    return log.where(F.col("logged_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def session_counters(scored: DataFrame) -> DataFrame:
    """Requests, mean latency and decision colours per session."""
    col = F.col("color_code")
    return scored.groupBy("session_id").agg(
        F.count("*").alias("requests"), ratio(F.sum("latency_us"), F.count("*")).alias("avg_latency_us"),
        count_where(col == "GREEN_INTENSE").alias("green"), count_where(col == "RED_FOLD").alias("red"),
        count_where(~col.isin("GREEN_INTENSE", "RED_FOLD")).alias("yellow"),
    )


def rows_since(rows: DataFrame, column: str, ts: str) -> DataFrame:
    return rows.where(F.col(column) > F.lit(ts).cast("timestamp_ntz")).agg(F.count("*").alias("n"))


def retrain_due(rows: DataFrame, column: str, last_trained: str | None, now: str, min_seconds: int = 300, min_rows: int = 5) -> DataFrame:
    """Due when enough time has passed and enough rows arrived; never without a previous training."""
    last, at = F.lit(last_trained).cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz")
    n = rows.agg(count_where(F.coalesce(F.col(column) > last, F.lit(False))).alias("new_rows"))
    secs = F.unix_timestamp(at.cast("timestamp")) - F.unix_timestamp(last.cast("timestamp"))
    return n.select("new_rows", secs.alias("elapsed_s"), F.coalesce((secs >= min_seconds) & (F.col("new_rows") >= min_rows), F.lit(False)).alias("due"))
