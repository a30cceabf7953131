"""Account features, scores, recommendations, interventions and portfolio reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tallyfold.functions import fixed_values as fv
from tallyfold.functions.numeric import count_where, fixed, money, percent, ratio, signed
from tallyfold.functions.play import lookup
from tallyfold.operators import policy
from tallyfold.operators.dedupe import top_per_key


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def period_features(interactions: DataFrame, accounts: DataFrame, as_of: dt.date, days: int = 15) -> DataFrame:
    """Recent-window features beside the window before it, one aggregation over both.

    Accounts without interactions keep a row with the documented defaults.
    """
    day = F.col("event_date")
    start = F.date_sub(F.lit(as_of), days)
    before = F.date_sub(F.lit(as_of), 2 * days + 1)
    recent, prior = day > start, (day > before) & (day <= start)
    aggs = []
    for tag, inside in (("r", recent), ("p", prior)):
        aggs += [
            count_where(inside & (F.col("logins_count") > 0)).alias(f"login_days_{tag}"),
            F.coalesce(F.sum(F.when(inside, F.col("logins_count"))), F.lit(0)).alias(f"total_logins_{tag}"),
            F.coalesce(F.avg(F.when(inside, F.col("active_users"))), F.lit(0.0)).alias(f"avg_users_{tag}"),
            F.coalesce(F.sum(F.when(inside, F.col("tickets_open"))), F.lit(0)).alias(f"tickets_{tag}"),
            F.avg(F.when(inside, F.col("nps_score"))).alias(f"nps_{tag}"),
        ]
    g = interactions.groupBy("account_id").agg(*aggs, F.max(F.when(recent, day)).alias("last_login"))
    j = accounts.join(g, "account_id", "left")
    zero = {f"{c}_{t}": 0 for c in ("login_days", "total_logins", "avg_users", "tickets") for t in ("r", "p")}
    j = j.fillna({**zero, "nps_r": 5.0, "nps_p": 5.0})
    eps = 1e-6

    def trend(c: str) -> Column:
        return F.round(_clip((F.col(f"{c}_r") - F.col(f"{c}_p")) / (F.col(f"{c}_p") + eps), -2, 2), 3)

    return j.select(
        "*",
        F.round(F.col("login_days_r") / float(days) * 100, 1).alias("engajamento_pct"),
        F.round("nps_r", 1).alias("nps_score"),
        F.col("tickets_r").cast("int").alias("tickets_abertos"),
        trend("login_days").alias("engagement_trend"),
        trend("tickets").alias("tickets_trend"),
        F.round(F.col("nps_r") - F.col("nps_p"), 3).alias("nps_trend"),
        F.coalesce(F.date_diff(F.lit(as_of), F.col("last_login")), F.lit(days)).alias("dias_sem_interacao"),
    ).drop("last_login")


def segment_code(segment: Column) -> Column:
    return lookup(segment, fv.SEGMENT_CODE, 1)


def segment_code_alphabetical(segment: Column, known: list[str]) -> Column:
    """Code by alphabetical position among known labels; unseen labels get 0."""
    return F.greatest(F.array_position(F.array(*[F.lit(x) for x in sorted(known)]), segment) - 1, F.lit(0)).cast("int")


def label_probability(profile: Column, engagement: Column, nps: Column) -> tuple[Column, Column]:
    """Renewal and upsell probabilities from the account profile with clipped bonuses."""
    renew = lookup(profile, fv.RENEWAL_BY_PROFILE, 0.5) + _clip((engagement - 50) / 100, -0.20, 0.20) + _clip((nps - 5) / 20, -0.15, 0.15)
    return _clip(renew, 0.02, 0.98), lookup(profile, fv.UPSELL_BY_PROFILE, 0.05)


def label_probability_from_features(df: DataFrame) -> DataFrame:
    """The same without profiles; ticket load is scaled by the largest load seen."""
    top = df.agg((F.max("tickets_abertos") + 1).cast("double").alias("m"))
    base = _clip(
        0.10 * (F.col("engajamento_pct") / 100) + 0.10 * (F.col("nps_score") / 10) - 0.05 * (F.col("tickets_abertos") / F.col("_m"))
        + 0.10 * _clip(F.col("engagement_trend"), -1, 1) + 0.10 * _clip(F.col("nps_trend"), -2, 2) / 2,
        0.05, 0.95,
    )
    out = df.withColumn("_m", top.scalar()).withColumn("_b", base).withColumn("upsell_p", _clip(F.col("_b") * 0.3, 0.01, 0.40))
    bonus = _clip((F.col("engajamento_pct") - 50) / 100, -0.20, 0.20) + _clip((F.col("nps_score") - 5) / 20, -0.15, 0.15)
    return out.withColumn("renewal_p", _clip(F.col("_b") + bonus, 0.02, 0.98)).drop("_m", "_b")


def risk_level(risk: Column) -> Column:
    return F.when(risk > fv.RISK_HIGH, "HIGH").when(risk > fv.RISK_MEDIUM, "MEDIUM").otherwise("LOW")


def upsell_signal(p: Column) -> Column:
    return F.when(p > fv.UPSELL_AT, "HIGH").otherwise("LOW")


def recommended_actions(risk: Column, upsell: Column, cap: int = 5) -> Column:
    """Ordered action codes by risk band, upsell first where it applies, stable by priority."""

    def arr(codes: list[str]) -> Column:
        return F.array(*[F.struct(F.lit(fv.ACTION_PRIORITY[x]).alias("priority"), F.lit(i).alias("pos"), F.lit(x).alias("code")) for i, x in enumerate(codes)])

    band = (
        F.when(risk > fv.RISK_HIGH, arr(fv.ACTIONS_HIGH))
        .when(risk > fv.RISK_MEDIUM, arr(fv.ACTIONS_MEDIUM))
        .when(upsell > fv.UPSELL_AT, arr(fv.ACTIONS_UPSELL + fv.ACTIONS_LOW))
        .otherwise(arr(fv.ACTIONS_LOW))
    )
    return F.slice(F.transform(F.array_sort(band), lambda a: a["code"]), 1, cap)


def health_score(engagement: Column, nps: Column, tickets: Column, ticket_limit: float, retention: Column, expansion: Column, multiplier: Column) -> Column:
    parts = 0.35 * engagement + 0.25 * nps + 0.20 * (1 - tickets / ticket_limit) + 0.15 * retention + 0.05 * expansion
    return parts * multiplier


def accounts_by_risk(pred: DataFrame, level: str | None = None, segment: str | None = None, limit: int = 50) -> DataFrame:
    out = pred
    if level:
        out = out.where(F.col("risk_level") == level.upper())
    if segment:
        out = out.where(F.col("segment") == segment.upper())
    return out.orderBy(F.col("risk_pct").desc(), "account_id").limit(limit)


def risk_summary(pred: DataFrame) -> DataFrame:
    lv = F.col("risk_level")
    return pred.agg(
        F.count("*").alias("total"),
        count_where(lv == "HIGH").alias("high_risk"), count_where(lv == "MEDIUM").alias("medium_risk"), count_where(lv == "LOW").alias("low_risk"),
        F.round(F.avg("risk_pct") / 100, 4).alias("avg_churn_risk"),
        F.sum("mrr_at_risk_pc").alias("mrr_at_risk_pc"),
    )


# ---- interventions ----------------------------------------------------------


def payload_text(code: Column) -> Column:
    """Message payload of an action as text."""
    base = F.concat_ws(
        ";",
        F.concat(F.lit("account="), F.col("account_id").cast("string")), F.concat(F.lit("segment="), F.col("segment")),
        F.concat(F.lit("churn_risk="), percent("churn_risk")), F.concat(F.lit("mrr_at_risk="), money(F.col("mrr_at_risk"))),
        F.concat(F.lit("csm="), F.coalesce(F.nullif(F.col("csm_name"), F.lit("")), F.lit("N/A"))),
    )
    urgent = F.concat_ws(
        ";", base, F.concat(F.lit("urgency="), F.when(F.col("churn_risk") > 0.80, "CRITICAL").otherwise("HIGH")),
        F.concat(F.lit("engajamento="), fixed("engajamento_pct", 1), F.lit("%")), F.concat(F.lit("dias_sem_interacao="), F.col("dias_sem_interacao")),
    )
    upsell = F.concat_ws(";", base, F.concat(F.lit("upsell="), percent("upsell_probability")), F.concat(F.lit("retention="), percent(1 - F.col("churn_risk"))))
    qbr = F.concat_ws(";", base, F.concat(F.lit("dias_no_contrato="), F.col("dias_no_contrato")))
    return F.when(code.isin("ESCALATE_TO_MANAGER", "SEND_SLACK_ALERT"), urgent).when(code == "PROPOSE_UPSELL", upsell).when(code == "TRIGGER_QBR", qbr).otherwise(base)


def interventions(contexts: DataFrame, rules=None) -> DataFrame:
    """Dry-run records: decided actions, channels (console always among them), distinct reasons."""
    d = policy.evaluate(contexts, rules)
    acts = F.col("actions")
    channels = F.flatten(F.transform(acts, lambda a: F.array_union(a["channels"], F.array(F.lit("console")))))
    return d.withColumns({
        "actions_taken": F.transform(acts, lambda a: a["code"]),
        "channels_used": F.array_sort(F.array_distinct(channels)),
        "reasons": F.array_distinct(F.transform(acts, lambda a: a["reason"])),
        "dispatched": F.size(channels),
    })


def outbox(contexts: DataFrame, rules=None) -> DataFrame:
    """One row per action and channel to send, for a sink to deliver."""
    d = policy.evaluate(contexts, rules).withColumn("mrr_at_risk", F.col("mrr_at_risk_pc") / 10000.0)
    a = d.select("*", F.explode("actions").alias("a"))
    return a.select(
        "account_id", F.col("a.code").alias("code"), F.col("a.priority").alias("priority"),
        F.explode(F.array_union("a.channels", F.array(F.lit("console")))).alias("channel"), payload_text(F.col("a.code")).alias("payload"),
    )


def counts_of(records: DataFrame, array_col: str, name: str, k: int | None = None) -> DataFrame:
    """How often each element of an array column occurs, most frequent first."""
    out = records.select(F.explode(array_col).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    out = out.orderBy(F.col("n").desc(), name)
    return out.limit(k) if k else out


def intervention_summary(records: DataFrame) -> DataFrame:
    """Long summary: totals, risk distribution, actions and channels."""
    lv = [("HIGH", "risk"), ("MEDIUM", "risk"), ("LOW", "risk")]
    one = records.agg(F.count("*").alias("total"), *[count_where(F.col("risk_level") == n).alias(n) for n, _ in lv])
    head = one.select(F.explode(F.array(
        F.struct(F.lit("total").alias("section"), F.lit("all").alias("key"), F.col("total").alias("n")),
        *[F.struct(F.lit("risk").alias("section"), F.lit(n).alias("key"), F.col(n).alias("n")) for n, _ in lv],
    )).alias("r")).select("r.*")
    acts = counts_of(records, "actions_taken", "key", 5).select(F.lit("action").alias("section"), "key", "n")
    chans = counts_of(records, "channels_used", "key").select(F.lit("channel").alias("section"), "key", "n")
    return head.unionByName(acts).unionByName(chans)


# ---- portfolio report -------------------------------------------------------


def acted_accounts(records: DataFrame) -> DataFrame:
    """Accounts with a record that did more than monitor; an empty action list counts as acted."""
    return records.where(F.coalesce(F.array_join("actions_taken", ","), F.lit("")) != "MONITOR_ONLY").select("account_id").distinct()


def top_action(records: DataFrame) -> DataFrame:
    """First action of each account's first record that has any."""
    return (
        records.where(F.size("actions_taken") > 0)
        .groupBy("account_id")
        .agg(F.min_by(F.element_at("actions_taken", 1), F.col("record_id")).alias("top_action"))
    )


def portfolio_kpis(pred: DataFrame, records: DataFrame) -> DataFrame:
    p = pred.join(acted_accounts(records).withColumn("acted", F.lit(True)), "account_id", "left")
    lv = F.col("risk_level")
    return p.agg(
        F.count("*").alias("total_accounts"),
        count_where(lv == "HIGH").alias("accounts_at_risk"),
        count_where((lv == "HIGH") & (F.col("mrr_cents") >= fv.CRITICAL_MRR_CENTS)).alias("critical_accounts"),
        count_where(lv == "MEDIUM").alias("recoverable_accounts"),
        count_where(lv == "LOW").alias("safe_accounts"),
        F.sum("mrr_cents").alias("total_mrr_cents"),
        F.sum("mrr_at_risk_pc").alias("mrr_at_risk_pc"),
        F.coalesce(F.sum(F.when(F.col("acted") & lv.isin("HIGH", "MEDIUM"), F.col("mrr_at_risk_pc"))), F.lit(0)).alias("mrr_preserved_pc"),
    )


def segment_breakdown(pred: DataFrame) -> DataFrame:
    return pred.groupBy(F.coalesce(F.nullif(F.col("segment"), F.lit("")), F.lit("UNKNOWN")).alias("segment")).agg(
        F.count("*").alias("total"), count_where(F.col("risk_level") == "HIGH").alias("high_risk"),
        F.sum("mrr_cents").alias("mrr_cents"), F.sum("mrr_at_risk_pc").alias("mrr_at_risk_pc"),
    )


def top_risk_accounts(pred: DataFrame, records: DataFrame, n: int = 10) -> DataFrame:
    """Largest money at risk among HIGH accounts; the cut happens before the action join."""
    top = pred.where("risk_level = 'HIGH'").orderBy(F.col("mrr_at_risk_pc").desc(), "account_id").limit(n)
    j = top.join(top_action(records.join(top.select("account_id"), "account_id", "left_semi")), "account_id", "left")
    return j.select("account_id", "segment", "mrr_cents", "risk_pct", "risk_level", "mrr_at_risk_pc", F.coalesce("top_action", F.lit("MONITOR_ONLY")).alias("top_action"))


def executive_summary(kpis: DataFrame, actions: DataFrame, drift: Column | None = None) -> DataFrame:
    """The report's opening paragraph from the KPI row."""
    f = F.col
    top = actions.orderBy(f("n").desc(), "action").limit(1).select(f("action").alias("_top"))
    k = kpis.withColumn("_top", top.scalar())
    at_risk, total = f("mrr_at_risk_pc") / 10000.0, f("total_mrr_cents") / 100.0
    text = F.concat_ws(
        " ",
        F.concat(F.lit("No período analisado, "), f("total_accounts"), F.lit(" contas foram avaliadas.")),
        F.concat(f("accounts_at_risk"), F.lit(" ("), fixed(ratio(f("accounts_at_risk"), f("total_accounts")) * 100, 1), F.lit("%) estão em risco alto de churn, sendo "),
                 f("critical_accounts"), F.lit(" classificadas como críticas (MRR > R$ 5.000).")),
        F.concat(F.lit("O MRR total em risco é "), money(at_risk), F.lit(" ("), fixed(F.coalesce(F.try_divide(at_risk, total), F.lit(0.0)) * 100, 1), F.lit("% do MRR analisado).")),
        F.when(f("mrr_preserved_pc") > 0, F.concat(F.lit("Intervenções foram disparadas para contas representando "), money(f("mrr_preserved_pc") / 10000.0), F.lit(" em MRR potencialmente preservado."))),
        F.when(f("_top").isNotNull(), F.concat(F.lit("A ação mais frequente foi: "), f("_top"), F.lit("."))),
        F.when(drift if drift is not None else F.lit(False), "ATENCAO: drift estatístico detectado nas features de entrada — retreino do modelo é recomendado."),
    )
    return k.select(text.alias("executive_summary"))


def report_rows(kpis: DataFrame, segments: DataFrame, actions: DataFrame, channels: DataFrame) -> DataFrame:
    """The report as long (section, key, value) rows, ready for a JSON or text sink."""
    names = kpis.columns
    head = kpis.select(F.explode(F.array(*[F.struct(F.lit("overview").alias("section"), F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names])).alias("r")).select("r.*")
    seg = segments.select(F.lit("segment").alias("section"), F.col("segment").alias("key"), F.to_json(F.struct("total", "high_risk", "mrr_cents", "mrr_at_risk_pc")).alias("value"))
    act = actions.select(F.lit("action").alias("section"), F.col("action").alias("key"), F.col("n").cast("string").alias("value"))
    ch = channels.select(F.lit("channel").alias("section"), F.col("channel").alias("key"), F.col("n").cast("string").alias("value"))
    return head.unionByName(seg).unionByName(act).unionByName(ch)


def period_window(as_of: dt.date, period: str) -> tuple[dt.date, dt.date]:
    return as_of - dt.timedelta(days=fv.PERIOD_DAYS.get(period, 7)), as_of


def memory_text(pred: DataFrame) -> DataFrame:
    """The note stored for each scored account."""
    acts = recommended_actions(F.col("risk_pct") / 100.0, F.col("upsell_pct") / 100.0)
    return pred.select("account_id", F.concat(
        F.lit("Conta "), F.col("account_id").cast("string"), F.lit(": churn_risk="), percent(F.col("risk_pct") / 100.0), F.lit(" ["), F.col("risk_level"),
        F.lit("] ações="), F.array_join(acts, ","),
    ).alias("text"))


def trend_label(value: Column, invert: bool = False) -> Column:
    v = -value if invert else value
    pct = F.concat(signed(v * 100, 0), F.lit("%"))
    return F.when(v > 0.10, F.concat(F.lit("↑ subindo ("), pct, F.lit(")"))).when(v < -0.10, F.concat(F.lit("↓ caindo ("), pct, F.lit(")"))).otherwise(F.concat(F.lit("→ estável ("), pct, F.lit(")")))


def batch_metric(pred: DataFrame, truth: Column) -> DataFrame:
    """Batch figures with accuracy, precision, recall and F1 (HIGH or MEDIUM counts as predicted churn)."""
    yes = F.col("risk_level").isin("HIGH", "MEDIUM")
    m = pred.agg(
        F.count("*").alias("account_count"), F.round(F.avg("risk_pct") / 100, 4).alias("avg_churn_risk"),
        *[count_where(F.col("risk_level") == x).alias(f"{x.lower()}_risk_count") for x in ("HIGH", "MEDIUM", "LOW")],
        F.sum("mrr_at_risk_pc").alias("total_mrr_at_risk_pc"),
        count_where(yes & truth).alias("tp"), count_where(yes & ~truth).alias("fp"), count_where(~yes & truth).alias("fn"), count_where(~yes & ~truth).alias("tn"),
    )
    f = F.col
    prec, rec = ratio(f("tp"), f("tp") + f("fp")), ratio(f("tp"), f("tp") + f("fn"))
    return m.select(
        "account_count", "avg_churn_risk", "high_risk_count", "medium_risk_count", "low_risk_count", "total_mrr_at_risk_pc",
        F.round(ratio(f("tp") + f("tn"), f("account_count")), 4).alias("accuracy"), F.round(prec, 4).alias("precision"), F.round(rec, 4).alias("recall"),
        F.round(ratio(2 * f("tp"), 2 * f("tp") + f("fp") + f("fn")), 4).alias("f1"),
    )


def batch_trend(batches: DataFrame, last_n: int = 10) -> DataFrame:
    """Sums, means and ordered series over the newest batches."""
    last = batches.orderBy(F.col("batch_at").desc()).limit(last_n)
    series = F.array_sort(F.collect_list(F.struct("batch_at", "high_risk_count", "mrr_at_risk")))
    return last.agg(
        F.count("*").alias("rodadas"), F.sum("account_count").alias("total_contas"), F.round(F.avg("avg_churn_risk"), 4).alias("avg_churn_risk"),
        F.array_join(F.transform(series, lambda x: x["high_risk_count"].cast("string")), ",").alias("high_risk_trend"),
        F.array_join(F.transform(series, lambda x: x["mrr_at_risk"].cast("string")), ",").alias("mrr_at_risk_trend"),
        F.round(F.avg("precision"), 4).alias("avg_precision"),
    )


def latest_alert(batches: DataFrame, threshold: int) -> DataFrame:
    return batches.agg(F.max_by("mrr_at_risk", "batch_at").alias("latest"), F.max("batch_at").alias("batch_at")).select(
        "batch_at", "latest", (F.coalesce(F.col("latest"), F.lit(0)) >= threshold).alias("alert")
    )


def newest_per_account(rows: DataFrame, key: str, when: str, limit: int) -> DataFrame:
    return top_per_key(rows, [key], [F.col(when).desc()], limit, rank="rank")
