"""Account scoring, policy, intervention, report and audit queries with their SQL twins."""

import datetime as dt

from pyspark.sql import functions as F

from tallyfold.catalog.registry import query
from tallyfold.functions import fixed_values as fv
from tallyfold.operators import policy
from tallyfold.plans import accounts as ac, audit_log as al
from tallyfold.sources.bindings import shares

AS_OF = dt.date(2024, 1, 31)
END = "2024-01-31"
CNT = "COUNT(*) FILTER (WHERE {c})"


def joined(col: str, sep: str = "|"):
    return F.array_join(col, sep).alias(col)


# ---- features ----

PERIOD = """pf AS (SELECT account_id,
 COUNT(*) FILTER (WHERE r AND logins_count>0) AS ldr, COUNT(*) FILTER (WHERE p AND logins_count>0) AS ldp, coalesce(SUM(logins_count) FILTER (WHERE r),0) AS tlr, coalesce(SUM(logins_count) FILTER (WHERE p),0) AS tlp,
 AVG(active_users) FILTER (WHERE r) AS aur, AVG(active_users) FILTER (WHERE p) AS aup, coalesce(SUM(tickets_open) FILTER (WHERE r),0) AS tkr, coalesce(SUM(tickets_open) FILTER (WHERE p),0) AS tkp,
 AVG(nps_score) FILTER (WHERE r) AS npr, AVG(nps_score) FILTER (WHERE p) AS npp, MAX(event_date) FILTER (WHERE r) AS ll
 FROM (SELECT *, event_date>DATE '2024-01-16' AS r, event_date>DATE '2023-12-31' AND event_date<=DATE '2024-01-16' AS p FROM b_interactions) GROUP BY 1),
 feat AS (SELECT a.*, coalesce(ldr,0) AS login_days_r, coalesce(ldp,0) AS login_days_p, CAST(coalesce(tlr,0) AS BIGINT) AS total_logins_r, CAST(coalesce(tlp,0) AS BIGINT) AS total_logins_p, coalesce(aur,0.0) AS avg_users_r, coalesce(aup,0.0) AS avg_users_p,
  CAST(coalesce(tkr,0) AS BIGINT) AS tickets_r, CAST(coalesce(tkp,0) AS BIGINT) AS tickets_p, coalesce(npr,5.0) AS nps_r, coalesce(npp,5.0) AS nps_p, coalesce(DATE '2024-01-31'-ll,15) AS dias_sem_interacao FROM b_accounts a LEFT JOIN pf USING (account_id)),
 feats AS (SELECT *, ROUND(login_days_r/15.0::DOUBLE*100,1) AS engajamento_pct, ROUND(nps_r,1) AS nps_score, tickets_r AS tickets_abertos,
  ROUND(LEAST(GREATEST((login_days_r-login_days_p)/(login_days_p+1e-6::DOUBLE),-2.0::DOUBLE),2.0::DOUBLE),3) AS engagement_trend, ROUND(LEAST(GREATEST((tickets_r-tickets_p)/(tickets_p+1e-6::DOUBLE),-2.0::DOUBLE),2.0::DOUBLE),3) AS tickets_trend,
  ROUND(nps_r-nps_p,3) AS nps_trend FROM feat)"""
FEATS = ["account_id", "login_days_r", "login_days_p", "total_logins_r", "total_logins_p", "avg_users_r", "avg_users_p", "tickets_r", "tickets_p", "engajamento_pct", "nps_score", "tickets_abertos",
         "engagement_trend", "tickets_trend", "nps_trend", "dias_sem_interacao", "dias_no_contrato"]


def features(t):
    return ac.period_features(t.interactions, t.accounts, AS_OF)


@query("a36_period_features", "A36 J3 M24 Y4 D10 D11 S9", uses="accounts interactions", ctes=PERIOD, sql=f"SELECT {', '.join(FEATS)} FROM feats")
def _(t):
    return features(t).select(*FEATS)


PROFILE = "CASE account_id % 6 WHEN 0 THEN 'healthy' WHEN 1 THEN 'improving' WHEN 2 THEN 'new' WHEN 3 THEN 'at_risk' WHEN 4 THEN 'churning' ELSE 'other' END"
CLIP = lambda x, lo, hi: f"LEAST(GREATEST({x},{lo}::DOUBLE),{hi}::DOUBLE)"


@query("m25_label_probability", "M25 J8", uses="accounts interactions", ctes=PERIOD, sql=f"""
SELECT account_id, ROUND({CLIP(f"(CASE account_id % 6 WHEN 0 THEN 0.95::DOUBLE WHEN 1 THEN 0.80 WHEN 2 THEN 0.75 WHEN 3 THEN 0.35 WHEN 4 THEN 0.08 ELSE 0.5 END) + {CLIP('(engajamento_pct-50)/100',-0.2,0.2)} + {CLIP('(nps_score-5)/20',-0.15,0.15)}", 0.02, 0.98)},6) AS renewal_p,
 CASE account_id % 6 WHEN 0 THEN 0.30::DOUBLE WHEN 1 THEN 0.15 WHEN 2 THEN 0.12 WHEN 3 THEN 0.04 WHEN 4 THEN 0.01 ELSE 0.05 END AS upsell_p FROM feats""")
def _(t):
    renew, up = ac.label_probability(F.expr(PROFILE), F.col("engajamento_pct"), F.col("nps_score"))
    return features(t).select("account_id", F.round(renew, 6).alias("renewal_p"), up.alias("upsell_p"))


@query("m25_label_probability_features", "M25", uses="accounts interactions", ctes=PERIOD + f""", bb AS (SELECT *, {CLIP("0.10::DOUBLE*(engajamento_pct/100) + 0.10::DOUBLE*(nps_score/10) - 0.05::DOUBLE*(tickets_abertos/((SELECT MAX(tickets_abertos)+1 FROM feats)::DOUBLE)) + 0.10::DOUBLE*" + CLIP('engagement_trend',-1,1) + " + 0.10::DOUBLE*" + CLIP('nps_trend',-2,2) + "/2", 0.05, 0.95)} AS b FROM feats)""",
       sql=f"""SELECT account_id, ROUND({CLIP(f"b + {CLIP('(engajamento_pct-50)/100',-0.2,0.2)} + {CLIP('(nps_score-5)/20',-0.15,0.15)}", 0.02, 0.98)},6) AS renewal_p, ROUND({CLIP('b*0.3::DOUBLE',0.01,0.40)},6) AS upsell_p FROM bb""")
def _(t):
    return ac.label_probability_from_features(features(t)).select("account_id", F.round("renewal_p", 6).alias("renewal_p"), F.round("upsell_p", 6).alias("upsell_p"))


@query("m32_health_score", "M32", uses="features", sql="""SELECT account_id, ROUND((0.35::DOUBLE*(login_days_r/15.0) + 0.25::DOUBLE*(nps_r/10.0) + 0.20::DOUBLE*(1-tickets_r/20.0) + 0.15::DOUBLE*(login_days_r/(login_days_r+login_days_p+1.0)) + 0.05::DOUBLE*(max_users/200.0))
 *(CASE segment WHEN 'ENTERPRISE' THEN 1.2::DOUBLE WHEN 'MID_MARKET' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END),6) AS health FROM b_features""")
def _(t):
    f = F.col
    mult = F.when(f("segment") == "ENTERPRISE", 1.2).when(f("segment") == "MID_MARKET", 1.1).otherwise(1.0)
    h = ac.health_score(f("login_days_r") / 15.0, f("nps_r") / 10.0, f("tickets_r"), 20.0, f("login_days_r") / (f("login_days_r") + f("login_days_p") + 1.0), f("max_users") / 200.0, mult)
    return t.features.select("account_id", F.round(h, 6).alias("health"))


# ---- scoring ----


@query("m22_risk_levels", "M22 X17 D12", uses="predictions", sql="""SELECT account_id, risk_level AS level, CASE WHEN upsell_pct/100.0::DOUBLE>0.5 THEN 'HIGH' ELSE 'LOW' END AS upsell_signal, (mrr_at_risk_pc+50)//100 AS mrr_at_risk_cents,
 CASE segment WHEN 'SMB' THEN 0 WHEN 'MID_MARKET' THEN 1 WHEN 'ENTERPRISE' THEN 2 ELSE 1 END AS segment_code, CASE segment WHEN 'ENTERPRISE' THEN 0 WHEN 'MID_MARKET' THEN 1 WHEN 'SMB' THEN 2 ELSE 0 END AS segment_alpha FROM b_predictions""")
def _(t):
    p = shares(t.predictions)
    return p.select(
        "account_id", ac.risk_level(F.col("churn_risk")).alias("level"), ac.upsell_signal(F.col("upsell_probability")).alias("upsell_signal"),
        F.expr("(mrr_at_risk_pc + 50) div 100").alias("mrr_at_risk_cents"), ac.segment_code(F.col("segment")).alias("segment_code"),
        ac.segment_code_alphabetical(F.col("segment"), list(fv.SEGMENT_CODE)).alias("segment_alpha"),
    )


@query("m23_recommended_actions", "M23 B4 W18", uses="predictions", sql="""SELECT account_id, CASE WHEN risk_pct>70 THEN 'ESCALATE|SCHEDULE_CALL|SEND_DISCOUNT' WHEN risk_pct>40 THEN 'SCHEDULE_CALL|SCHEDULE_QBR|SEND_SURVEY'
 WHEN upsell_pct>50 THEN 'PROPOSE_UPSELL|SHARE_ROADMAP|SEND_CONTENT|TRACK_ENGAGEMENT' ELSE 'SEND_CONTENT|TRACK_ENGAGEMENT' END AS actions FROM b_predictions""")
def _(t):
    p = shares(t.predictions)
    return p.select("account_id", F.array_join(ac.recommended_actions(F.col("churn_risk"), F.col("upsell_probability")), "|").alias("actions"))


@query("a27_risk_summary", "A27", uses="predictions", sql=f"""SELECT COUNT(*) AS total, {CNT.format(c="risk_level='HIGH'")} AS high_risk, {CNT.format(c="risk_level='MEDIUM'")} AS medium_risk, {CNT.format(c="risk_level='LOW'")} AS low_risk,
 ROUND(AVG(risk_pct)/100,4) AS avg_churn_risk, CAST(SUM(mrr_at_risk_pc) AS BIGINT) AS mrr_at_risk_pc FROM b_predictions""")
def _(t):
    return ac.risk_summary(t.predictions)


@query("p12_accounts_by_risk", "P12", uses="predictions", sql="SELECT account_id, segment, risk_pct, risk_level, mrr_cents FROM b_predictions WHERE risk_level='HIGH' AND segment='ENTERPRISE' ORDER BY risk_pct DESC, account_id LIMIT 50")
def _(t):
    return ac.accounts_by_risk(t.predictions, "high", "enterprise").select("account_id", "segment", "risk_pct", "risk_level", "mrr_cents")


@query("t06_riskiest_accounts", "T6", uses="predictions", sql="SELECT account_id, risk_pct FROM b_predictions ORDER BY risk_pct DESC, account_id LIMIT 3")
def _(t):
    return ac.accounts_by_risk(t.predictions, limit=3).select("account_id", "risk_pct")


@query("a28_batch_metric", "A28 D18", uses="predictions", sql=f"""SELECT COUNT(*) AS account_count, ROUND(AVG(risk_pct)/100,4) AS avg_churn_risk, {CNT.format(c="risk_level='HIGH'")} AS high_risk_count, {CNT.format(c="risk_level='MEDIUM'")} AS medium_risk_count,
 {CNT.format(c="risk_level='LOW'")} AS low_risk_count, CAST(SUM(mrr_at_risk_pc) AS BIGINT) AS total_mrr_at_risk_pc, ROUND(({CNT.format(c="y=1 AND t=1")}+{CNT.format(c="y=0 AND t=0")})::DOUBLE/COUNT(*),4) AS accuracy,
 ROUND({CNT.format(c="y=1 AND t=1")}::DOUBLE/{CNT.format(c="y=1")},4) AS precision, ROUND({CNT.format(c="y=1 AND t=1")}::DOUBLE/{CNT.format(c="t=1")},4) AS recall,
 ROUND((2*{CNT.format(c="y=1 AND t=1")})::DOUBLE/({CNT.format(c="y=1")}+{CNT.format(c="t=1")}),4) AS f1
 FROM (SELECT *, CASE WHEN risk_level IN ('HIGH','MEDIUM') THEN 1 ELSE 0 END AS y, CASE WHEN (account_id*41) % 100 < 35 THEN 1 ELSE 0 END AS t FROM b_predictions)""")
def _(t):
    return ac.batch_metric(t.predictions, F.expr("(account_id * 41) % 100 < 35"))


BATCHES = "SELECT strftime(logged_at, '%Y-%m-%d') AS batch_at, COUNT(*) AS account_count, AVG((entry_id*37) % 101)/100 AS avg_churn_risk, COUNT(*) FILTER (WHERE (entry_id*37) % 101 > 70) AS high_risk_count, COUNT(*)*100 AS mrr_at_risk, CASE WHEN day(logged_at) % 4 <> 0 THEN day(logged_at)/31.0::DOUBLE END AS precision FROM b_audit GROUP BY 1, day(logged_at)"


def batches(t):
    day = F.dayofmonth("logged_at")
    return t.audit.groupBy(F.date_format("logged_at", "yyyy-MM-dd").alias("batch_at"), day.alias("d")).agg(
        F.count("*").alias("account_count"), (F.avg((F.col("entry_id") * 37) % 101) / 100).alias("avg_churn_risk"), F.expr("count_if((entry_id*37) % 101 > 70)").alias("high_risk_count"),
        (F.count("*") * 100).alias("mrr_at_risk"),
    ).withColumn("precision", F.when(F.col("d") % 4 != 0, F.col("d") / 31.0))


@query("a29_batch_trend", "A29 W17", uses="audit", ctes=f"ba AS ({BATCHES}), lb AS (SELECT * FROM ba ORDER BY batch_at DESC LIMIT 10)", sql="""SELECT COUNT(*) AS rodadas, CAST(SUM(account_count) AS BIGINT) AS total_contas, ROUND(AVG(avg_churn_risk),4) AS avg_churn_risk,
 string_agg(high_risk_count::VARCHAR, ',' ORDER BY batch_at) AS high_risk_trend, string_agg(mrr_at_risk::VARCHAR, ',' ORDER BY batch_at) AS mrr_at_risk_trend, ROUND(AVG(precision),4) AS avg_precision FROM lb""")
def _(t):
    return ac.batch_trend(batches(t))


@query("w17_latest_alert", "W17", uses="audit", ctes=f"ba AS ({BATCHES})", sql="SELECT batch_at, mrr_at_risk AS latest, mrr_at_risk>=30000 AS alert FROM ba ORDER BY batch_at DESC LIMIT 1")
def _(t):
    return ac.latest_alert(batches(t), 30000)


# ---- policy ----


def _cond(field: str, spec: dict) -> str:
    ops = {"gt": ">", "lt": "<", "gte": ">=", "lte": "<="}
    out = []
    for op, w in spec.items():
        out.append(f"upper({field})='{str(w).upper()}'" if op == "eq" else f"{field}{ops[op]}{w}::DOUBLE")
    return " AND ".join(out)


_RULES = sorted(fv.RULES, key=lambda r: r["priority"])
CTXS = "ctxs AS (SELECT *, risk_pct/100.0::DOUBLE AS churn_risk, upsell_pct/100.0::DOUBLE AS upsell_probability, mrr_cents/100.0::DOUBLE AS mrr FROM b_predictions)"
HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT account_id, {i} AS i, '{r['name']}' AS name, {str(bool(r['stop'])).lower()} AS stop FROM ctxs WHERE " + " AND ".join(_cond(k, v) for k, v in r["conditions"].items())
    for i, r in enumerate(_RULES)) + ")"
ACTS = "ra(i, priority, seq, code, reason, channels) AS (VALUES " + ", ".join(
    f"({i}, {r['priority']}, {i * 100 + j}, '{code}', '{r['reason']}', [{', '.join(repr(x) for x in ch)}])" for i, r in enumerate(_RULES) for j, (code, ch) in enumerate(r["actions"])) + ")"
DECIDE = f"""{CTXS}, {HITS}, {ACTS}, cut AS (SELECT account_id, MIN(i) FILTER (WHERE stop) AS c FROM hits GROUP BY 1), kept AS (SELECT h.* FROM hits h JOIN cut USING (account_id) WHERE c IS NULL OR h.i<=c),
 fin AS (SELECT * FROM (SELECT k.account_id, ra.*, ROW_NUMBER() OVER (PARTITION BY k.account_id, ra.code ORDER BY ra.priority, ra.seq) AS rn FROM kept k JOIN ra USING (i)) WHERE rn=1),
 rec AS (SELECT c.account_id, c.risk_level, c.segment, c.mrr_cents, c.mrr_at_risk_pc, coalesce(a.acts,'') AS actions_taken, coalesce(ch.chans,'') AS channels_used, coalesce(a.reasons,'') AS reasons, coalesce(r.rules,'') AS triggered_rules FROM ctxs c
  LEFT JOIN (SELECT account_id, string_agg(code,'|' ORDER BY priority, seq) AS acts, array_to_string(list_distinct(list(reason)),'') AS r0, string_agg(reason,'|' ORDER BY priority, seq) AS reasons FROM fin GROUP BY 1) a USING (account_id)
  LEFT JOIN (SELECT account_id, string_agg(DISTINCT x,'|' ORDER BY x) AS chans FROM (SELECT account_id, unnest(list_append(channels,'console')) AS x FROM fin) GROUP BY 1) ch USING (account_id)
  LEFT JOIN (SELECT account_id, string_agg(name,'|' ORDER BY i) AS rules FROM kept GROUP BY 1) r USING (account_id))"""


def records(t):
    return ac.interventions(shares(t.predictions))


@query("p13_rule_matches", "P13 J13 F4", uses="predictions", ctes=f"{CTXS}, {HITS}", sql="SELECT name, COUNT(*) AS n FROM hits GROUP BY 1")
def _(t):
    p = shares(t.predictions)
    marks = F.array_compact(F.array(*[F.when(policy.matches(p, r), r["name"]) for r in fv.RULES]))
    return p.select(F.explode(marks).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("w21_policy_decisions", "W21 J13 D13 D14", uses="predictions", ctes=DECIDE, sql="""SELECT account_id, actions_taken AS actions, triggered_rules, actions_taken='MONITOR_ONLY' AS monitor_only FROM rec""")
def _(t):
    d = policy.evaluate(shares(t.predictions))
    return d.select("account_id", F.array_join(F.transform("actions", lambda a: a["code"]), "|").alias("actions"), joined("triggered_rules"), "monitor_only")


@query("b05_intervention_records", "B5 U5 W18 D15", uses="predictions", ctes=DECIDE, sql="SELECT account_id, risk_level, actions_taken, channels_used FROM rec")
def _(t):
    return records(t).select("account_id", "risk_level", joined("actions_taken"), joined("channels_used"))


@query("b05_outbox", "B5 K4", uses="predictions", ctes=DECIDE, sql="SELECT account_id, code, priority, x AS channel FROM (SELECT account_id, code, priority, unnest(CASE WHEN list_contains(channels,'console') THEN channels ELSE list_append(channels,'console') END) AS x FROM fin)")
def _(t):
    return ac.outbox(shares(t.predictions)).select("account_id", "code", "priority", "channel")


@query("x14_action_payloads", "X14", uses="predictions")
def _(t):
    return ac.outbox(shares(t.predictions)).select("account_id", "code", "channel", "payload")


SUMMARY = """SELECT 'total' AS section, 'all' AS key, COUNT(*) AS n FROM rec UNION ALL SELECT 'risk', l, COUNT(risk_level) FROM (VALUES ('HIGH'),('MEDIUM'),('LOW')) v(l) LEFT JOIN rec ON rec.risk_level=v.l GROUP BY 1,2
 UNION ALL (SELECT 'action', code, COUNT(*) FROM fin GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5) UNION ALL SELECT 'channel', x, COUNT(DISTINCT account_id) FROM (SELECT account_id, unnest(list_append(channels,'console')) AS x FROM fin) GROUP BY 2"""


@query("a31_intervention_summary", "A31 T9 B6", uses="predictions", ctes=DECIDE, sql=SUMMARY)
def _(t):
    return ac.intervention_summary(records(t))


@query("s07_rule_table", "S7 D23", uses="", ctes=f"{ACTS}, used AS (SELECT DISTINCT 1 AS one FROM customer)", sql="SELECT ra.code, ra.priority, array_to_string(ra.channels,'|') AS channels, (SELECT COUNT(*) FROM customer) AS accounts FROM ra")
def _(t):
    rules = policy.rules_table(t.spark, policy.load_rules(t.spark))
    n = t.accounts.agg(F.count("*").alias("n"))
    return rules.select("code", "priority", F.array_join("channels", "|").alias("channels")).withColumn("accounts", n.scalar())


# ---- portfolio report ----

ACTED = "acted AS (SELECT account_id FROM rec WHERE actions_taken<>'MONITOR_ONLY')"


def recs(t):
    return records(t).withColumn("record_id", F.col("account_id"))


@query("j14_acted_accounts", "J14", uses="predictions", ctes=f"{DECIDE}, {ACTED}", sql="SELECT account_id FROM acted")
def _(t):
    return ac.acted_accounts(recs(t))


@query("j15_top_action", "J15", uses="predictions", ctes=DECIDE, sql="SELECT account_id, split_part(actions_taken,'|',1) AS top_action FROM rec WHERE actions_taken<>''")
def _(t):
    return ac.top_action(recs(t))


KPI = f"""SELECT COUNT(*) AS total_accounts, {CNT.format(c="risk_level='HIGH'")} AS accounts_at_risk, {CNT.format(c="risk_level='HIGH' AND mrr_cents>=500000")} AS critical_accounts, {CNT.format(c="risk_level='MEDIUM'")} AS recoverable_accounts,
 {CNT.format(c="risk_level='LOW'")} AS safe_accounts, CAST(SUM(mrr_cents) AS BIGINT) AS total_mrr_cents, CAST(SUM(mrr_at_risk_pc) AS BIGINT) AS mrr_at_risk_pc,
 CAST(coalesce(SUM(mrr_at_risk_pc) FILTER (WHERE risk_level IN ('HIGH','MEDIUM') AND account_id IN (SELECT account_id FROM acted)),0) AS BIGINT) AS mrr_preserved_pc FROM b_predictions"""


@query("a32_portfolio_kpis", "A32 J14 D20", uses="predictions", ctes=f"{DECIDE}, {ACTED}", sql=KPI)
def _(t):
    return ac.portfolio_kpis(t.predictions, recs(t))


@query("a33_segment_breakdown", "A33", uses="predictions", sql=f"""SELECT coalesce(nullif(segment,''),'UNKNOWN') AS segment, COUNT(*) AS total, {CNT.format(c="risk_level='HIGH'")} AS high_risk, CAST(SUM(mrr_cents) AS BIGINT) AS mrr_cents, CAST(SUM(mrr_at_risk_pc) AS BIGINT) AS mrr_at_risk_pc FROM b_predictions GROUP BY 1""")
def _(t):
    return ac.segment_breakdown(t.predictions)


@query("a34_action_frequency", "A34 T9", uses="predictions", ctes=DECIDE, sql="SELECT code AS action, COUNT(*) AS n FROM fin GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return ac.counts_of(records(t), "actions_taken", "action", 10)


@query("a34_channel_frequency", "A34", uses="predictions", ctes=DECIDE, sql="SELECT x AS channel, COUNT(DISTINCT account_id) AS n FROM (SELECT account_id, unnest(list_append(channels,'console')) AS x FROM fin) GROUP BY 1")
def _(t):
    return ac.counts_of(records(t), "channels_used", "channel")


@query("t03_top_risk_accounts", "T3 J15", uses="predictions", ctes=DECIDE, sql="SELECT p.account_id, p.segment, p.mrr_cents, p.risk_pct, p.risk_level, p.mrr_at_risk_pc, split_part(rec.actions_taken,'|',1) AS top_action FROM b_predictions p JOIN rec USING (account_id) WHERE p.risk_level='HIGH' ORDER BY p.mrr_at_risk_pc DESC, p.account_id LIMIT 10")
def _(t):
    return ac.top_risk_accounts(t.predictions, recs(t))


@query("b07_report_rows", "B7 K11", uses="predictions", ctes=f"{DECIDE}, {ACTED}, k AS ({KPI})", sql=" UNION ALL ".join(f"SELECT 'overview' AS section, '{c}' AS key, CAST({c} AS VARCHAR) AS value FROM k" for c in
       ["total_accounts", "accounts_at_risk", "critical_accounts", "recoverable_accounts", "safe_accounts", "total_mrr_cents", "mrr_at_risk_pc", "mrr_preserved_pc"]) + """
 UNION ALL SELECT 'segment', segment, '{"total":' || COUNT(*) || ',"high_risk":' || COUNT(*) FILTER (WHERE risk_level='HIGH') || ',"mrr_cents":' || CAST(SUM(mrr_cents) AS BIGINT) || ',"mrr_at_risk_pc":' || CAST(SUM(mrr_at_risk_pc) AS BIGINT) || '}' FROM b_predictions GROUP BY segment
 UNION ALL (SELECT 'action', code, COUNT(*)::VARCHAR FROM fin GROUP BY code ORDER BY COUNT(*) DESC, code LIMIT 10)
 UNION ALL SELECT 'channel', x, COUNT(DISTINCT account_id)::VARCHAR FROM (SELECT account_id, unnest(list_append(channels,'console')) AS x FROM fin) GROUP BY x""")
def _(t):
    r = recs(t)
    return ac.report_rows(ac.portfolio_kpis(t.predictions, r), ac.segment_breakdown(t.predictions), ac.counts_of(r, "actions_taken", "action", 10), ac.counts_of(r, "channels_used", "channel"))


@query("x14_executive_summary", "X14 B7", uses="predictions")
def _(t):
    r = recs(t)
    return ac.executive_summary(ac.portfolio_kpis(t.predictions, r), ac.counts_of(r, "actions_taken", "action", 10))


@query("x14_memory_text", "X14 D21", uses="predictions", sql="""SELECT account_id, 'Conta ' || account_id || ': churn_risk=' || risk_pct || '.0% [' || risk_level || '] ações=' || CASE WHEN risk_pct>70 THEN 'ESCALATE,SCHEDULE_CALL,SEND_DISCOUNT' WHEN risk_pct>40 THEN 'SCHEDULE_CALL,SCHEDULE_QBR,SEND_SURVEY'
 WHEN upsell_pct>50 THEN 'PROPOSE_UPSELL,SHARE_ROADMAP,SEND_CONTENT,TRACK_ENGAGEMENT' ELSE 'SEND_CONTENT,TRACK_ENGAGEMENT' END AS text FROM b_predictions""")
def _(t):
    return ac.memory_text(t.predictions)


@query("x14_trend_labels", "X14", uses="accounts interactions", ctes=PERIOD, sql="""SELECT account_id, CASE WHEN engagement_trend>0.10 THEN 'up' WHEN engagement_trend < -0.10 THEN 'down' ELSE 'flat' END AS direction FROM feats""")
def _(t):
    lab = ac.trend_label(F.col("engagement_trend"))
    return features(t).select("account_id", F.when(lab.startswith("↑"), "up").when(lab.startswith("↓"), "down").otherwise("flat").alias("direction"))


# ---- feedback and audit log ----


@query("a35_outcome_counts", "A35 P7 D16", uses="feedback", sql=f"SELECT outcome, COUNT(*) AS n FROM b_feedback WHERE recorded_at >= TIMESTAMP '{END} 00:00:00' - INTERVAL 7 DAYS GROUP BY 1")
def _(t):
    return al.outcome_counts(t.feedback, f"{END} 00:00:00", 7)


@query("p18_feedback_for_correlation", "P18 K9", uses="feedback", sql="SELECT feedback_id, account_id, outcome FROM b_feedback WHERE correlation_id='C42'")
def _(t):
    return al.feedback_for(t.feedback, correlation_id="C42").select("feedback_id", "account_id", "outcome")


@query("p18_audit_for_account", "P18 D17", uses="audit", sql="SELECT entry_id, event_type FROM b_audit WHERE account_id=42")
def _(t):
    return al.entries_of(t.audit, 42).select("entry_id", "event_type")


@query("p19_alert_history", "P19", uses="audit", sql="""SELECT entry_id, account_id, details->>'$.actions' AS actions, details->>'$.channels' AS channels, CAST(details->>'$.risk_pct' AS INT) AS risk_pct, details->>'$.risk_level' AS risk_level, CAST(details->>'$.mrr_at_risk_cents' AS BIGINT) AS mrr_at_risk_cents
 FROM b_audit WHERE event_type='intervention' ORDER BY logged_at DESC, entry_id DESC LIMIT 20""")
def _(t):
    return al.alert_history(t.audit)


@query("p19_predictions_only", "P19", uses="audit", sql="SELECT entry_id FROM b_audit WHERE event_type='prediction'")
def _(t):
    return al.predictions(t.audit).select("entry_id")


@query("a30_audit_summary", "A30 C4", uses="audit", sql="""SELECT COUNT(*) AS total_entries, COUNT(*) FILTER (WHERE event_type='prediction') AS predictions, ROUND(AVG(CAST(details->>'$.risk_pct' AS INT)) FILTER (WHERE event_type='prediction')/100,4) AS avg_churn_risk,
 COUNT(*) FILTER (WHERE event_type='prediction' AND details->>'$.risk_level'='HIGH') AS high_risk_count, CAST(SUM(CAST(details->>'$.mrr_at_risk_cents' AS BIGINT)) FILTER (WHERE event_type='prediction') AS BIGINT) AS total_mrr_at_risk_cents FROM b_audit""")
def _(t):
    return al.summary(t.audit)


@query("a55_riskiest_accounts_log", "A55", uses="audit", sql="SELECT account_id, COUNT(*) AS n FROM b_audit WHERE event_type='prediction' AND details->>'$.risk_level'='HIGH' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return al.riskiest_accounts(t.audit)


@query("a56_mrr_at_risk_by_day", "A56", uses="audit", sql="SELECT strftime(logged_at,'%Y-%m-%d') AS date, CAST(SUM(CAST(details->>'$.mrr_at_risk_cents' AS BIGINT)) AS BIGINT) AS mrr_at_risk_cents FROM b_audit WHERE event_type='prediction' GROUP BY 1")
def _(t):
    return al.mrr_at_risk_by_day(t.audit).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("a56_risk_shares", "A56", uses="audit", sql="SELECT details->>'$.risk_level' AS risk_level, COUNT(*) AS n, COUNT(*)::DOUBLE/(SELECT COUNT(*) FROM b_audit WHERE event_type='prediction') AS share FROM b_audit WHERE event_type='prediction' GROUP BY 1")
def _(t):
    return al.risk_shares(t.audit)


@query("a57_dispatch_success", "A57", uses="audit", ctes="""iv AS (SELECT string_split(details->>'$.channels','|') AS ch, list_transform(string_split(details->>'$.ok','|'), lambda x: CAST(x AS INT)) AS ok FROM b_audit WHERE event_type='intervention'),
 z AS (SELECT ch[i] AS channel, ok[i] AS o FROM (SELECT ch, ok, unnest(range(1, LEAST(len(ch),len(ok))+1)) AS i FROM iv))""", sql="""
SELECT 'overall' AS channel, ROUND(AVG(list_sum(ok)::DOUBLE/len(ok)),9) AS success_rate FROM iv UNION ALL SELECT channel, ROUND(AVG(o),9) FROM z GROUP BY 1""")
def _(t):
    return al.dispatch_success(t.audit).withColumn("success_rate", F.round("success_rate", 9))


@query("w16_log_compaction", "W16 R8", uses="audit", sql="SELECT entry_id, event_type FROM b_audit ORDER BY logged_at DESC, entry_id DESC LIMIT 2000")
def _(t):
    return al.last_entries(t.audit, 2000).select("entry_id", "event_type")


@query("y06_log_retention", "Y6 R8", uses="audit", sql=f"SELECT entry_id FROM b_audit WHERE logged_at >= TIMESTAMP '{END} 00:00:00' - INTERVAL 10 DAYS")
def _(t):
    return al.retention(t.audit, f"{END} 00:00:00", 10).select("entry_id")


@query("a40_rows_since", "A40", uses="hands", sql="SELECT COUNT(*) AS n FROM b_hands WHERE date_utc > TIMESTAMP '2024-01-20 12:00:00'")
def _(t):
    return al.rows_since(t.hands, "date_utc", "2024-01-20 12:00:00")


@query("r07_retrain_due", "R7 A40", uses="hands", sql="SELECT COUNT(*) FILTER (WHERE date_utc > TIMESTAMP '2024-01-30 12:00:00') AS new_rows, 43200 AS elapsed_s, COUNT(*) FILTER (WHERE date_utc > TIMESTAMP '2024-01-30 12:00:00')>=5 AS due FROM b_hands")
def _(t):
    return al.retrain_due(t.hands, "date_utc", "2024-01-30 12:00:00", "2024-01-31 00:00:00")


@query("w19_newest_memories", "W19", sql="SELECT conv_id, turn, role, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) WHERE rank<=3")
def _(t):
    return ac.newest_per_account(t.conversations, "conv_id", "turn", 3).select("conv_id", "turn", "role", "rank")


@query("y05_period_windows", "Y5 B7", uses="feedback", sql=" UNION ALL ".join(f"SELECT '{p}' AS period, COUNT(*) AS n FROM b_feedback WHERE recorded_at >= TIMESTAMP '{END} 00:00:00' - INTERVAL {d} DAYS" for p, d in fv.PERIOD_DAYS.items()))
def _(t):
    fb = t.feedback
    one = fb.agg(*[F.count(F.when(F.col("recorded_at") >= F.lit(str(ac.period_window(AS_OF, p)[0])).cast("timestamp_ntz"), 1)).alias(p) for p in fv.PERIOD_DAYS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(p).alias("n")) for p in fv.PERIOD_DAYS])).alias("r")).select("r.*")
