"""Leak detection queries and their SQL twins."""

from pyspark.sql import functions as F

from tallyfold.catalog import leaks_sql as q
from tallyfold.catalog.registry import query
from tallyfold.functions import fixed_values as fv, play
from tallyfold.plans import leaks as lk
from tallyfold.session import written

NETWORKS = {"ALPHA": "NET_A", "BETA": "NET_B"}


def r6(*cols):
    """Six decimals; the nudge keeps exact ties on one side in both engines."""
    return [F.round(F.col(c) + 1e-9, 6).alias(c) for c in cols]


def s6(*cols):
    return ", ".join(f"ROUND({c}+1e-9::DOUBLE,6) AS {c}" for c in cols)


def prepared(t, keep=()):
    """Prepared play for plans that read it once."""
    spots = lk.deduped(t.spots)
    return lk.prepare(spots, lk.cluster_by_rule(lk.opponent_rates(spots)), keep)


def detections(t):
    """All detections, a few hundred rows, written once for everything that reads them."""
    return written(lk.detect(lk.prepare_once(t.spots)), "detections")


def chain(t):
    det = detections(t)
    ctx = written(lk.contexts(det, NETWORKS), "contexts")
    sev = written(lk.severity(ctx), "severity")
    return det, ctx, sev, lk.study_plan(sev, det)


@query("a42_opponent_rates", "A42 F5 P21", uses="spots", ctes=q.RATES, sql="""SELECT opponent_key, samples, aggression_rate, call_rate, fold_rate, cbet_rate, opponent_cluster FROM clusters""")
def _(t):
    return lk.cluster_by_rule(lk.opponent_rates(t.spots))


@query("m01_prepared_play", "M1 M2 M3 M5 X1 X6 X7 P15 P16 P17 F1", uses="spots", ctes=q.PREP, sql="""
SELECT id, ROUND(stack_bb+1e-9::DOUBLE,6) AS stack_bb, ROUND(amount_bb+1e-9::DOUBLE,6) AS amount_bb, position, phase, board_texture, line_type, line_street, opponent_type, opponent_cluster, ROUND(cascade+1e-9::DOUBLE,6) AS cascade,
 stack_depth_bucket, stack_bucket FROM prep""")
def _(t):
    return prepared(t).select("id", *r6("stack_bb", "amount_bb"), "position", "phase", "board_texture", "line_type", "line_street", "opponent_type", "opponent_cluster", *r6("cascade"), "stack_depth_bucket", "stack_bucket")


MEASURES = ["vpip", "pfr", "call_rate", "fold_rate", "raise_rate", "cbet_rate", "river_bluff_rate", "fold_to_3bet_rate", "cascade_rate", "total_ev_lost", "avg_loss", "win_rate"]


@query("a14_group_metrics", "A14 A15 W7 F2", uses="spots", ctes=f"{q.PREP},\n{q.G3}", sql=f"""SELECT stack_bucket, position, phase, n, {s6(*MEASURES)}, rep.id AS worst_id,
 m_stack_depth_bucket, m_opponent_type, m_opponent_cluster, m_board_texture, m_line_type FROM g3""")
def _(t):
    g = lk.group_metrics(lk.base_groups(prepared(t)), sets=["seat"])
    return g.select(*lk.GROUP, "n", *r6(*MEASURES), F.col("rep.id").alias("worst_id"), *[f"m_{m}" for m in q.MODES])


@query("a14_group_metrics_by_texture", "A14 P10", uses="spots", ctes=f"{q.PREP},\n{q.G4}", sql=f"""SELECT stack_bucket, position, phase, board_texture, n, {s6(*MEASURES)} FROM g4""")
def _(t):
    g = lk.group_metrics(lk.base_groups(prepared(t)), sets=["texture"])
    return g.select(*lk.GROUP, F.col("by").alias("board_texture"), "n", *r6(*MEASURES))


DET_COLS = ["leak_code", "position", "phase", "stack_bucket", "stack_depth_bucket", "opponent_type", "opponent_cluster", "board_texture", "line_type", "sample_size", "hand_id", "confidence_reason"]
DET_NUM = ["metric", "benchmark", "deviation_pct", "confidence", "error_severity", "ev_expected", "ev_real", "ev_delta", "bubble_factor"]


def _det(codes=None):
    def run(t):
        if codes:
            rules = [r for r in lk.RULES if r[2] in codes]
            d = lk.detect(lk.prepare_once(t.spots), rules=rules, sizing="OVERBETTING" in codes, tilt="TILT_PATTERN" in codes)
        else:
            d = lk.ordered(lk.detect(lk.prepare_once(t.spots)))
        return d.select(*DET_COLS, *r6(*DET_NUM), F.size("evidence").alias("evidence_n"))

    return run


DET_SQL = f"SELECT {', '.join(DET_COLS)}, {s6(*DET_NUM)}, evidence_n FROM det"
FAMILIES = {
    "l01_vpip": ("L1", ["VPIP_LOOSE", "VPIP_TIGHT"]),
    "l02_pfr": ("L2", ["PFR_LOW", "C_BET_STRONG"]),
    "l03_fold": ("L3", ["FOLD_EXCESSIVE"]),
    "l04_call": ("L4", ["CALL_EXCESSIVE"]),
    "l05_reraise": ("L5", ["THREE_BET_WRONG", "FOLD_VS_3BET_HIGH", "FOUR_BET_WRONG"]),
    "l06_postflop": ("L6", ["C_BET_WEAK", "BLUFF_BAD", "OVERPLAY_MEDIUM", "VALUE_BET_LOST"]),
    "l07_sizing": ("L7 A16", ["OVERBETTING"]),
    "l08_tilt": ("L8", ["TILT_PATTERN"]),
    "l09_pressure": ("L9 M4", ["ICM_PASSIVITY", "ICM_SUICIDE"]),
    "l10_timing": ("L10 A16", ["TIMING_IMPULSIVE", "TIMING_TELEGRAPH"]),
}
for _name, (_ids, _codes) in FAMILIES.items():
    query(f"{_name}_detections", _ids, uses="spots", ctes=q.DETECT, sql=DET_SQL + " WHERE leak_code IN (" + ", ".join(f"'{x}'" for x in _codes) + ")")(_det(_codes))

def reingested(t):
    """Every hand, and for half of them an older copy from the same site with another result and line."""
    older = t.spots.where("id % 2 = 0").withColumns({
        "date_utc": F.expr("date_utc - INTERVAL 1 DAY"), "won_cents": F.lit(-99_999).cast(t.spots.schema["won_cents"].dataType), "hero_action_preflop": F.lit("raises 900"),
        "site_name": F.lower("site_name"), "id": F.col("id") + 10_000_000_000,
    })
    return t.spots.unionByName(older)


CHECKED = ["hero_stack_start", "big_blind", "ante", "hero_vpip", "hero_pfr", "won_cents", "m_ratio"]
VALID = f"""vi AS (SELECT COUNT(*) FILTER (WHERE hero_stack_start<=0 OR big_blind<=0 OR hero_stack_start IS NULL OR big_blind IS NULL) > 0 AS bad_stack,
 (COUNT(*) FILTER (WHERE hero_vpip NOT BETWEEN 0 AND 1 OR hero_pfr NOT BETWEEN 0 AND 1) > 0)::INT + (COUNT(*) < 20)::INT + {" + ".join(f"(COUNT(*) > COUNT({c}))::INT" for c in CHECKED)} AS warnings FROM b_spots)"""


@query("b01_validated_detections", "B1 B3 W1 A26", uses="spots", ctes=f"{q.DETECT},\n{VALID}", sql=DET_SQL.replace(" FROM det", ", NOT bad_stack AS validation_ok, CAST(warnings + bad_stack::INT AS BIGINT) AS validation_issues FROM det, vi"))
def _(t):
    det, _ = lk.validated(reingested(t))
    return det.select(*DET_COLS, *r6(*DET_NUM), F.size("evidence").alias("evidence_n"), "validation_ok", "validation_issues")


@query("l07_sizing_columns", "L7 A16", uses="spots", ctes=f"{q.PREP}, sizes AS (SELECT id, amount_bb, went_to_showdown, unnest([struct_pack(c := 'bet_size', v := bet_size::DOUBLE), struct_pack(c := 'raise_size', v := ((id * 17) % 300)::DOUBLE), struct_pack(c := 'river_sizing_bb', v := (CASE WHEN id % 9 < 3 THEN 10 + id % 5 END)::DOUBLE)], recursive := true) FROM prep), sq AS (SELECT c, quantile_cont(v, 0.9) AS q90 FROM sizes GROUP BY c)",
       sql="""SELECT 'OVERBETTING' AS leak_code, c AS size_column, ROUND(AVG(CASE WHEN v > q90 THEN 1.0::DOUBLE ELSE 0 END)+1e-9::DOUBLE, 6) AS metric, COUNT(v) AS sample_size, ROUND(SUM(amount_bb) FILTER (WHERE v IS NOT NULL)+1e-9::DOUBLE, 6) AS ev_real,
 first(id ORDER BY amount_bb, id) FILTER (WHERE v IS NOT NULL) AS hand_id FROM sizes JOIN sq USING (c) GROUP BY c HAVING AVG(CASE WHEN v > q90 THEN 1.0::DOUBLE ELSE 0 END) > 0.05""")
def _(t):
    """Every sizing column of the input, each with its own percentile."""
    hands = t.spots.withColumns({"raise_size": F.expr("(id * 17) % 300"), "river_sizing_bb": F.expr("CASE WHEN id % 9 < 3 THEN 10 + id % 5 END")})
    found = lk.sizing_shares(lk.prepare_once(hands)).where("ratio > 0.05")
    return found.select(F.lit("OVERBETTING").alias("leak_code"), F.col("size_name").alias("size_column"), F.round(F.col("ratio") + 1e-9, 6).alias("metric"), F.col("n").alias("sample_size"), F.round(F.col("ev_real") + 1e-9, 6).alias("ev_real"), F.col("rep.row.id").alias("hand_id"))


query("l11_all_detections", "L11 M9 M10 D6 C1 C2 P8", uses="spots", ctes=q.DETECT, sql=DET_SQL)(_det())

CTX_NUM = ["confidence", "total_ev_lost", "avg_loss_per_hand", "ev_expected", "ev_real", "ev_delta", "vop_deviation"]


@query("a17_contexts", "A17 D7 J9 P22 C2", uses="spots", ctes=f"{q.DETECT},\n{q.CTX}", sql=f"SELECT {q.CTX_KEYS}, frequency, sample_size, {s6(*CTX_NUM)}, confidence_reason FROM ctx")
def _(t):
    return lk.contexts(detections(t), NETWORKS).select(*lk.CONTEXT_KEYS, "frequency", "sample_size", *r6(*CTX_NUM), "confidence_reason")


SEV_NUM = ["frequency_score", "impact_score", "recurrence_score", "context_importance", "distance_from_optimal", "cascade_score", "severity_score", "potential_roi_gain", "bayesian_bb100"]


@query("m12_severity", "M11 M12 A54 A16 D8 M34", uses="spots", ctes=f"{q.DETECT},\n{q.CTX},\n{q.SEV}", sql=f"SELECT {q.CTX_KEYS}, severity_label, distinct_context_values, {s6(*SEV_NUM)} FROM sev")
def _(t):
    return lk.severity(lk.contexts(detections(t), NETWORKS)).select(*lk.CONTEXT_KEYS, "severity_label", "distinct_context_values", *r6(*SEV_NUM))


@query("w03_severity_rank", "W3", uses="spots", ctes=f"{q.DETECT},\n{q.CTX},\n{q.SEV}", sql=f"SELECT {q.CTX_KEYS}, priority_rank FROM sev")
def _(t):
    return lk.severity(lk.contexts(detections(t), NETWORKS)).select(*lk.CONTEXT_KEYS, "priority_rank")


PROFILES = """, pr(h, net, roi, itm, early) AS (VALUES ('ALPHA','NET_A',-88.0::DOUBLE,6.0::DOUBLE,1.0::DOUBLE), ('BETA','NET_B',-91.0::DOUBLE,14.0::DOUBLE,0.0::DOUBLE)),
 sm AS (SELECT s4.*, pr.h, pr.roi, pr.itm, pr.early, LEAST(1.0::DOUBLE, (CASE WHEN leak_code IN ('PFR_LOW','VPIP_TIGHT','FOLD_EXCESSIVE','C_BET_WEAK','CALL_EXCESSIVE') THEN 0.35::DOUBLE ELSE 0 END)
  + (CASE WHEN line_type IN ('SINGLE_RAISED_POT','UNKNOWN','CALL_LINE') THEN 0.10::DOUBLE ELSE 0 END) + (CASE WHEN position IN ('BTN','CO','SB','BB') THEN 0.10::DOUBLE ELSE 0 END)
  + (CASE WHEN stack_depth_bucket IN ('15-20BB','20-25BB','25-35BB') THEN 0.15::DOUBLE ELSE 0 END)) AS small_ball FROM s4 LEFT JOIN pr ON upper(s4.hero_name)=pr.h AND (s4.network='UNKNOWN' OR s4.network=pr.net)),
 sb AS (SELECT *, CASE WHEN h IS NULL THEN raw ELSE LEAST(100.0::DOUBLE, raw*(1.0::DOUBLE + (CASE WHEN roi<=-80 THEN 0.12::DOUBLE ELSE 0 END) + (CASE WHEN itm<10 THEN 0.10::DOUBLE ELSE 0 END) + (CASE WHEN early>=0.95 THEN 0.08::DOUBLE ELSE 0 END)
  + 0.18::DOUBLE*small_ball + (CASE WHEN stack_depth_bucket IN ('15-20BB','20-25BB') THEN 0.14::DOUBLE ELSE 0 END) + (CASE WHEN leak_code LIKE 'ICM\\_%' ESCAPE '\\' THEN 0.10::DOUBLE ELSE 0 END))) END AS boosted FROM sm)"""


@query("m13_slump_boost", "M13", uses="spots", ctes=f"{q.DETECT},\n{q.CTX},\n{q.SEV}{PROFILES}", sql=f"""SELECT {q.CTX_KEYS}, ROUND(CASE WHEN sample_size<12 OR confidence<0.45 THEN LEAST(boosted,59.0::DOUBLE) ELSE boosted END+1e-9::DOUBLE,6) AS severity_score FROM sb""")
def _(t):
    prof = t.spark.createDataFrame([("Alpha", "NET_A", -88.0, 6.0, 1.0), ("Beta", "NET_B", -91.0, 14.0, 0.0)], "hero_name string, network string, roi double, itm double, early_finish_rate double")
    return lk.severity(lk.contexts(detections(t), NETWORKS), prof).select(*lk.CONTEXT_KEYS, *r6("severity_score"))


@query("m14_study_plan", "M14 W4 P14 D9", uses="spots", ctes=q.FULL, sql=f"""SELECT {q.CTX_KEYS}, severity_label, priority, estimated_hours, ROUND(evs_score+1e-9::DOUBLE,6) AS evs_score, ROUND(potential_roi_gain+1e-9::DOUBLE,6) AS expected_roi_gain, position || ' vs field ' || stack_depth_bucket AS spot FROM plan""")
def _(t):
    return chain(t)[3].select(*lk.CONTEXT_KEYS, "severity_label", "priority", "estimated_hours", *r6("evs_score", "expected_roi_gain"), "spot")


@query("w06_representative_hands", "W6", uses="spots", ctes=q.DETECT, sql="""
SELECT leak_code, array_to_string(list(hand_id ORDER BY rn), ',') AS hand_ids FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY leak_code ORDER BY b0 DESC, b1 DESC, b2 DESC, hand_id) AS rn FROM (
 SELECT leak_code, hand_id, b.b0 AS b0, b.b1 AS b1, b.b2 AS b2 FROM (SELECT leak_code, hand_id, first(struct_pack(b0:=error_severity, b1:=confidence, b2:=coalesce(ABS(ev_delta),0)) ORDER BY error_severity DESC, confidence DESC, coalesce(ABS(ev_delta),0) DESC) AS b FROM det GROUP BY 1,2)))
WHERE rn<=5 GROUP BY 1""")
def _(t):
    return lk.representative_hands(detections(t)).select("leak_code", F.array_join(F.transform("representative_hand_ids", lambda x: x.cast("string")), ",").alias("hand_ids"))


@query("a18_breakdown", "A18", uses="spots", ctes=f"{q.DETECT},\n{q.CTX}", sql=" UNION ALL ".join(
    f"SELECT '{name}' AS dimension, {col} AS value, COUNT(*) AS count, ROUND(SUM(total_ev_lost)+1e-9::DOUBLE,6) AS total_ev_lost, CAST(SUM(sample_size) AS BIGINT) AS sample_size, "
    f"ROUND(SUM(confidence*sample_size)/SUM(sample_size)+1e-9::DOUBLE,6) AS avg_confidence, ROUND(SUM(avg_loss_per_hand*sample_size)/SUM(sample_size)+1e-9::DOUBLE,6) AS avg_loss_per_hand FROM ctx GROUP BY {col}"
    for col, name in {"position": "position", "stack_depth_bucket": "stack", "phase": "phase", "opponent_type": "opponent"}.items()))
def _(t):
    return lk.breakdown(lk.contexts(detections(t), NETWORKS)).select("dimension", "value", "count", *r6("total_ev_lost"), "sample_size", *r6("avg_confidence", "avg_loss_per_hand"))


@query("a19_severity_counts", "A19", uses="spots", ctes=f"{q.DETECT},\n{q.CTX},\n{q.SEV}", sql="""SELECT l AS severity_label, COUNT(severity_label) AS n FROM (VALUES ('CRÍTICO'),('ALTO'),('MÉDIO'),('BAIXO')) v(l) LEFT JOIN sev ON sev.severity_label=v.l GROUP BY 1""")
def _(t):
    return lk.severity_counts(lk.severity(lk.contexts(detections(t), NETWORKS)))


@query("a20_report_metrics", "A20", uses="spots", ctes=q.FULL, sql="""
SELECT (SELECT COUNT(*) FROM b_spots) AS total_hands, (SELECT CAST(GREATEST(0,-SUM(won_cents)) AS BIGINT) FROM b_spots) AS total_cents_lost, (SELECT AVG(CASE WHEN hero_result='win' THEN 1.0::DOUBLE ELSE 0 END) FROM b_spots) AS win_rate,
 (SELECT COUNT(*) FROM det) AS leaks_detected, (SELECT COUNT(*) FROM ctx) AS contexts_analyzed, (SELECT COUNT(*) FROM sev WHERE severity_label='CRÍTICO') AS critical_leaks, (SELECT COUNT(*) FROM sev WHERE severity_label='ALTO') AS high_leaks,
 (SELECT ROUND(SUM(potential_roi_gain),4) FROM sev) AS total_potential_gain, (SELECT ROUND(SUM(potential_roi_gain),4) FROM sev WHERE priority_rank<=10) AS top10_potential_gain, (SELECT leak_code FROM sev WHERE priority_rank=1) AS top_leak,
 (SELECT ROUND(SUM(estimated_hours),1) FROM plan) AS estimated_study_hours, (SELECT ROUND(SUM(estimated_hours),1) FROM plan WHERE priority<=5) AS recommended_study_hours, '' AS analysis_warning""")
def _(t):
    m = lk.report_metrics(t.spots, *chain(t))
    for k, d in {"total_potential_gain": 4, "top10_potential_gain": 4, "estimated_study_hours": 1, "recommended_study_hours": 1}.items():
        m = m.withColumn(k, F.round(k, d))
    return m


@query("t02_costly_spots", "T2", uses="spots", ctes=f"{q.DETECT},\n{q.CTX}", sql=f"SELECT {q.CTX_KEYS}, ROUND(total_ev_lost+1e-9::DOUBLE,6) AS total_ev_lost FROM ctx ORDER BY ctx.total_ev_lost DESC, {q.CTX_KEYS} LIMIT 10")
def _(t):
    return lk.costly_spots(lk.contexts(detections(t), NETWORKS)).select(*lk.CONTEXT_KEYS, *r6("total_ev_lost"))


@query("t07_ranked_slices", "T7 B9", uses="spots", ctes=q.FULL, sql="""
SELECT 'top_leaks' AS section, priority_rank AS rank, leak_code, position, severity_label, ROUND(severity_score+1e-9::DOUBLE,6) AS score FROM sev WHERE priority_rank<=10
UNION ALL SELECT 'study_plan', priority, leak_code, position, severity_label, ROUND(evs_score+1e-9::DOUBLE,6) FROM plan WHERE priority<=8""")
def _(t):
    _, _, sev, plan = chain(t)
    a = sev.where("priority_rank <= 10").select(F.lit("top_leaks").alias("section"), F.col("priority_rank").alias("rank"), "leak_code", "position", "severity_label", F.round(F.col("severity_score") + 1e-9, 6).alias("score"))
    b = plan.where("priority <= 8").select(F.lit("study_plan").alias("section"), F.col("priority").alias("rank"), "leak_code", "position", "severity_label", F.round(F.col("evs_score") + 1e-9, 6).alias("score"))
    return a.unionByName(b)


@query("p11_filter_ranked", "P11", uses="spots", ctes=f"{q.DETECT},\n{q.CTX},\n{q.SEV}", sql="""
SELECT 'position' AS by_what, 'BTN' AS value, COUNT(*) AS leaks, ROUND(SUM(potential_roi_gain),4) AS total_cost FROM sev WHERE position='BTN'
UNION ALL SELECT 'stack', 'LOW', COUNT(*), ROUND(SUM(potential_roi_gain),4) FROM sev WHERE upper(stack_bucket)='LOW'""")
def _(t):
    sev = lk.severity(lk.contexts(detections(t), NETWORKS))
    total = [F.count("*").alias("leaks"), F.round(F.sum("potential_roi_gain"), 4).alias("total_cost")]
    a = sev.where("position = 'BTN'").agg(*total).select(F.lit("position").alias("by_what"), F.lit("BTN").alias("value"), "leaks", "total_cost")
    b = sev.where("upper(stack_bucket) = 'LOW'").agg(*total).select(F.lit("stack").alias("by_what"), F.lit("LOW").alias("value"), "leaks", "total_cost")
    return a.unionByName(b)


@query("w15_top_components", "W15 C3", uses="spots", ctes=f"{q.DETECT},\n{q.CTX},\n{q.SEV}", sql=f"""SELECT {q.CTX_KEYS}, ROUND(ROUND(impact_score*0.28::DOUBLE,4),3) AS impact_ev, ROUND(ROUND(ease*100*0.12::DOUBLE,4),3) AS ease_of_fix,
 array_to_string(list_transform(list_sort([struct_pack(v:=-(impact_score*0.28::DOUBLE), i:=0, k:='impact_ev'), struct_pack(v:=-(recurrence_score*0.16::DOUBLE), i:=1, k:='recurrence_volume'), struct_pack(v:=-(frequency_score*0.16::DOUBLE), i:=2, k:='frequency'),
  struct_pack(v:=-(context_importance*0.16::DOUBLE), i:=3, k:='context_stack_phase'), struct_pack(v:=-(ease*100*0.12::DOUBLE), i:=4, k:='ease_of_fix'), struct_pack(v:=-(distance_from_optimal*100*0.08::DOUBLE), i:=5, k:='distance_from_optimal'),
  struct_pack(v:=-(cascade_score*0.04::DOUBLE), i:=6, k:='cascade_effect'), struct_pack(v:=-(LEAST(100.0::DOUBLE,vop*100)*0.05::DOUBLE), i:=7, k:='vop_deviation')])[1:3], lambda e: e.k), ', ') AS top_names FROM sev""")
def _(t):
    sev = lk.severity(lk.contexts(detections(t), NETWORKS))
    return sev.select(*lk.CONTEXT_KEYS, F.round(F.col("components")["impact_ev"], 3).alias("impact_ev"), F.round(F.col("components")["ease_of_fix"], 3).alias("ease_of_fix"), F.regexp_replace("why_i_lost", "=[0-9.]+", "").alias("top_names"))


@query("b01_study_report_rows", "B1 K11 X14")
def _(t):
    return lk.recommendation_text(chain(t)[3]).select("priority", "leak_code", "spot", "estimated_hours", "recommendation_text")


LAST = """, lastc AS (SELECT leak_code, first(struct_pack(sc:=severity_score, lb:=severity_label, rk:=priority_rank) ORDER BY priority_rank DESC) AS s FROM sev GROUP BY 1),
 lab AS (SELECT hand_id, leak_code AS study_leak_code, s.sc AS sc, confidence AS cf, s.lb AS lb, s.rk AS rk, ROW_NUMBER() OVER (PARTITION BY hand_id ORDER BY s.sc DESC, confidence DESC, leak_code) AS rn FROM det JOIN lastc USING (leak_code)),
 enr AS (SELECT b.*, coalesce(study_leak_code,'NONE') AS study_leak_code, coalesce(sc,0.0) AS study_severity_score, coalesce(cf,0.0) AS study_confidence, coalesce(lb,'BAIXO') AS study_severity_label, coalesce(rk,999) AS study_priority_rank
  FROM b_spots b LEFT JOIN (SELECT * FROM lab WHERE rn=1) l ON l.hand_id=b.id)"""


@query("j04_label_enrichment", "J4 W5 J8 B3", uses="spots", ctes=q.FULL + LAST, sql="SELECT id, study_leak_code, ROUND(study_severity_score+1e-9::DOUBLE,6) AS study_severity_score, ROUND(study_confidence+1e-9::DOUBLE,6) AS study_confidence, study_severity_label, study_priority_rank FROM enr")
def _(t):
    det, _, sev, _ = chain(t)
    e = lk.enrich_with_labels(t.spots, lk.study_labels(det, sev))
    return e.select("id", "study_leak_code", *r6("study_severity_score", "study_confidence"), "study_severity_label", "study_priority_rank")


@query("a24_weekly_missions", "A24 B3", uses="spots", ctes=q.FULL + LAST, sql="""SELECT study_leak_code AS topic, MIN(study_priority_rank) AS study_priority_rank, ROUND(MAX(study_severity_score),3) AS study_severity_score, ROUND(AVG(study_confidence),3) AS study_confidence,
 ROUND(SUM(coalesce(GREATEST(-won_cents,0)::DOUBLE/NULLIF(big_blind,0),0)),3) AS ev_loss_accumulated_bb, COUNT(*) AS occurrences FROM enr WHERE study_leak_code<>'NONE' GROUP BY 1 ORDER BY 2, 5 DESC LIMIT 3""")
def _(t):
    det, _, sev, _ = chain(t)
    return lk.weekly_missions(lk.enrich_with_labels(t.spots, lk.study_labels(det, sev)))
