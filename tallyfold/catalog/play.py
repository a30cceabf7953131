"""Play statistics queries and their SQL twins."""

from pyspark.sql import functions as F

from tallyfold.catalog.registry import query
from tallyfold.functions import fixed_values as fv
from tallyfold.plans import play_stats as ps

R = "ROUND(AVG({c})*100,1)"
TARGETS = "t(hero_position, seat_order, tv, tp) AS (VALUES " + ", ".join(
    f"('{s}', {i}, {fv.SEAT_TARGETS[s][0]}::DOUBLE, {fv.SEAT_TARGETS[s][1]}::DOUBLE)" for i, s in enumerate(fv.REPORT_SEATS)
) + ")"
CNT = "CAST(SUM(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
WON_BB = "SUM(won_cents::DOUBLE / NULLIF(big_blind,0))"


def pc(cond: str) -> str:
    return f"ROUND(AVG(CASE WHEN {cond} THEN 1 ELSE 0 END)*100,1)"


@query("a01_global_stats", "A1", uses="hands", sql="""
SELECT n AS total_hands, ROUND(v/n*100,1) AS vpip_pct, ROUND(p/n*100,1) AS pfr_pct, ROUND((v/n - p/n)*100,1) AS vpip_pfr_gap,
 ROUND(a/GREATEST(v-p,1),2) AS aggression_factor, ROUND(fo/n*100,1) AS fold_pct, ROUND(wi/n*100,1) AS win_pct,
 ROUND(sd/GREATEST(fl,1)*100,1) AS wtsd_pct, ROUND(sw/GREATEST(sd,1)*100,1) AS w_at_sd_pct, CAST(wi AS BIGINT) AS total_wins,
 CAST(fo AS BIGINT) AS total_folds, CAST(sd AS BIGINT) AS went_to_showdown, CAST(al AS BIGINT) AS allin_total,
 ROUND(ll/GREATEST(al,1)*100,1) AS allin_loss_pct, ROUND(m,2) AS avg_m_ratio
FROM (SELECT COUNT(*) AS n, SUM(hero_vpip)::DOUBLE AS v, SUM(hero_pfr)::DOUBLE AS p, SUM(hero_aggressor)::DOUBLE AS a,
 SUM(CASE WHEN hero_result='fold' THEN 1 ELSE 0 END)::DOUBLE AS fo, SUM(CASE WHEN hero_result='win' THEN 1 ELSE 0 END)::DOUBLE AS wi,
 SUM(went_to_showdown)::DOUBLE AS sd, SUM(CASE WHEN went_to_showdown=1 AND hero_result='win' THEN 1 ELSE 0 END)::DOUBLE AS sw,
 SUM(hero_went_allin)::DOUBLE AS al, SUM(CASE WHEN hero_went_allin=1 AND hero_result='allin_loss' THEN 1 ELSE 0 END)::DOUBLE AS ll,
 SUM(CASE WHEN board_flop<>'' AND (hero_action_preflop LIKE '%calls%' OR hero_action_preflop LIKE '%raises%' OR hero_position='BB') THEN 1 ELSE 0 END)::DOUBLE AS fl,
 AVG(m_ratio) AS m FROM b_hands)""")
def _(t):
    return ps.global_stats(t.hands)


@query("a02_by_seat", "A2 T4 J8", uses="hands", ctes=TARGETS, sql=f"""
SELECT hero_position, seat_order, COUNT(*) AS hands, {R.format(c='hero_vpip')} AS vpip_pct, {R.format(c='hero_pfr')} AS pfr_pct,
 ROUND(AVG(hero_vpip)*100 - AVG(hero_pfr)*100,1) AS gap_vp_pfr, {R.format(c='hero_aggressor')} AS aggr_pct, {pc("hero_result='fold'")} AS fold_pct,
 {pc("hero_result='win'")} AS win_pct, {R.format(c='went_to_showdown')} AS wtsd_pct, ROUND(MAX(tv)*100,1) AS gto_vpip_pct, ROUND(MAX(tp)*100,1) AS gto_pfr_pct,
 ROUND(AVG(hero_vpip)*100 - MAX(tv)*100,1) AS vpip_delta, ROUND(AVG(hero_pfr)*100 - MAX(tp)*100,1) AS pfr_delta
FROM b_hands JOIN t USING (hero_position) GROUP BY hero_position, seat_order""")
def _(t):
    return ps.by_seat(t.hands)


@query("a03_by_m_zone", "A3 J18 T4", uses="hands", sql=f"""
SELECT CASE WHEN m_ratio>=20 AND m_ratio<999 THEN 'green' WHEN m_ratio>=10 AND m_ratio<20 THEN 'yellow' WHEN m_ratio>=6 AND m_ratio<10 THEN 'orange'
 WHEN m_ratio>=0 AND m_ratio<6 THEN 'red' ELSE 'green' END AS m_zone, COUNT(*) AS hands, {R.format(c='hero_vpip')} AS vpip_pct,
 {R.format(c='hero_pfr')} AS pfr_pct, {R.format(c='hero_went_allin')} AS allin_pct, {pc("hero_result='win'")} AS win_pct FROM b_hands GROUP BY 1""")
def _(t):
    return ps.by_zone(t.hands)


@query("a04_by_tournament", "A4", uses="spots", sql=f"""
SELECT tournament_name, COUNT(*) AS hands, {R.format(c='hero_vpip')} AS vpip_pct, {R.format(c='hero_pfr')} AS pfr_pct,
 {CNT.format(c="hero_result='win'")} AS wins, CAST(SUM(hero_went_allin) AS BIGINT) AS allins, ROUND(AVG(m_ratio),1) AS avg_m FROM b_spots GROUP BY 1""")
def _(t):
    return ps.by_tournament(t.spots)


@query("a05_daily_trend", "A5 Y2 Y7", uses="hands", sql=f"""
SELECT strftime(hand_date, '%Y-%m-%d') AS date, COUNT(*) AS hands, {R.format(c='hero_vpip')} AS vpip_pct, {R.format(c='hero_pfr')} AS pfr_pct,
 {CNT.format(c="hero_result='win'")} AS wins, CAST(SUM(hero_went_allin) AS BIGINT) AS allins FROM b_hands GROUP BY 1""")
def _(t):
    return ps.daily_trend(t.hands).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("a06_view_by_position", "A6 D5", uses="hands", sql=f"""
SELECT hero_position, COUNT(*) AS total_hands, {R.format(c='hero_vpip')} AS vpip_pct, {R.format(c='hero_pfr')} AS pfr_pct,
 {R.format(c='hero_aggressor')} AS aggression_pct, {R.format(c='hero_went_allin')} AS allin_pct, {R.format(c='went_to_showdown')} AS wtsd_pct,
 CAST(SUM(won_cents) AS BIGINT) AS net_cents, ROUND(AVG(won_cents),2) AS avg_won_per_hand, ROUND(AVG(hero_stack_start::DOUBLE/NULLIF(big_blind,0)),2) AS avg_stack_bb,
 ROUND({WON_BB}/COUNT(*)*100,2) AS bb_per_100 FROM b_hands WHERE hero_position<>'' GROUP BY 1""")
def _(t):
    return ps.stats_by_position(t.hands)


@query("a07_view_by_cards", "A7 D5 P3", uses="hands", sql=f"""
SELECT hero_cards, COUNT(*) AS total_hands, CAST(SUM(hero_vpip) AS BIGINT) AS times_played, CAST(SUM(won_cents) AS BIGINT) AS net_cents,
 ROUND(AVG(won_cents),2) AS avg_won, {R.format(c='went_to_showdown')} AS wtsd_pct, COUNT(*) FILTER (WHERE hero_result='win') AS wins
FROM b_hands WHERE hero_cards<>'' GROUP BY 1 HAVING COUNT(*)>=5""")
def _(t):
    return ps.stats_by_cards(t.hands)


@query("a08_view_session_trend", "A8 D5 J1", uses="hands sessions", sql=f"""
SELECT s.session_id, s.source_file, strftime(s.ingested_at, '%Y-%m-%d') AS session_date, s.hands_count, s.net_cents, {R.format(c='h.hero_vpip')} AS vpip_pct,
 {R.format(c='h.hero_pfr')} AS pfr_pct, ROUND(AVG(h.m_ratio),1) AS avg_m_ratio FROM b_sessions s JOIN b_hands h ON h.session_id=s.session_id GROUP BY 1,2,3,4,5""")
def _(t):
    return ps.session_trend(t.sessions, t.hands).withColumn("session_date", F.date_format("session_date", "yyyy-MM-dd"))


@query("a09_overall_summary", "A9 P3", uses="hands", sql=f"""
SELECT COUNT(*) AS total_maos, {R.format(c='hero_vpip')} AS vpip, {R.format(c='hero_pfr')} AS pfr, {R.format(c='hero_aggressor')} AS agg,
 {R.format(c='went_to_showdown')} AS wtsd, ROUND({WON_BB}/COUNT(*)*100,2) AS bb_per_100 FROM b_hands WHERE big_blind>0""")
def _(t):
    return ps.overall_summary(t.hands)


SEATSUM = f"""SELECT hero_position, COUNT(*) AS maos, {R.format(c='hero_vpip')} AS vpip, {R.format(c='hero_pfr')} AS pfr,
 {R.format(c='hero_aggressor')} AS agg, {R.format(c='went_to_showdown')} AS wtsd, {pc('hero_vpip=0')} AS fold_pct,
 ROUND({WON_BB}/COUNT(*)*100,2) AS bb_per_100 FROM b_hands WHERE big_blind>0 GROUP BY 1"""


@query("a10_seat_summary", "A10 P3 P4", uses="hands", sql=SEATSUM)
def _(t):
    return ps.seat_summary(t.hands)


@query("p04_seat_summary_one", "P4", uses="hands", sql=f"SELECT * FROM ({SEATSUM}) WHERE hero_position='SB'")
def _(t):
    return ps.seat_summary(t.hands, "sb")


@query("m36_seat_flags", "M36", uses="hands", sql=f"""SELECT hero_position, maos, bb_per_100,
 CASE WHEN bb_per_100<0 THEN 'DÉFICIT' WHEN bb_per_100<50 AND maos>=30 THEN 'ABAIXO DO ESPERADO' ELSE '' END AS flag FROM ({SEATSUM})""")
def _(t):
    return ps.seat_flags(t.hands)


@query("a11_newest_sessions", "A11 T1", uses="hands sessions", sql=f"""
SELECT s.session_id, strftime(s.ingested_at, '%Y-%m-%d') AS data, s.hands_count, s.net_cents, {R.format(c='hero_vpip')} AS vpip, {R.format(c='hero_pfr')} AS pfr,
 ROUND(SUM(h.won_cents::DOUBLE/NULLIF(h.big_blind,0))/NULLIF(s.hands_count,0)*100,1) AS bb100
FROM b_sessions s JOIN b_hands h ON h.session_id=s.session_id WHERE h.big_blind>0
GROUP BY s.session_id, s.ingested_at, s.hands_count, s.net_cents ORDER BY s.ingested_at DESC, s.session_id DESC LIMIT 10""")
def _(t):
    return ps.newest_sessions(t.sessions, t.hands).withColumn("data", F.date_format("data", "yyyy-MM-dd"))


@query("a12_recent_vs_overall", "A12 J6", uses="hands sessions", sql="""
SELECT (SELECT ROUND(SUM(h.won_cents::DOUBLE/NULLIF(h.big_blind,0))/COUNT(*)*100,2) FROM (SELECT session_id FROM b_sessions ORDER BY ingested_at DESC, session_id DESC LIMIT 10) s
  JOIN b_hands h ON h.session_id=s.session_id WHERE h.big_blind>0) AS bb100_recente,
 (SELECT ROUND(AVG(h.hero_vpip)*100,1) FROM (SELECT session_id FROM b_sessions ORDER BY ingested_at DESC, session_id DESC LIMIT 10) s
  JOIN b_hands h ON h.session_id=s.session_id WHERE h.big_blind>0) AS vpip_recente,
 (SELECT ROUND(SUM(won_cents::DOUBLE/NULLIF(big_blind,0))/COUNT(*)*100,2) FROM b_hands WHERE big_blind>0) AS bb100_geral,
 (SELECT ROUND(AVG(hero_vpip)*100,1) FROM b_hands WHERE big_blind>0) AS vpip_geral""")
def _(t):
    return ps.recent_vs_overall(t.sessions, t.hands)


@query("a13_entry_patterns", "A13", uses="hands", sql=f"""
SELECT {pc('hero_vpip=1 AND hero_pfr=0')} AS call_only_pct, {pc("hero_action_flop IS NOT NULL AND hero_action_flop<>''")} AS viu_flop_pct,
 {pc("went_to_showdown=1 AND hero_result='loss'")} AS wtsd_loss_pct FROM b_hands WHERE big_blind>0""")
def _(t):
    return ps.entry_patterns(t.hands)


@query("a25_file_rollup", "A25", uses="hands", sql=f"""
SELECT source_file, COUNT(*) AS hands_count, {CNT.format(c="hero_result='win'")} AS hands_won, CAST(SUM(won_cents) AS BIGINT) AS net_cents FROM b_hands GROUP BY 1""")
def _(t):
    return ps.file_rollup(t.hands)


@query("a38_seat_profile", "A38", uses="hands", ctes=TARGETS, sql="""
SELECT hero_position, ROUND(AVG(hero_vpip)*100,1) AS vpip_real, ROUND(MAX(tv)*100,1) AS vpip_gto, ROUND((AVG(hero_vpip)-MAX(tv))*100,1) AS vpip_diff,
 ROUND(AVG(hero_pfr)*100,1) AS pfr_real, ROUND(MAX(tp)*100,1) AS pfr_gto, ROUND((AVG(hero_pfr)-MAX(tp))*100,1) AS pfr_diff
FROM b_hands JOIN t USING (hero_position) GROUP BY 1 HAVING COUNT(*)>=10""")
def _(t):
    return ps.seat_profile_deviation(t.hands)


@query("a39_dataset_signature", "A39", uses="hands", sql="""
SELECT COUNT(*) || ':' || strftime(MAX(date_utc), '%Y-%m-%d %H:%M:%S') || ':all:default' AS signature FROM b_hands""")
def _(t):
    return ps.dataset_signature(t.hands)


SEAT_RATES = """r AS (SELECT hero_position, COUNT(*) AS n, ROUND(AVG(hero_vpip)*100,1) AS v, ROUND(AVG(hero_pfr)*100,1) AS p,
 ROUND(AVG(hero_vpip)*100-AVG(hero_pfr)*100,1) AS g, MAX(tv)*100 AS tv, MAX(tp)*100 AS tp FROM b_hands JOIN t USING (hero_position) GROUP BY 1 HAVING COUNT(*)>=10),
 o AS (SELECT SUM(CASE WHEN hero_result='fold' THEN 1 ELSE 0 END)::DOUBLE/COUNT(*) AS f, SUM(hero_went_allin) AS al,
  SUM(CASE WHEN hero_went_allin=1 AND hero_result='allin_loss' THEN 1 ELSE 0 END)::DOUBLE/NULLIF(SUM(hero_went_allin),0) AS ll FROM b_hands)"""


@query("m33_rule_findings", "M33", uses="hands", ctes=f"{TARGETS}, {SEAT_RATES}", sql="""
SELECT hero_position, 'VPIP Baixo' AS kind, v AS value, tv AS target, CASE WHEN v<tv*0.5 THEN 'ALTA' ELSE 'MÉDIA' END AS severity FROM r WHERE v<tv*0.7
UNION ALL SELECT hero_position, 'VPIP Alto', v, tv, 'ALTA' FROM r WHERE v>tv*1.4
UNION ALL SELECT hero_position, 'Call Station', g, 15.0::DOUBLE, 'MÉDIA' FROM r WHERE g>15
UNION ALL SELECT hero_position, 'PFR Baixo', p, tp, 'MÉDIA' FROM r WHERE p<tp*0.65 AND v>0
UNION ALL SELECT 'GERAL', 'Fold Rate Global', f*100, 90.0::DOUBLE, 'ALTA' FROM o WHERE f>0.92
UNION ALL SELECT 'GERAL', 'All-In Bad Spots', ll*100, 50.0::DOUBLE, 'ALTA' FROM o WHERE al>=3 AND ll>0.5""")
def _(t):
    return ps.findings(t.hands)


@query("b10_statistics_sections", "B10 K1", uses="hands", sql="""
SELECT 'by_m_ratio' AS section, CAST(COUNT(DISTINCT CASE WHEN m_ratio>=20 AND m_ratio<999 THEN 1 WHEN m_ratio>=10 AND m_ratio<20 THEN 2 WHEN m_ratio>=6 AND m_ratio<10 THEN 3 WHEN m_ratio>=0 AND m_ratio<6 THEN 4 ELSE 1 END) AS BIGINT) AS section_rows FROM b_hands
UNION ALL SELECT 'by_position', COUNT(DISTINCT hero_position) FROM b_hands
UNION ALL SELECT 'session_trend', COUNT(DISTINCT hand_date) FROM b_hands
UNION ALL SELECT 'summary', 1""")
def _(t):
    hands = t.hands
    parts = ps.sections(t.sessions, hands.withColumn("tournament_name", F.col("source_file")))
    out = None
    for name in ("summary", "by_position", "by_m_ratio", "session_trend"):
        p = parts[name].agg(F.lit(name).alias("section"), F.count("*").alias("section_rows"))
        out = p if out is None else out.unionByName(p)
    return out
