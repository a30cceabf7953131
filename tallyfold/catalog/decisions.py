"""Hand ranges, decision rules, decision audit and request-log queries with their SQL twins."""

from pyspark.sql import functions as F

from tallyfold.catalog import leaks_sql as q
from tallyfold.catalog.registry import query
from tallyfold.functions import cards, fixed_values as fv, play
from tallyfold.operators import ranges
from tallyfold.plans import audit_log, decisions as dc, requests as rq

RK = "'AKQJT98765432'"
LABEL = f"""lb AS (SELECT *, CASE WHEN r1=r2 THEN r1||r1 WHEN instr({RK},r1)<instr({RK},r2) THEN r1||r2||k ELSE r2||r1||k END AS label FROM (
 SELECT *, substr(hero_cards,1,1) AS r1, substr(hero_cards,4,1) AS r2, CASE WHEN substr(hero_cards,2,1)=substr(hero_cards,5,1) THEN 's' ELSE 'o' END AS k FROM b_spots))"""
TIERS = " ".join("WHEN {l} IN (" + ", ".join(f"'{h}'" for h in hs.split()) + f") THEN {t}" for t, hs in fv.TIERS.items())


def tier(x: str) -> str:
    return f"(CASE {TIERS.replace('{l}', x)} ELSE 6 END)"


DIMS = f"""rk AS (SELECT unnest(string_split('A K Q J T 9 8 7 6 5 4 3 2',' ')) AS r), ri AS (SELECT r, instr({RK}, r) AS i FROM rk),
 dims AS (SELECT a.r||b.r||k.k AS label, a.i AS hi, b.i AS lo, k.k AS kind FROM ri a, ri b, (VALUES ('s'),('o')) k(k) WHERE a.i<b.i UNION ALL SELECT r||r, i, i, 'p' FROM ri),
 notes(seat, note) AS (VALUES {", ".join(f"('{s}','{n}')" for s, ns in fv.OPENING.items() for n in ns)}),
 np AS (SELECT seat, note, contains(note,'+') AS plus, instr({RK},note[1]) AS h, instr({RK},note[2]) AS l, CASE WHEN note[1]=note[2] THEN 'p' ELSE note[3] END AS kind FROM notes),
 opening AS (SELECT DISTINCT seat, label FROM np JOIN dims USING (kind) WHERE (NOT plus AND hi=h AND lo=l) OR (plus AND kind='p' AND hi<=h) OR (plus AND kind<>'p' AND h<=5 AND hi=h AND lo<l)),
 ex(kind, seat, labels) AS (VALUES {", ".join(f"('{k}','{s}','{h}')" for k, tb in (("value", fv.RERAISE_VALUE), ("bluff", fv.RERAISE_BLUFF), ("flat", fv.FLAT)) for s, h in tb.items())}),
 exl AS (SELECT kind, seat, unnest(string_split(labels,' ')) AS label FROM ex)"""
SEATED = f"""st AS (SELECT *, {q.seat('hero_position')} AS seat, hero_stack_start/GREATEST(big_blind,1) AS stack_bb FROM lb),
 fl AS (SELECT st.*, EXISTS(SELECT 1 FROM opening o WHERE o.seat=st.seat AND o.label=st.label) AS in_open, EXISTS(SELECT 1 FROM exl e WHERE e.kind='value' AND e.seat=st.seat AND e.label=st.label) AS in_value,
  EXISTS(SELECT 1 FROM exl e WHERE e.kind='bluff' AND e.seat=st.seat AND e.label=st.label) AS in_bluff, EXISTS(SELECT 1 FROM exl e WHERE e.kind='flat' AND e.seat=st.seat AND e.label=st.label) AS in_flat, {tier('label')} AS tier FROM st)"""
CTES = f"{LABEL}, {DIMS}, {SEATED}"


def seated(t):
    return t.spots.select("*", play.seat("hero_position").alias("seat"), cards.label_from_pair("hero_cards").alias("label"), play.in_bb("hero_stack_start", "big_blind").alias("stack_bb"))


@query("x02_hand_labels", "X2 J8", uses="spots", ctes=LABEL, sql=f"SELECT id, label AS pair_label, label AS packed_label, label AS short_label, {tier('label')} AS tier FROM lb")
def _(t):
    lab = cards.label_from_pair("hero_cards")
    d = t.spots.select("id", lab.alias("pair_label"), cards.label_from_any(F.replace("hero_cards", F.lit(" "), F.lit(""))).alias("packed_label"))
    return d.select("*", cards.label_from_any("pair_label").alias("short_label"), cards.tier_of(F.col("pair_label")).alias("tier"))


@query("x15_opening_ranges", "X15 D24", uses="spots", ctes=f"{CTES}", sql="SELECT o.seat, o.label, COUNT(fl.id) AS n FROM opening o LEFT JOIN fl ON fl.seat=o.seat AND fl.label=o.label GROUP BY 1,2")
def _(t):
    seen = seated(t).groupBy("seat", "label").agg(F.count("*").alias("n"))
    return ranges.opening_ranges(t.spark).join(seen, ["seat", "label"], "left").select("seat", "label", F.coalesce("n", F.lit(0)).alias("n"))


@query("j12_range_membership", "J12", uses="spots", ctes=CTES, sql="SELECT id, seat, label, in_open, in_value, in_bluff, in_flat FROM fl")
def _(t):
    return ranges.with_range_flags(seated(t).select("id", "seat", "label"))


DEPTHS = {"UTG": [10, 15, 20, 40, 100], "LJ": [10, 20, 40, 100], "HJ": [10, 20, 50], "CO": [8, 12, 20, 50], "BTN": [8, 12, 20, 30, 50, 100], "SB": [6, 10, 14, 20]}


@query("j11_nearest_depth", "J11", uses="spots", ctes=f"""{CTES}, dp(seat, depth, o) AS (VALUES {", ".join(f"('{s}',{d}::DOUBLE,{i})" for s, ds in DEPTHS.items() for i, d in enumerate(ds))}),
 best AS (SELECT st.id, first(dp.depth ORDER BY ABS(dp.depth-st.stack_bb), dp.o) AS depth FROM st JOIN dp USING (seat) GROUP BY 1)""", sql="SELECT st.id, st.seat, best.depth FROM st LEFT JOIN best USING (id)")
def _(t):
    return seated(t).select("id", "seat", ranges.nearest_depth(F.col("seat"), F.col("stack_bb"), DEPTHS).alias("depth"))


STYLE_VALUES = ", ".join(f"('{n}',{i},{(a + b) / 2}::DOUBLE,{(c + d) / 2}::DOUBLE)" for i, (n, (a, b, c, d)) in enumerate(fv.STYLES.items()))


@query("j17_nearest_style", "J17 A38", uses="hands", ctes=f"hr AS (SELECT hero_id, AVG(hero_vpip) AS v, AVG(hero_pfr) AS p FROM b_hands GROUP BY 1), sy(name,o,vm,pm) AS (VALUES {STYLE_VALUES})",
       sql="SELECT hero_id, first(name ORDER BY sqrt(pow(v-vm,2)+pow(p-pm,2)), o) AS style FROM hr, sy GROUP BY 1")
def _(t):
    r = t.hands.groupBy("hero_id").agg(F.avg("hero_vpip").alias("v"), F.avg("hero_pfr").alias("p"))
    return r.select("hero_id", ranges.nearest_style(F.col("v"), F.col("p")).alias("style"))


@query("j19_profile_alerts", "J19", uses="hands", sql=f"""SELECT id, CASE WHEN hero_position IN ('CO','BTN','SB','BB') AND upper(hero_action_preflop) LIKE '%FOLD%' THEN 'tight' WHEN hero_position IN ('UTG','MP') AND regexp_matches(upper(hero_action_preflop),'RFI|3-BET|FLAT|ALL-IN') THEN 'loose'
 WHEN hero_position='HJ' AND upper(hero_action_preflop) LIKE '%FLAT%' THEN 'pfr' ELSE '' END AS alert FROM b_hands""")
def _(t):
    a = ranges.profile_alert(F.col("hero_position"), F.col("hero_action_preflop"))
    return t.hands.select("id", F.when(a.contains(" tight"), "tight").when(a.contains(" loose"), "loose").when(a.startswith("PFR"), "pfr").otherwise("").alias("alert"))


@query("m17_bet_sizes", "M16 M17", uses="spots", sql="""SELECT id, 2.0::DOUBLE+2.0::DOUBLE*(num_players%4) AS open_size, ROUND(num_players*3.5::DOUBLE,1) AS reraise_size, ROUND(num_players*2.5::DOUBLE,1) AS four_bet_size,
 ROUND(num_players*(CASE WHEN m_ratio>=25 THEN 0.75::DOUBLE WHEN m_ratio>=15 THEN 0.5 ELSE 0.33 END),1) AS bet_size, ROUND((ante+1)::DOUBLE/(num_players+ante+1),6) AS odds FROM b_spots""")
def _(t):
    n = F.col("num_players").cast("double")
    eq = F.when(F.col("m_ratio") >= 25, 70).when(F.col("m_ratio") >= 15, 55).otherwise(10)
    return t.spots.select("id", dc.open_size(F.col("num_players") % 4).alias("open_size"), dc.reraise_size(n).alias("reraise_size"), dc.four_bet_size(n).alias("four_bet_size"),
                          play.bet_for_equity(n, eq).alias("bet_size"), F.round(play.pot_odds(n, (F.col("ante") + 1).cast("double")), 6).alias("odds"))


PUSH = "(stack_bb<=10 AND tier<=2) OR (stack_bb<=15 AND tier<=3) OR (stack_bb<=20 AND tier<=2 AND seat IN ('CO','BTN','SB','BB'))"


@query("m18_push_rule", "M18", uses="spots", ctes=CTES, sql=f"SELECT id, ({PUSH}) AS push FROM fl")
def _(t):
    return seated(t).select("id", dc.push(cards.tier_of(F.col("label")), F.col("stack_bb"), F.col("seat")).alias("push"))


HEUR = """CASE WHEN {s3} AND t>4 THEN 'FOLD' WHEN t BETWEEN 1 AND 4 AND stack_bb<=12 THEN 'RAISE' WHEN t BETWEEN 1 AND 2 THEN 'RAISE' WHEN t BETWEEN 3 AND 4 THEN (CASE WHEN {seat} IN ('BTN','CO','SB') THEN 'CALL' ELSE 'FOLD' END) ELSE 'FOLD' END"""
CONF = "CASE WHEN t BETWEEN 1 AND 2 THEN 0.66::DOUBLE WHEN t BETWEEN 3 AND 4 THEN (CASE WHEN stack_bb<=12 THEN 0.60::DOUBLE ELSE 0.56::DOUBLE END) ELSE 0.72::DOUBLE END"
PAIR_TIER = f"CASE WHEN len(label)=2 THEN {tier('label')} ELSE 0 END"


@query("m19_heuristic_decision", "M19 P20 D26", uses="spots", ctes=f"{CTES}, hh AS (SELECT *, {PAIR_TIER} AS t, num_players-1 AS players FROM fl)", sql=f"""SELECT id, CASE WHEN players<2 THEN 'WARNING' ELSE {HEUR.format(s3="(id%3=2)", seat='seat')} END AS action,
 CASE WHEN players<2 THEN 0.0::DOUBLE ELSE {CONF} END AS confidence, players<2 AS abstained FROM hh""")
def _(t):
    g = dc.gated(F.col("label"), F.col("seat"), F.col("stack_bb"), F.col("num_players") - 1, F.col("id") % 3 == 2)
    return seated(t).select("id", g.alias("g")).select("id", "g.action", "g.confidence", "g.abstained")


@query("m20_response_ladders", "M20 J12", uses="spots", ctes=CTES, sql=f"""SELECT id, CASE WHEN in_open THEN 'RFI' ELSE 'FOLD' END AS first_in, CASE WHEN in_value OR in_bluff THEN '3-BET' WHEN in_flat AND num_players<=2 THEN 'FLAT' WHEN in_flat AND tier<=3 THEN 'FLAT' ELSE 'FOLD' END AS vs_open,
 CASE WHEN stack_bb<=25 AND tier<=2 THEN 'ALL-IN' WHEN tier=1 AND 22.5>=stack_bb*0.65 THEN 'ALL-IN' WHEN tier=1 THEN '4-BET' WHEN tier=2 THEN 'CALL' WHEN tier=3 AND len(label)=2 AND seat IN ('CO','BTN') THEN 'CALL' ELSE 'FOLD' END AS vs_3bet FROM fl""")
def _(t):
    d = ranges.with_range_flags(seated(t)).withColumn("tier", cards.tier_of(F.col("label")))
    f = F.col
    return d.select("id", F.when(f("in_open"), "RFI").otherwise("FOLD").alias("first_in"), dc.against_open(f("in_value"), f("in_bluff"), f("in_flat"), f("tier"), f("num_players") > 2).alias("vs_open"),
                    dc.against_3bet(f("label"), f("tier"), f("seat"), f("stack_bb"), F.lit(9.0)).alias("vs_3bet"))


SETM = ", ".join(f"'{x}'" for x in fv.SET_MINING.split())


@query("m35_flat_requirement", "M35 D24", uses="spots", ctes=CTES, sql=f"""SELECT id, num_players*(CASE WHEN label IN ({SETM}) THEN 15 WHEN num_players>3 THEN 10 ELSE 9 END) AS need,
 CASE WHEN hero_position IN ('UTG','MP','LJ','HJ') THEN 'early_middle' WHEN hero_position IN ('CO','BTN') THEN 'late' WHEN hero_position IN ('SB','BB') THEN 'blinds' END AS seat_group FROM fl""")
def _(t):
    return seated(t).select("id", dc.flat_requirement(F.col("num_players"), F.col("label"), F.col("num_players") > 3).alias("need"), play.lookup(F.col("hero_position"), fv.SEAT_GROUP).alias("seat_group"))


@query("m21_value_factor", "M21", uses="spots", sql="""SELECT id, ROUND(1.0::DOUBLE+GREATEST(-0.5::DOUBLE,LEAST(0.5::DOUBLE,won_cents/(GREATEST(big_blind,1)*10.0::DOUBLE))),6) AS factor,
 CASE WHEN num_players*20<120 OR (ABS(m_ratio/50-0.5)<=0.06 AND 1.0::DOUBLE+GREATEST(-0.5::DOUBLE,LEAST(0.5::DOUBLE,won_cents/(GREATEST(big_blind,1)*10.0::DOUBLE))) BETWEEN 0.95::DOUBLE AND 1.05::DOUBLE) THEN 'abstain' ELSE 'high' END AS gate FROM b_spots""")
def _(t):
    fct = play.value_to_factor("won_cents", "big_blind")
    g = play.adjustment_gate(fct, F.col("m_ratio") / 50, F.lit("high"), F.col("num_players") * 20)
    return t.spots.select("id", F.round(fct, 6).alias("factor"), g["confidence"].alias("gate"))


FE = f"""SELECT id, CASE hero_position WHEN 'UTG' THEN 0 WHEN 'UTG+1' THEN 1 WHEN 'MP' THEN 2 WHEN 'HJ' THEN 3 WHEN 'CO' THEN 4 WHEN 'BTN' THEN 5 WHEN 'SB' THEN 6 WHEN 'BB' THEN 7 ELSE 4 END AS position_ord,
 CASE WHEN big_blind<=0 THEN 1 WHEN hero_stack_start/big_blind<20 THEN 0 WHEN hero_stack_start/big_blind<50 THEN 1 ELSE 2 END AS stack_zone, CASE WHEN m_ratio<6 THEN 0 WHEN m_ratio<10 THEN 1 WHEN m_ratio<20 THEN 2 ELSE 3 END AS m_zone,
 CASE WHEN regexp_matches(lower(hero_action_preflop),'raise|3bet|all-in') THEN 2 WHEN regexp_matches(lower(hero_action_preflop),'call|flat') THEN 1 ELSE 0 END AS action_preflop,
 CASE WHEN len(list_distinct([board_flop[2],board_flop[5],board_flop[8]]))=1 THEN 4 WHEN len(list_distinct([board_flop[1],board_flop[4],board_flop[7]]))<3 THEN 3 WHEN len(list_distinct([board_flop[2],board_flop[5],board_flop[8]]))=2 THEN 2 ELSE 1 END AS board_texture,
 num_players, CASE WHEN num_players>2 THEN 1 ELSE 0 END AS multiway, {tier('label')} AS hand_tier, LEAST(level,50) AS level, CASE WHEN hero_position='BTN' THEN 1 ELSE 0 END AS pos_BTN FROM lb"""


@query("m28_model_features", "M28 X7 F1", uses="spots", ctes=LABEL, sql=FE)
def _(t):
    return dc.model_features(t.spots).select("id", "position_ord", "stack_zone", "m_zone", "action_preflop", "board_texture", "num_players", "multiway", "hand_tier", "level", "pos_BTN")


ACT = """CASE WHEN contains(a,'ALL') AND contains(a,'IN') THEN 'ALL-IN' WHEN contains(a,'FOLD') THEN 'FOLD' WHEN contains(a,'CALL') OR contains(a,'FLAT') THEN 'CALL' WHEN contains(a,'RAISE') OR contains(a,'BET') THEN 'BET' ELSE 'FOLD' END"""
JUDGE = f"""{CTES}, j0 AS (SELECT *, upper(hero_action_preflop) AS a, {q.summary('stack_bb')} AS bucket, CASE WHEN stack_bb<=20 THEN (CASE WHEN {PUSH} THEN 'ALL-IN' ELSE 'FOLD' END) WHEN seat<>'BB' THEN (CASE WHEN in_open THEN 'BET' ELSE 'FOLD' END) END AS expected FROM fl WHERE big_blind>0),
 j1 AS (SELECT *, {ACT} AS act0 FROM j0), jd AS (SELECT *, CASE WHEN act0='ALL-IN' AND expected IN ('BET','CALL','FOLD') THEN 'BET' ELSE act0 END AS actual FROM j1),
 mk AS (SELECT *, CASE WHEN pf='fold' AND in_open AND m_ratio>3 THEN 'FOLD_GTO_RANGE' WHEN hero_vpip=1 AND hero_pfr=0 AND seat<>'BB' AND m_ratio>8 THEN 'LIMP_INITIATIVE' WHEN seat='BB' AND pf='fold' THEN NULL
  WHEN hero_vpip=1 AND fa IN ('check','call') AND hero_aggressor=0 AND stack_bb>15 THEN 'PASSIVE_POSTFLOP' WHEN pf='fold' AND m_ratio<=7 AND in_open THEN 'PUSH_FOLD_MISS' END AS mistake
  FROM (SELECT *, CASE WHEN hero_action_preflop LIKE '%all-in%' THEN 'allin' WHEN hero_action_preflop LIKE '%raises%' OR hero_action_preflop LIKE '%bets%' THEN 'raise' WHEN hero_action_preflop LIKE '%calls%' THEN 'call' WHEN hero_action_preflop LIKE '%checks%' THEN 'check' WHEN hero_action_preflop LIKE '%folds%' THEN 'fold' ELSE '' END AS pf,
   CASE WHEN hero_action_flop LIKE '%bets%' THEN 'raise' WHEN hero_action_flop LIKE '%checks%' THEN 'check' ELSE '' END AS fa FROM jd))"""


@query("b11_decision_audit", "B11 A37 X4", uses="spots", ctes=JUDGE, sql="SELECT id, seat, label, bucket, expected, actual FROM jd")
def _(t):
    return dc.judged(t.spots).select("id", "seat", "label", "bucket", "expected", "actual")


@query("a37_concordance", "A37", uses="spots", ctes=JUDGE, sql="""SELECT bucket, COUNT(*) AS n, ROUND(COUNT(*) FILTER (WHERE expected=actual)::DOUBLE/COUNT(*),3) AS share FROM jd WHERE expected IS NOT NULL GROUP BY 1
 UNION ALL SELECT 'overall', COUNT(*), ROUND(COUNT(*) FILTER (WHERE expected=actual)::DOUBLE/COUNT(*),3) FROM jd WHERE expected IS NOT NULL""")
def _(t):
    return dc.concordance(dc.judged(t.spots))


@query("m15_mistakes", "M15 X3", uses="spots", ctes=JUDGE, sql="SELECT id, seat, label, mistake, won_cents FROM mk WHERE mistake IS NOT NULL")
def _(t):
    return dc.mistakes(dc.judged(t.spots))


@query("a41_mistake_counts", "A41", uses="spots", ctes=JUDGE, sql="SELECT mistake, COUNT(*) AS n, " + q.case("mistake", fv.MISTAKE_NAMES, "") + " AS name FROM mk WHERE mistake IS NOT NULL GROUP BY 1")
def _(t):
    return dc.mistake_counts(dc.mistakes(dc.judged(t.spots)))


@query("t05_costliest_mistakes", "T5", uses="spots", ctes=JUDGE, sql="SELECT id, seat, label, mistake, won_cents FROM mk WHERE mistake IS NOT NULL ORDER BY won_cents, id LIMIT 15")
def _(t):
    return dc.costliest_mistakes(dc.mistakes(dc.judged(t.spots)))


# ---- request log ----

PARSE = f"""r0 AS (SELECT *, string_split(line,' ') AS raw FROM b_requests), r1 AS (SELECT *, raw[1]='SET' AS is_set, raw[1]='REVIEW' AS is_review, CASE WHEN raw[1]='REVIEW' THEN raw[2:] ELSE raw END AS t FROM r0),
 r2 AS (SELECT *, CASE WHEN len(t)>5 THEN t[6:] ELSE [] END AS rest FROM r1), r3 AS (SELECT *, len(rest)>0 AND rest[len(rest)]='3BET' AS is_3bet_spot FROM r2),
 r4 AS (SELECT *, CASE WHEN is_3bet_spot THEN rest[1:len(rest)-1] ELSE rest END AS board, upper(t[2]) AS position, TRY_CAST(t[3] AS DOUBLE) AS open_bb, TRY_CAST(t[4] AS DOUBLE) AS stack_bb, upper(t[5]) AS mw, t[1] AS hc FROM r3),
 r5 AS (SELECT *, CASE WHEN len(hc)=4 THEN (CASE WHEN hc[1]=hc[3] THEN hc[1]||hc[1] WHEN instr({RK},hc[1])<instr({RK},hc[3]) THEN hc[1]||hc[3]||(CASE WHEN hc[2]=hc[4] THEN 's' ELSE 'o' END) ELSE hc[3]||hc[1]||(CASE WHEN hc[2]=hc[4] THEN 's' ELSE 'o' END) END) ELSE hc END AS hand,
  CASE WHEN is_set THEN NULL WHEN len(t)<5 THEN 'tokens' WHEN open_bb IS NULL OR stack_bb IS NULL THEN 'numeric' WHEN stack_bb<=0 THEN 'stack' WHEN open_bb<0 THEN 'open' WHEN mw NOT IN ('Y','N') THEN 'multiway' WHEN len(board) IN (1,2) THEN 'board_short' WHEN len(board)>5 THEN 'board_long'
   WHEN len(list_distinct(list_transform(board, lambda x: lower(x))))<len(board) THEN 'board_duplicate' END AS error FROM r4)"""
SCORE = f"""{PARSE}, r6 AS (SELECT *, CASE WHEN len(hand)=2 THEN {tier('hand')} ELSE 0 END AS t6 FROM r5 WHERE NOT is_set),
 r7 AS (SELECT *, CASE WHEN error IS NOT NULL OR len(board)>0 THEN 'WARNING' ELSE {HEUR.format(s3='is_3bet_spot', seat='position').replace(' t>4', ' t6>4').replace(' t BETWEEN', ' t6 BETWEEN')} END AS action FROM r6),
 sc AS (SELECT *, CASE action WHEN 'WARNING' THEN 'WARNING' WHEN 'RAISE' THEN 'BET' ELSE action END AS decision, CASE action WHEN 'WARNING' THEN 'YELLOW' WHEN 'FOLD' THEN 'RED_FOLD' ELSE 'GREEN_INTENSE' END AS color_code FROM r7)"""


@query("x19_request_tokens", "X19 P23", uses="requests", ctes=PARSE, sql="SELECT request_id, is_set, is_review, CASE WHEN error IS NULL AND NOT is_set THEN hand END AS hand, CASE WHEN error IS NULL AND NOT is_set THEN stack_bb END AS stack_bb, (NOT is_set AND is_3bet_spot) AS is_3bet_spot, error FROM r5")
def _(t):
    d = rq.tokenise(t.requests)
    ok = F.col("error").isNull() & ~F.col("is_set")
    return d.select("request_id", "is_set", "is_review", F.when(ok, F.col("hand")).alias("hand"), F.when(ok, F.col("stack_bb")).alias("stack_bb"), (~F.col("is_set") & F.col("is_3bet_spot")).alias("is_3bet_spot"), "error")


CTXSQL = f"""{PARSE}, sv AS (SELECT request_id, session_id, received_at, CASE WHEN is_set THEN TRY_CAST(nullif(regexp_extract(line,' BB=([0-9.]+)',1),'') AS DOUBLE) END AS bb0, CASE WHEN is_set THEN TRY_CAST(nullif(regexp_extract(line,' ANTE=([0-9.]+)',1),'') AS DOUBLE) END AS ante0, CASE WHEN is_set THEN TRY_CAST(nullif(regexp_extract(line,' OPEN=([0-9.]+)',1),'') AS DOUBLE) END AS open0 FROM r5)"""
CARRY = "last_value({c} IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY received_at, request_id ROWS UNBOUNDED PRECEDING)"


@query("r04_session_settings", "R4", uses="requests", ctes=CTXSQL, sql=f"SELECT request_id, {CARRY.format(c='bb0')} AS bb, {CARRY.format(c='ante0')} AS ante, {CARRY.format(c='open0')} AS open_mult FROM sv")
def _(t):
    return rq.with_session_settings(rq.tokenise(t.requests)).select("request_id", "bb", "ante", "open_mult")


@query("x18_request_decisions", "X18 B12 R6", uses="requests", ctes=SCORE, sql="SELECT request_id, action, decision, color_code FROM sc")
def _(t):
    return rq.score(rq.tokenise(t.requests)).select("request_id", "action", "decision", "color_code")


@query("a43_session_counters", "A43 B12 R5", uses="requests", ctes=SCORE, sql="""SELECT session_id, COUNT(*) AS requests, SUM(latency_us)::DOUBLE/COUNT(*) AS avg_latency_us, COUNT(*) FILTER (WHERE color_code='GREEN_INTENSE') AS green, COUNT(*) FILTER (WHERE color_code='RED_FOLD') AS red,
 COUNT(*) FILTER (WHERE color_code NOT IN ('GREEN_INTENSE','RED_FOLD')) AS yellow FROM sc GROUP BY 1""")
def _(t):
    return audit_log.session_counters(rq.score(rq.tokenise(t.requests)))
