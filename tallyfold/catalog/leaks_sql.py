"""SQL building blocks for the detection oracles."""

from tallyfold.functions import fixed_values as fv


def case(expr: str, table: dict, default) -> str:
    q = lambda v: "'" + str(v) + "'" if isinstance(v, str) else f"{v}::DOUBLE"
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in table.items()) + f" ELSE {q(default)} END"


def seat(x: str) -> str:
    return f"CASE upper(trim({x})) WHEN 'UTG+1' THEN 'LJ' WHEN 'UTG1' THEN 'LJ' WHEN 'EP' THEN 'LJ' WHEN 'MP' THEN 'HJ' WHEN 'MIDDLE' THEN 'HJ' ELSE upper(trim({x})) END"


def phase(m: str) -> str:
    return f"CASE WHEN {m}<=0 THEN 'UNKNOWN' WHEN {m}>20 THEN 'EARLY' WHEN {m}>10 THEN 'MIDDLE' WHEN {m}>5 THEN 'BUBBLE' WHEN {m}>2 THEN 'ITM' ELSE 'FINAL_TABLE' END"


def band(x: str) -> str:
    return f"CASE WHEN {x}<0 THEN '50bb+' WHEN {x}<10 THEN '0-10bb' WHEN {x}<15 THEN '10-15bb' WHEN {x}<20 THEN '15-20bb' WHEN {x}<25 THEN '20-25bb' WHEN {x}<35 THEN '25-35bb' WHEN {x}<50 THEN '35-50bb' ELSE '50bb+' END"


def summary(x: str) -> str:
    return f"CASE WHEN {x}<0 THEN 'HIGH' WHEN {x}<20 THEN 'LOW' WHEN {x}<50 THEN 'MID' ELSE 'HIGH' END"


def texture(x: str) -> str:
    """For spaced boards."""
    r = f"list_transform(string_split({x},' '), lambda z: z[1])"
    s = f"list_transform(string_split({x},' '), lambda z: z[2])"
    i = f"list_transform({r}, lambda z: instr('23456789TJQKA', z))"
    pair = f"len(list_distinct({r}))<len({r})"
    near = f"list_max({i})-list_min({i})<=4"
    ns = f"len(list_distinct({s}))"
    return (f"CASE WHEN len(string_split({x},' '))<3 THEN 'NO_BOARD' WHEN {ns}=1 THEN 'MONOTONE' WHEN {pair} AND {near} THEN 'PAIRED_CONNECTED' "
            f"WHEN {pair} THEN 'PAIRED' WHEN {ns}=2 AND {near} THEN 'WET_CONNECTED' WHEN {ns}=2 THEN 'WET' WHEN {near} THEN 'CONNECTED' ELSE 'DRY' END")


def norm(x: str) -> str:
    return f"replace(replace(replace(upper(trim(coalesce({x},''))),'→',':'),'BET/RAISE','RAISE'),'ALL IN','ALL-IN')"


ACTS = "list_filter([" + ", ".join(norm(f"hero_action_{s}") for s in ("preflop", "flop", "turn", "river")) + "], lambda z: z<>'')"
RAW_ACTS = "[" + ", ".join(f"upper(coalesce(hero_action_{s},''))" for s in ("preflop", "flop", "turn", "river")) + "]"
LINE = ("CASE WHEN len(acts)=0 THEN 'UNKNOWN' WHEN len(list_filter(acts, lambda z: contains(z,'ALL-IN')))>0 THEN 'JAM' "
        "WHEN contains(acts[1],'3BET') OR contains(acts[1],'4BET') THEN '3BET_POT' "
        "WHEN (contains(acts[1],'RAISE') OR contains(acts[1],'BET')) AND len(list_filter(acts[2:], lambda z: contains(z,'BET')))>0 THEN 'AGGRESSIVE_POSTFLOP' "
        "WHEN contains(acts[1],'RAISE') OR contains(acts[1],'BET') THEN 'AGGRESSIVE_PREFLOP' "
        "WHEN contains(acts[1],'CALL') AND len(list_filter(acts[2:], lambda z: contains(z,'BET')))>0 THEN 'CALL_LEAD' "
        "WHEN len(list_filter(acts, lambda z: NOT (contains(z,'CHECK') OR contains(z,'FOLD'))))=0 THEN 'PASSIVE' ELSE 'MIXED' END")
LINE_STREET = ("CASE WHEN len(list_filter(raw_acts, lambda z: z<>''))=0 THEN 'UNKNOWN' WHEN len(list_filter(raw_acts, lambda z: contains(z,'ALL-IN')))>0 THEN 'JAM' "
               "WHEN contains(raw_acts[1],'3BET') OR contains(raw_acts[1],'4BET') THEN '3BET_POT' WHEN len(list_filter(raw_acts[2:], lambda z: contains(z,'BET')))>0 THEN 'AGGRESSIVE_POSTFLOP' "
               "WHEN len(list_filter(raw_acts, lambda z: contains(z,'CALL')))>0 THEN 'CALL_LINE' "
               "WHEN len(list_filter(raw_acts, lambda z: NOT (contains(z,'CHECK') OR contains(z,'FOLD') OR z='')))=0 THEN 'PASSIVE' ELSE 'MIXED' END")
V, P, A, FB, W = [f"coalesce(villain_{x},0.0)" for x in ("vpip", "pfr", "aggression", "fold_to_3bet", "wtsd")]
OPP = (f"CASE WHEN villain_vpip IS NULL THEN 'unknown' WHEN {V}>=0.45 AND {P}<=0.12 THEN 'calling station' WHEN {V}>=0.40 AND {P}>=0.25 AND {A}>=0.60 THEN 'maniaco' "
       f"WHEN {V}<=0.22 AND {P}>=0.18 AND {A}>=0.50 THEN 'reg agressivo' WHEN {V}<=0.20 AND {FB}>=0.60 THEN 'fit-or-fold' "
       f"WHEN {V}>=0.35 AND {P}<=0.10 AND {W}>=0.35 THEN 'passive' WHEN {V}<=0.18 AND {P}<=0.08 THEN 'overfolder' "
       f"WHEN stack_bb<=20 AND {A}>=0.50 THEN 'short stack pressionador' WHEN {V}>=0.28 AND {P}<=0.16 THEN 'recreativo' ELSE 'unknown' END")
CASCADE = ("((CASE WHEN (fl LIKE '%BET%' OR fl LIKE '%RAISE%') AND (tu LIKE '%CHECK%' OR tu LIKE '%FOLD%') THEN 0.45::DOUBLE ELSE 0::DOUBLE END) + "
           "(CASE WHEN (fl LIKE '%BET%' OR fl LIKE '%RAISE%') AND (ri LIKE '%CHECK%' OR ri LIKE '%FOLD%') THEN 0.35::DOUBLE ELSE 0::DOUBLE END) + "
           "(CASE WHEN won_cents<0 THEN 0.20::DOUBLE ELSE 0::DOUBLE END))")

RATES = """rates AS (SELECT coalesce(villain_id,'unknown') AS opponent_key, COUNT(*) AS samples,
 AVG(CASE WHEN regexp_matches(upper(hero_action_preflop),'RAISE|3BET|4BET|ALL-IN|BET') THEN 1.0::DOUBLE ELSE 0 END) AS aggression_rate,
 AVG(CASE WHEN regexp_matches(upper(hero_action_preflop),'CALL|FLAT') THEN 1.0::DOUBLE ELSE 0 END) AS call_rate,
 AVG(CASE WHEN contains(upper(hero_action_preflop),'FOLD') THEN 1.0::DOUBLE ELSE 0 END) AS fold_rate,
 AVG(CASE WHEN contains(upper(hero_action_flop),'BET') THEN 1.0::DOUBLE ELSE 0 END) AS cbet_rate FROM b_spots GROUP BY 1),
 clusters AS (SELECT *, CASE WHEN aggression_rate>=0.45 THEN 'Aggro' WHEN call_rate>=0.35 THEN 'Station' ELSE 'Passive' END AS opponent_cluster FROM rates)"""

PREP = f"""{RATES},
 p0 AS (SELECT *, hero_stack_start/GREATEST(big_blind,1) AS stack_bb, won_cents/GREATEST(big_blind,1) AS amount_bb, {seat('hero_position')} AS position, {phase('m_ratio')} AS phase,
  {texture('board_flop')} AS board_texture, {ACTS} AS acts, {RAW_ACTS} AS raw_acts, upper(hero_action_preflop) AS pf, upper(hero_action_flop) AS fl, upper(hero_action_turn) AS tu, upper(hero_action_river) AS ri FROM b_spots),
 p1 AS (SELECT *, {LINE} AS line_type, {LINE_STREET} AS line_street, {OPP} AS opponent_type, {CASCADE} AS cascade, {band('stack_bb')} AS stack_depth_bucket, {summary('stack_bb')} AS stack_bucket FROM p0),
 prep AS (SELECT p1.*, coalesce(c.opponent_cluster,'Passive') AS opponent_cluster FROM p1 LEFT JOIN clusters c ON c.opponent_key=coalesce(p1.villain_id, p1.opponent_type))"""

REP = "struct_pack(id:=id, sd:=went_to_showdown, cards:=hero_cards, opp:=opponent_type, line:=line_type, stack_bb:=stack_bb, amount:=won_cents, bb:=big_blind, phase:=phase, texture:=board_texture, ls:=line_street, hero:=hero_name)"
MODES = ("stack_depth_bucket", "opponent_type", "opponent_cluster", "board_texture", "line_type")


def groups(name: str, keys: str, src: str, more: str = "") -> str:
    """One aggregate per key set plus smallest-on-ties modes."""
    r = lambda c: f"AVG(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END)"
    jam = "line_type IN ('JAM','3BET_POT')"
    modes = [m for m in MODES if m not in keys.split(", ")]
    hist = ", ".join(f"histogram({m}) AS h_{m}" for m in modes)
    pick = ", ".join(
        f"list_min(list_transform(list_filter(map_entries(h_{m}), lambda e: e.value=list_max(map_values(h_{m}))), lambda e: e.key)) AS m_{m}" for m in modes
    )
    return f"""{name}_0 AS (SELECT {keys}, COUNT(*) AS n, AVG(hero_vpip) AS vpip, AVG(hero_pfr) AS pfr, {r("pf LIKE '%CALL%' OR pf LIKE '%FLAT%'")} AS call_rate,
 {r("pf LIKE '%FOLD%'")} AS fold_rate, {r("regexp_matches(pf,'RAISE|3BET|4BET|ALL-IN')")} AS raise_rate, {r("fl LIKE '%BET%'")} AS cbet_rate,
 {r("regexp_matches(ri,'BET|RAISE') AND amount_bb<0")} AS river_bluff_rate,
 coalesce(COUNT(*) FILTER (WHERE line_type='3BET_POT' AND pf LIKE '%FOLD%')::DOUBLE/NULLIF(COUNT(*) FILTER (WHERE line_type='3BET_POT'),0),0.0) AS fold_to_3bet_rate,
 {r("pf LIKE '%3BET%'")} AS three_bet_rate, {r("pf LIKE '%4BET%'")} AS four_bet_rate, AVG(cascade) AS cascade_rate, SUM(amount_bb) AS ev_real, {r("amount_bb>0")} AS win_rate,
 AVG(went_to_showdown) AS showdown_rate, {r("regexp_matches(ri,'BET|RAISE')")} AS river_agg_rate, COUNT(*) FILTER (WHERE {jam}) AS jam_n,
 coalesce(COUNT(*) FILTER (WHERE {jam} AND pf LIKE '%CALL%')::DOUBLE/NULLIF(COUNT(*) FILTER (WHERE {jam}),0),0.0) AS jam_call_rate,
 SUM(amount_bb) FILTER (WHERE {jam}) AS jam_ev_real, coalesce(COUNT(*) FILTER (WHERE {jam} AND went_to_showdown>0)::DOUBLE/NULLIF(COUNT(*) FILTER (WHERE {jam}),0),0.0) AS jam_showdown_rate,
 quantile_cont(stack_bb, 0.5) AS stack_median, first({REP} ORDER BY amount_bb, id) AS rep, first({REP} ORDER BY amount_bb, id) FILTER (WHERE {jam}) AS jam_rep, {hist} {more}
 FROM {src} GROUP BY {keys}),
 {name} AS (SELECT *, GREATEST(0.0::DOUBLE,-ev_real) AS total_ev_lost, GREATEST(0.0::DOUBLE,-ev_real)/n AS avg_loss, {pick} FROM {name}_0)"""


def limit(i: int) -> str:
    return case("stack_bucket", {k: v[i] for k, v in fv.DETECTOR_LIMITS.items()}, fv.DETECTOR_LIMITS["MID"][i])


ADJ = f"({case('position', fv.SEAT_FACTOR, 1.0)} * {case('phase', fv.PHASE_FACTOR, 1.0)})"
BF = ("(CASE WHEN phase NOT IN ('BUBBLE','ITM','FINAL_TABLE') OR stack_median<=0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + (CASE WHEN stack_median<10 THEN 0.18::DOUBLE WHEN stack_median<15 THEN 0.25 "
      "WHEN stack_median<25 THEN 0.34 WHEN stack_median<35 THEN 0.24 ELSE 0.18 END) + (CASE WHEN phase='FINAL_TABLE' THEN 0.08::DOUBLE ELSE 0 END) END)")


def rule(src: str, cond: str, code: str, metric: str, bench: str, base: float, min_n: int, ev_n: int, extra: str = "", depth: str = "m_stack_depth_bucket",
         cluster: str = "'Passive'", tex: str = "m_board_texture", line: str = "m_line_type", jam: bool = False, bf: str = "NULL::DOUBLE") -> str:
    j = "jam_" if jam else ""
    n = "jam_n" if jam else "n"
    return f"""SELECT {extra}position, phase, '{code}' AS leak_code, ({metric})::DOUBLE AS metric, ({bench})::DOUBLE AS benchmark, {base}::DOUBLE AS base, {n} AS sample_size,
 {j}ev_real AS ev_real, {j}showdown_rate AS showdown_rate, {j}rep AS rep, {depth} AS stack_depth_bucket, stack_bucket, m_opponent_type AS opponent_type, {cluster} AS opponent_cluster,
 {tex} AS board_texture, {line} AS line_type, {bf} AS bubble_factor, {ev_n} AS ev_n FROM {src} WHERE ({cond}) AND {n}>={min_n}"""


def group_rules(g3: str, g4: str, g5: str, extra: str = "") -> list[str]:
    cl = "m_opponent_cluster"
    late = "phase IN ('BUBBLE','ITM','FINAL_TABLE') AND n>=15"
    vmax, vmin = f"({limit(1)}*{ADJ})", f"({limit(0)}*LEAST(1.0::DOUBLE,{ADJ}+0.05::DOUBLE))"
    pmin, pmax = f"({limit(2)}*{ADJ})", f"({limit(3)}*({ADJ}+0.05::DOUBLE))"
    out = [
        rule(g3, f"vpip>{vmax}", "VPIP_LOOSE", "vpip", vmax, 0.70, 15, 2, extra, cluster=cl),
        rule(g3, f"vpip<{vmin}", "VPIP_TIGHT", "vpip", vmin, 0.55, 15, 2, extra, cluster=cl),
        rule(g3, f"pfr<{pmin}", "PFR_LOW", "pfr", pmin, 0.65, 15, 2, extra, cluster=cl),
        rule(g3, f"pfr>{pmax}", "C_BET_STRONG", "pfr", pmax, 0.55, 15, 2, extra, cluster=cl),
        rule(g3, f"position IN ('CO','BTN','SB','BB') AND fold_rate>{limit(5)}", "FOLD_EXCESSIVE", "fold_rate", limit(5), 0.60, 15, 3, extra),
        rule(g3, f"position IN ('UTG','LJ','HJ','CO','BTN') AND call_rate>{limit(4)}", "CALL_EXCESSIVE", "call_rate", limit(4), 0.55, 15, 3, extra),
        rule(g3, "three_bet_rate>=0.08", "THREE_BET_WRONG", "three_bet_rate", "0.05", 0.50, 15, 1, extra),
        rule(g3, "fold_to_3bet_rate>0.55", "FOLD_VS_3BET_HIGH", "fold_to_3bet_rate", "0.55", 0.62, 15, 3, extra, depth="stack_bucket", cluster=cl, line="'3BET_POT'"),
        rule(g3, "four_bet_rate>=0.03", "FOUR_BET_WRONG", "four_bet_rate", "0.02", 0.55, 15, 1, extra, depth="stack_bucket"),
        rule(g3, f"{late} AND fold_rate>0.70 AND {BF}<=1.40 AND position IN ('SB','BB','BTN','CO')", "ICM_PASSIVITY", "fold_rate", "0.55", 0.78, 15, 3, extra, cluster=cl, bf=f"ROUND({BF},3)"),
        rule(g3, f"{late} AND jam_n>0 AND jam_call_rate>0.24 AND {BF}>=1.25", "ICM_SUICIDE", "jam_call_rate", "0.20", 0.84, 15, 3, extra, cluster=cl, jam=True, bf=f"ROUND({BF},3)"),
        rule(g3, f"{late} AND {BF}>=1.30 AND raise_rate<0.14 AND position IN ('CO','BTN','SB')", "ICM_PASSIVITY", "raise_rate", "0.18", 0.76, 15, 3, extra, cluster=cl, bf=f"ROUND({BF},3)"),
    ]
    tx = {"cluster": cl, "tex": "board_texture"}
    out += [
        rule(g4, "cbet_rate<0.18 AND position IN ('BTN','CO','HJ') AND phase<>'FINAL_TABLE'", "C_BET_WEAK", "cbet_rate", "0.25", 0.50, 20, 1, extra, **tx),
        rule(g4, "cbet_rate>0.70 AND stack_bucket IN ('LOW','MID')", "C_BET_STRONG", "cbet_rate", "0.65", 0.45, 20, 1, extra, **tx),
        rule(g4, "river_bluff_rate>0.22 AND win_rate<0.45", "BLUFF_BAD", "river_bluff_rate", "0.15", 0.75, 20, 2, extra, **tx),
        rule(g4, "avg_loss>0 AND vpip>0.30 AND pfr<0.18", "OVERPLAY_MEDIUM", "avg_loss", "0.0", 0.70, 20, 3, extra, **tx),
        rule(g4, "cascade_rate>0.45", "BLUFF_BAD", "cascade_rate", "0.30", 0.66, 20, 2, extra, **tx),
        rule(g4, "showdown_rate>0.25 AND win_rate<0.52 AND cbet_rate<0.45", "VALUE_BET_LOST", "showdown_rate", "0.25", 0.60, 20, 2, extra, **tx),
    ]
    if g5:
        out += [
            rule(g5, "line_type IN ('3BET_POT','JAM','AGGRESSIVE_POSTFLOP') AND t_med<GREATEST(1200.0::DOUBLE,t_q1)", "TIMING_IMPULSIVE", "t_med", "GREATEST(1800.0::DOUBLE,t_q3)", 0.58, 15, 2, extra, cluster=cl, line="line_type"),
            rule(g5, "line_type IN ('AGGRESSIVE_POSTFLOP','MIXED') AND river_agg_rate>0.25 AND t_med>GREATEST(8000.0::DOUBLE,t_q3*1.5::DOUBLE)", "TIMING_TELEGRAPH", "t_med", "GREATEST(3500.0::DOUBLE,t_q3)", 0.50, 15, 2, extra, cluster=cl, line="line_type"),
        ]
    return out


RANGE_BASE = "CASE " + " ".join(f"WHEN rep.opp='{o}' AND rep.line='{ln}' THEN {v}::DOUBLE" for (o, ln), v in fv.RANGE_EV.items()) + " ELSE 0.0::DOUBLE END"


def scored(src: str, dst: str) -> str:
    return f"""{dst}_0 AS (SELECT *, ABS(metric-benchmark)/(CASE WHEN benchmark=0 THEN 1.0::DOUBLE ELSE benchmark END)*100.0 AS deviation_pct FROM {src}),
 {dst}_1 AS (SELECT *, LEAST(1.0::DOUBLE, 0.15::DOUBLE + sample_size/(sample_size+40.0::DOUBLE) + LEAST(0.25::DOUBLE, deviation_pct/200.0)) AS c1 FROM {dst}_0),
 {dst}_2 AS (SELECT *, CASE WHEN showdown_rate<0.35 THEN LEAST(1.0::DOUBLE, c1 + LEAST(0.20::DOUBLE, deviation_pct/150.0)) ELSE c1 END AS confidence,
  CASE WHEN rep.sd=0 THEN {RANGE_BASE} + {case(summary('rep.stack_bb'), fv.RANGE_EV_STACK, 0.0)} END AS ev_expected, rep.amount/GREATEST(rep.bb,1) AS real_ev FROM {dst}_1),
 {dst} AS (SELECT *, rep.id AS hand_id, rep.hero AS hero_name, GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, base*(0.75::DOUBLE+confidence/2.0))) AS error_severity, ev_expected-real_ev AS ev_delta,
  CASE WHEN rep.sd=0 THEN 'range bridge: opp=' || rep.opp || ', line=' || rep.line || ', stack=' || {summary('rep.stack_bb')} ELSE 'Contexto insuficiente para EV esperado' END AS confidence_reason,
  ev_n + 2 + (CASE WHEN showdown_rate<0.35 THEN 1 ELSE 0 END) AS evidence_n FROM {dst}_2)"""


G5 = groups("g5", "stack_bucket, position, phase, line_type", "(SELECT * FROM prep WHERE decision_time_ms>0)",
            ", quantile_cont(decision_time_ms::DOUBLE,0.25) AS t_q1, quantile_cont(decision_time_ms::DOUBLE,0.5) AS t_med, quantile_cont(decision_time_ms::DOUBLE,0.75) AS t_q3")
G3 = groups("g3", "stack_bucket, position, phase", "prep")
POST = "(SELECT * FROM prep WHERE fl<>'' OR tu<>'' OR ri<>'')"
G4 = groups("g4", "stack_bucket, position, phase, board_texture", POST)
SIZING = f"""sz AS (SELECT AVG(CASE WHEN bet_size > (SELECT quantile_cont(bet_size::DOUBLE,0.9) FROM prep) THEN 1.0::DOUBLE ELSE 0 END) AS ratio, COUNT(bet_size) AS n, SUM(amount_bb) FILTER (WHERE bet_size IS NOT NULL) AS ev_real,
 AVG(went_to_showdown) FILTER (WHERE bet_size IS NOT NULL) AS showdown_rate, first({REP} ORDER BY amount_bb, id) FILTER (WHERE bet_size IS NOT NULL) AS rep,
 'UNKNOWN' AS m_stack_depth_bucket, 'UNKNOWN' AS stack_bucket, 'unknown' AS m_opponent_type, 'UNKNOWN' AS m_board_texture, 'UNKNOWN' AS m_line_type, 'UNKNOWN' AS position, 'UNKNOWN' AS phase FROM prep)"""
ALL_RULES = group_rules("g3", "g4", "g5") + [rule("sz", "ratio>0.10", "OVERBETTING", "ratio", "0.05", 0.45, 15, 1)]
POS = """ps AS (SELECT hero_id, id, date_utc, won_cents/GREATEST(big_blind,1) AS amt, hero_vpip AS vpip, {q}, ROW_NUMBER() OVER (PARTITION BY {k} ORDER BY date_utc, id) AS pos, COUNT(*) OVER (PARTITION BY {k}) AS n,
  SUM(CASE WHEN won_cents<0 THEN 0 ELSE 1 END) OVER (PARTITION BY {k} ORDER BY date_utc, id ROWS UNBOUNDED PRECEDING) AS wins FROM {src}),
 stk AS (SELECT k, n, MIN(pos) AS start_pos, MAX(pos) AS end_pos, COUNT(*) AS streak_len, arg_min(id,pos) AS first_id FROM ps WHERE amt<0 GROUP BY k, n, wins HAVING COUNT(*)>=3)"""
TILT = """, aft AS (SELECT s.*, (SELECT AVG(vpip) FROM ps p WHERE p.k=s.k AND p.pos BETWEEN s.end_pos+1 AND s.end_pos+6) AS nv, (SELECT AVG(amt) FROM ps p WHERE p.k=s.k AND p.pos BETWEEN s.end_pos+1 AND s.end_pos+6) AS na FROM stk s WHERE n>=30),
 bas AS (SELECT k, AVG(vpip) AS bv, AVG(amt) AS ba FROM ps WHERE pos<=GREATEST(20,LEAST(80,n//2)) GROUP BY 1), tot AS (SELECT k, SUM(amt) AS ev_real FROM ps GROUP BY 1),
 sc AS (SELECT aft.*, nv-bv AS dv, ba-na AS de, GREATEST(0,nv-bv)*100.0::DOUBLE+GREATEST(0,ba-na)*15.0::DOUBLE+streak_len*6.0::DOUBLE AS score FROM aft JOIN bas USING (k)),
 tl AS (SELECT k, COUNT(*) AS streaks, MAX(streak_len) AS max_streak, coalesce(AVG(dv),0) AS vd, coalesce(AVG(de),0) AS ed, MAX(n) AS sample_size, MAX(score) FILTER (WHERE nv IS NOT NULL) AS ws, first(first_id ORDER BY score DESC, start_pos) FILTER (WHERE nv IS NOT NULL) AS hand_id FROM sc GROUP BY 1)"""
TILT_ROW = f"""tilt_row AS (SELECT position, phase, 'TILT_PATTERN' AS leak_code, sample_size, ev_real, rep, 'UNKNOWN' AS stack_depth_bucket, 'UNKNOWN' AS stack_bucket, opponent_type, 'Passive' AS opponent_cluster, board_texture, line_type,
 LEAST(100.0::DOUBLE, GREATEST(0.0::DOUBLE,vd)*100.0) AS deviation_pct, LEAST(0.95::DOUBLE,0.45::DOUBLE+streaks/20.0+LEAST(0.25::DOUBLE,vd)) AS confidence,
 LEAST(1.0::DOUBLE,0.55::DOUBLE+LEAST(0.25::DOUBLE,max_streak/10.0)+LEAST(0.2::DOUBLE,GREATEST(0.0::DOUBLE,vd))) AS error_severity, hand_id, hero_name, 'loss_streak + vpip_shift' AS confidence_reason, 4 AS evidence_n
 FROM tl JOIN tot USING (k) JOIN (SELECT id AS rid, {REP} AS rep, position, phase, opponent_type, board_texture, line_type, hero_name FROM prep) r ON r.rid = tl.hand_id WHERE ws>0 AND NOT (vd<0.08 AND max_streak<4))"""
SCORED = f"{PREP},\n{G3},\n{G4},\n{G5},\n{SIZING},\nraw AS ({' UNION ALL '.join(ALL_RULES)}),\n{scored('raw', 'det_s')}"
DETECT = f"{SCORED},\n{POS.format(k='1', q='1 AS k', src='b_spots')}{TILT},\n{TILT_ROW},\ndet AS (SELECT * FROM det_s UNION ALL BY NAME SELECT * FROM tilt_row)"

CATEGORY = case("leak_code", {k: v[0] for k, v in fv.LEAK_CODES.items()}, "NONE")
CTX_KEYS = "leak_code, hero_name, network, position, stack_bucket, stack_depth_bucket, opponent_type, opponent_cluster, phase, board_texture, street, line_type"


def _wm(x: str) -> str:
    return f"SUM(CASE WHEN {x} IS NOT NULL AND w>0 THEN {x}*w END)/NULLIF(SUM(CASE WHEN {x} IS NOT NULL AND w>0 THEN w END),0)"


CTX = f"""cx AS (SELECT leak_code, hero_name, CASE upper(hero_name) WHEN 'ALPHA' THEN 'NET_A' WHEN 'BETA' THEN 'NET_B' ELSE 'UNKNOWN' END AS network, position,
  CASE WHEN stack_bucket='UNKNOWN' THEN {band('rep.stack_bb')} ELSE upper(stack_bucket) END AS stack_bucket,
  CASE WHEN stack_depth_bucket='UNKNOWN' THEN {summary('rep.stack_bb')} ELSE upper(stack_depth_bucket) END AS stack_depth_bucket,
  CASE WHEN phase='UNKNOWN' AND opponent_type='unknown' THEN rep.opp ELSE opponent_type END AS opponent_type, opponent_cluster,
  CASE WHEN phase='UNKNOWN' THEN rep.phase ELSE phase END AS phase, CASE WHEN phase='UNKNOWN' AND board_texture='NO_BOARD' THEN rep.texture ELSE board_texture END AS board_texture,
  CASE WHEN {CATEGORY}='PREFLOP' THEN 'PREFLOP' ELSE 'POSTFLOP' END AS street, CASE WHEN phase='UNKNOWN' AND line_type='UNKNOWN' THEN rep.ls ELSE line_type END AS line_type,
  sample_size::DOUBLE AS w, confidence, ev_real, ev_expected, ev_delta, deviation_pct/100.0 AS vop, confidence_reason FROM det),
 ctx AS (SELECT {CTX_KEYS}, CAST(ROUND(SUM(w)) AS BIGINT) AS frequency, CAST(ROUND(SUM(w)) AS BIGINT) AS sample_size, SUM(confidence*w)/SUM(w) AS confidence, SUM(ev_real) AS total_ev_lost,
  SUM(ev_real)/SUM(w) AS avg_loss_per_hand, {_wm('ev_expected')} AS ev_expected, {_wm('ev_real')} AS ev_real, {_wm('ev_delta')} AS ev_delta, {_wm('vop')} AS vop_deviation, 0.0::DOUBLE AS cascade_rate,
  array_to_string(list_sort(list_distinct(list(confidence_reason))), '; ') AS confidence_reason FROM cx GROUP BY {CTX_KEYS})"""

CL = lambda x, lo, hi: f"GREATEST({lo}::DOUBLE, LEAST({hi}::DOUBLE, {x}))"
EASY = ", ".join(f"'{x}'" for x in fv.EASY_CODES)
SEV = f"""s0 AS (SELECT *, GREATEST(quantile_cont(total_ev_lost, 0.9) OVER (), 1.0::DOUBLE) AS impact_scale, GREATEST(0.0::DOUBLE, quantile_cont(avg_loss_per_hand, 0.5) OVER (PARTITION BY leak_code)) AS baseline_loss FROM ctx),
 s1 AS (SELECT *, sample_size/(sample_size+70.0::DOUBLE)*GREATEST(0.0::DOUBLE,avg_loss_per_hand) + 70.0::DOUBLE/(sample_size+70.0::DOUBLE)*baseline_loss AS bayes,
  {CL('vop_deviation',0,2)} AS vop, ({case('stack_depth_bucket', fv.STACK_WEIGHT, 1.0)} * {case('position', fv.SEVERITY_SEAT, 1.0)} * {case('phase', fv.SEVERITY_PHASE, 1.0)}) *
  (CASE WHEN phase='FINAL_TABLE' OR stack_depth_bucket IN ('20-25BB','15-20BB') THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) AS mult, {case('leak_code', fv.REPAIR_DIFFICULTY, 0.60)} AS difficulty FROM s0),
 s2 AS (SELECT *, CASE WHEN leak_code IN ({EASY}) THEN {CL('(1.0::DOUBLE-difficulty)*1.2::DOUBLE',0,1)} ELSE 1.0::DOUBLE-difficulty END AS ease,
  len(list_distinct([position, stack_bucket, stack_depth_bucket, opponent_type, phase, board_texture, line_type])) AS distinct_context_values FROM s1),
 s3 AS (SELECT *, {CL('ln(1+frequency)/ln(61.0::DOUBLE)*100',0,100)} AS frequency_score, {CL('bayes/impact_scale*100',0,100)} AS impact_score, {CL('(mult-0.8::DOUBLE)*100',0,100)} AS context_importance,
  {CL('(distinct_context_values/7.0::DOUBLE*100)*(1.0::DOUBLE+LEAST(0.30::DOUBLE,vop/2.0))',0,100)} AS recurrence_score,
  {CL(f"GREATEST(CASE WHEN ev_expected IS NOT NULL THEN {CL('ABS(coalesce(ev_delta,0))/GREATEST(GREATEST(0.0::DOUBLE,total_ev_lost),1.0::DOUBLE)',0,1)} ELSE {CL('ABS(bayes)/impact_scale',0,1)} END, LEAST(1.0::DOUBLE,vop))",0,1)} AS distance_from_optimal,
  {CL('(mult-1.0::DOUBLE)*30 + ease*40',0,100)} AS cascade_score FROM s2),
 s4 AS (SELECT *, {CL('(frequency_score*0.16::DOUBLE + impact_score*0.28::DOUBLE + recurrence_score*0.16::DOUBLE + context_importance*0.16::DOUBLE + ease*100*0.12::DOUBLE + distance_from_optimal*100*0.08::DOUBLE + cascade_score*0.04::DOUBLE) * (0.55::DOUBLE+0.45::DOUBLE*LEAST(1.0::DOUBLE,sample_size/40.0)) * (0.60::DOUBLE+0.40::DOUBLE*confidence)',0,100)} AS raw FROM s3),
 s5 AS (SELECT *, CASE WHEN sample_size<12 OR confidence<0.45 THEN LEAST(raw,59.0::DOUBLE) ELSE raw END AS severity_score FROM s4),
 s6 AS (SELECT *, CASE WHEN severity_score>=80 THEN 'CRÍTICO' WHEN severity_score>=60 THEN 'ALTO' WHEN severity_score>=40 THEN 'MÉDIO' ELSE 'BAIXO' END AS l0 FROM s5),
 s7 AS (SELECT *, CASE WHEN sample_size<12 THEN 'BAIXO' WHEN sample_size<20 AND l0='CRÍTICO' THEN 'ALTO' ELSE l0 END AS severity_label FROM s6),
 sev AS (SELECT *, bayes*frequency*(CASE WHEN severity_label IN ('CRÍTICO','ALTO') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS potential_roi_gain, bayes*100 AS bayesian_bb100,
  ROW_NUMBER() OVER (ORDER BY severity_score DESC, confidence DESC, sample_size DESC, {CTX_KEYS}) AS priority_rank FROM s7)"""
HARD = ", ".join(f"'{x}'" for x in fv.COMPLEX_CODES)
PLAN = f"""pl AS (SELECT *, GREATEST(0.0::DOUBLE,bayes)*GREATEST(1.0::DOUBLE,sample_size)*(CASE WHEN leak_code IN ({EASY}) THEN 1.30::DOUBLE WHEN leak_code IN ({HARD}) THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END)*GREATEST(0.5::DOUBLE,confidence) AS evs_score,
  {CL(f"2.0::DOUBLE*{case('severity_label', fv.STUDY_HOURS, 1.0)}*(1.0::DOUBLE+LEAST(0.6::DOUBLE,sample_size/100.0))*(1.0::DOUBLE+GREATEST(0.0::DOUBLE,1.0::DOUBLE-confidence))",0.5,12)} AS h0
  FROM sev WHERE sample_size>=12 AND confidence>=0.45 AND severity_label IN ('CRÍTICO','ALTO','MÉDIO')),
 plan AS (SELECT *, ROUND(h0,1) AS estimated_hours, ROW_NUMBER() OVER (ORDER BY evs_score DESC, potential_roi_gain DESC, confidence DESC, priority_rank) AS priority FROM pl)"""
FULL = f"{DETECT},\n{CTX},\n{SEV},\n{PLAN}"
