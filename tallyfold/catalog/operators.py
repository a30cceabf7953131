"""Scalar, join, window, set, drift, profile, curve and vector queries with their SQL twins."""

from pyspark.sql import Window as W, functions as F

from tallyfold.catalog import leaks_sql as q
from tallyfold.catalog.leaks import prepared
from tallyfold.catalog.registry import query
from tallyfold.functions import cards, fixed_values as fv, numeric as num, play, vectors as vx
from tallyfold.operators import curves, dedupe, drift, quality, splits, streaks
from tallyfold.plans import entities, weekly
from tallyfold.session import written

# ---- filters ----


@query("p01_name_equality", "P1", uses="spots", sql="SELECT id FROM b_spots WHERE upper(coalesce(hero_name,''))=upper('alpha')")
def _(t):
    return t.spots.where(F.upper(F.coalesce("hero_name", F.lit(""))) == F.upper(F.lit("alpha"))).select("id")


@query("p02_network_filter", "P2", uses="hands", sql="SELECT 'WPN' AS network, COUNT(*) FILTER (WHERE upper(source_file) LIKE '%ACR%') AS n FROM b_hands UNION ALL SELECT 'PS', COUNT(*) FILTER (WHERE upper(source_file) LIKE '%POKERSTARS%') FROM b_hands UNION ALL SELECT 'other', COUNT(*) FROM b_hands")
def _(t):
    h = t.hands.agg(*[num.count_where(weekly.network_filter(n)).alias(n) for n in ("WPN", "PS", "other")])
    return h.select(F.explode(F.array(*[F.struct(F.lit(n).alias("network"), F.col(n).alias("n")) for n in ("WPN", "PS", "other")])).alias("r")).select("r.*")


@query("p05_time_slice", "P5 P7", uses="hands", sql="SELECT id FROM b_hands WHERE date_utc>=TIMESTAMP '2024-01-10 00:00:00' AND date_utc<TIMESTAMP '2024-01-12 00:00:00'")
def _(t):
    d = F.col("date_utc")
    return t.hands.where((d >= F.lit("2024-01-10").cast("timestamp_ntz")) & (d < F.lit("2024-01-12").cast("timestamp_ntz"))).select("id")


@query("p06_stack_filter", "P6", uses="hands", sql="SELECT 'LOW' AS bucket, COUNT(*) AS n FROM b_hands WHERE hero_stack_start<=20*big_blind UNION ALL SELECT 'MID', COUNT(*) FROM b_hands WHERE hero_stack_start>20*big_blind AND hero_stack_start<=50*big_blind UNION ALL SELECT 'HIGH', COUNT(*) FROM b_hands WHERE hero_stack_start>50*big_blind")
def _(t):
    s, b = F.col("hero_stack_start"), F.col("big_blind")
    return t.hands.groupBy(F.when(s <= 20 * b, "LOW").when(s <= 50 * b, "MID").otherwise("HIGH").alias("bucket")).agg(F.count("*").alias("n"))


@query("p09_band_filter", "P9 A22 M27", uses="hands", sql="SELECT COUNT(*) AS n, AVG(hero_pfr) AS pfr FROM b_hands WHERE hero_position='SB' AND big_blind>0 AND hero_stack_start::DOUBLE/big_blind BETWEEN 15 AND 25")
def _(t):
    depth = F.try_divide(F.col("hero_stack_start").cast("double"), F.nullif(F.col("big_blind"), F.lit(0)))
    return t.hands.where((F.col("hero_position") == "SB") & depth.between(15, 25)).agg(F.count("*").alias("n"), F.avg("hero_pfr").alias("pfr"))


@query("p08_set_membership", "P8", uses="spots", ctes=q.PREP, sql="SELECT id, line_type FROM prep WHERE phase IN ('BUBBLE','ITM','FINAL_TABLE') AND line_type IN ('JAM','3BET_POT')")
def _(t):
    return prepared(t).where(F.col("phase").isin(*fv.LATE_PHASES) & F.col("line_type").isin("JAM", "3BET_POT")).select("id", "line_type")


@query("p10_any_street", "P10", uses="hands", sql="SELECT id FROM b_hands WHERE hero_action_flop<>'' OR hero_action_turn<>'' OR hero_action_river<>''")
def _(t):
    return t.hands.where((F.col("hero_action_flop") != "") | (F.col("hero_action_turn") != "") | (F.col("hero_action_river") != "")).select("id")


@query("p15_coercion", "P15 P16 P17 P23", sql="""SELECT event_id, coalesce(TRY_CAST(CASE event_id%4 WHEN 0 THEN 'x' WHEN 1 THEN '' ELSE value::VARCHAR END AS DOUBLE),0.0) AS parsed, event_id%4>1 AS is_valid, coalesce(value/nullif(event_id%3,0),0.0) AS divided, LEAST(GREATEST(value,10.0::DOUBLE),50.0::DOUBLE) AS clamped FROM events""")
def _(t):
    raw = F.when(F.col("event_id") % 4 == 0, "x").when(F.col("event_id") % 4 == 1, "").otherwise(F.col("value").cast("string"))
    v = num.to_number(raw)
    return t.events.select("event_id", num.to_number(raw, 0.0).alias("parsed"), v.isNotNull().alias("is_valid"), num.safe_div("value", F.col("event_id") % 3).alias("divided"), num.clamp("value", 10, 50).alias("clamped"))


# ---- scalar text, money, time ----


@query("x05_text_normalisers", "X3 X4 X5 X10 X13 X20", uses="spots", sql=f"""SELECT id, {q.norm('hero_action_preflop')} AS norm, CASE WHEN a LIKE '%all-in%' OR a LIKE '%all in%' THEN 'allin' WHEN a LIKE '%raises%' OR a LIKE '%bets%' THEN 'raise' WHEN a LIKE '%calls%' THEN 'call' WHEN a LIKE '%checks%' THEN 'check' WHEN a LIKE '%folds%' THEN 'fold' ELSE '' END AS cls,
 CASE WHEN contains(u,'ALL') AND contains(u,'IN') THEN 'RAISE' WHEN starts_with(u,'FOLD') THEN 'FOLD' WHEN starts_with(u,'CALL') OR starts_with(u,'CHECK') THEN 'CALL' WHEN contains(u,'RAISE') OR contains(u,'BET') THEN 'RAISE' END AS training,
 CASE WHEN contains(u,'ALL') AND contains(u,'IN') THEN 'ALL-IN' WHEN starts_with(u,'FOLD') THEN 'FOLD' WHEN starts_with(u,'CALL') THEN 'CALL' WHEN contains(u,'RAISE') OR contains(u,'BET') THEN 'BET' ELSE 'FOLD' END AS contract,
 len(list_filter(string_split(replace(hero_action_preflop,'→',','),','), lambda x: trim(x)<>'')) AS tokens
 FROM (SELECT *, lower(hero_action_preflop) AS a, upper(trim(hero_action_preflop)) AS u FROM b_spots)""")
def _(t):
    x = "hero_action_preflop"
    return t.spots.select("id", play.normal_action(x).alias("norm"), play.action_class(x).alias("cls"), play.training_action(x).alias("training"), play.contract_action(x, F.lit("")).alias("contract"),
                          F.size(F.filter(F.split(F.replace(x, F.lit("→"), F.lit(",")), ","), lambda y: F.trim(y) != "")).alias("tokens"))


@query("x07_board_textures", "X7", uses="hands", ctes="bt AS (SELECT *, [board_flop[2],board_flop[5],board_flop[8]] AS su, [board_flop[1],board_flop[4],board_flop[7]] AS ra FROM b_hands), bi AS (SELECT *, list_sort(list_distinct(list_transform(ra, lambda r: instr('23456789TJQKA', r)))) AS ix FROM bt)", sql=f"""SELECT id, {q.texture('board_flop')} AS texture,
 CASE WHEN len(list_distinct(su))=1 THEN 'monotone' WHEN len(list_distinct(ra))<3 THEN 'paired' WHEN len(list_distinct(su))<3 THEN 'wet' WHEN len(ix)=3 AND ix[3]-ix[1]<=3 THEN 'wet' ELSE 'dry' END AS simple,
 CASE WHEN len(list_distinct(su))=1 THEN 4 WHEN len(list_distinct(ra))<3 THEN 3 WHEN len(list_distinct(su))=2 THEN 2 ELSE 1 END AS code FROM bi""")
def _(t):
    return t.hands.select("id", cards.board_texture("board_flop").alias("texture"), cards.board_texture_simple("board_flop").alias("simple"), cards.board_texture_code("board_flop").alias("code"))


@query("y01_timestamp_parsing", "Y1 Y2 Y4 Y7", sql="""SELECT event_id, CASE WHEN event_id%10=0 THEN NULL ELSE strftime(ts,'%Y-%m-%d %H:%M:%S') END AS parsed, strftime(ts,'%Y-%m-%d') AS day, CAST(DATE '2024-01-31'-CAST(ts AS DATE) AS INT) AS age_days, CAST(dayofweek(ts) AS INT)=0 AS is_sunday FROM events""")
def _(t):
    text = F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
    p = F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm:ss"))
    return t.events.select("event_id", F.date_format(p, "yyyy-MM-dd HH:mm:ss").alias("parsed"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
                           F.date_diff(F.lit("2024-01-31").cast("date"), F.to_date("ts")).alias("age_days"), (F.dayofweek("ts") == 1).alias("is_sunday"))


@query("m04_pressure_and_deviation", "M4 M8 M7 M6", uses="spots", ctes=q.PREP, sql=f"""SELECT id, CASE WHEN phase NOT IN ('BUBBLE','ITM','FINAL_TABLE') OR stack_bb<=0 THEN 1.0::DOUBLE ELSE ROUND(1.0::DOUBLE+(CASE WHEN stack_bb<10 THEN 0.18::DOUBLE WHEN stack_bb<15 THEN 0.25 WHEN stack_bb<25 THEN 0.34 WHEN stack_bb<35 THEN 0.24 ELSE 0.18 END)+(CASE WHEN phase='FINAL_TABLE' THEN 0.08::DOUBLE ELSE 0 END),6) END AS bubble,
 ROUND(ABS(villain_vpip-0.25::DOUBLE)/0.25::DOUBLE,6) AS vop, CASE WHEN went_to_showdown=0 THEN 'range_bridge' ELSE 'insufficient_context' END AS source,
 CASE WHEN went_to_showdown=0 THEN ROUND(({q.RANGE_BASE.replace('rep.opp', 'opponent_type').replace('rep.line', 'line_type')})+{q.case(q.summary('stack_bb'), fv.RANGE_EV_STACK, 0.0)},6) END AS expected_ev FROM prep WHERE villain_vpip IS NOT NULL""")
def _(t):
    p = prepared(t, keep=["villain_vpip"]).where("villain_vpip IS NOT NULL")
    e = play.expected_value("showdown", "hero_cards", "opponent_type", "line_type", "stack_bb", "amount", "big_blind")
    return p.select("id", F.round(play.bubble_factor("stack_bb", "phase"), 6).alias("bubble"), F.round(play.participation_deviation("villain_vpip", F.lit(0.25)), 6).alias("vop"), e["source"].alias("source"), F.round(e["expected_ev"], 6).alias("expected_ev"))


@query("c04_json_fields", "C4", sql="SELECT event_id, CAST(props->>'$.k' AS INT) AS k, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS doc FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("doc"))


@query("c05_best_class", "C5 F12", sql="""SELECT event_id, CASE WHEN m<0.55 THEN 'WARNING' WHEN a>=b THEN 'CALL' ELSE 'FOLD' END AS action, m<0.55 AS abstained FROM (SELECT *, GREATEST(a,b) AS m FROM (SELECT event_id, ((event_id*37)%99+1)/100.0::DOUBLE AS a, 1.0::DOUBLE-((event_id*37)%99+1)/100.0::DOUBLE AS b FROM events))""")
def _(t):
    a = ((F.col("event_id") * 37) % 99 + 1) / 100.0
    d = t.events.select("event_id", a.alias("a")).withColumn("b", 1.0 - F.col("a"))
    g = vx.best_class(F.create_map(F.lit("CALL"), F.col("a"), F.lit("FOLD"), F.col("b")))
    return d.select("event_id", g["action"].alias("action"), g["abstained"].alias("abstained"))


# ---- joins, dedupe, sets ----


@query("j02_left_join_newest", "J2 S2 T1", uses="hands sessions", sql="SELECT h.id, s.source_file FROM b_hands h LEFT JOIN b_sessions s USING (session_id) ORDER BY h.date_utc DESC, h.id DESC LIMIT 5000")
def _(t):
    top = t.hands.orderBy(F.col("date_utc").desc(), F.col("id").desc()).limit(5000)
    return top.select("id", "session_id").join(t.sessions.select("session_id", "source_file"), "session_id", "left").select("id", "source_file")


@query("j05_newest_sessions_play", "J5", uses="hands sessions", sql="SELECT id FROM b_hands WHERE session_id IN (SELECT session_id FROM b_sessions ORDER BY ingested_at DESC, session_id DESC LIMIT 100)")
def _(t):
    newest = t.sessions.orderBy(F.col("ingested_at").desc(), F.col("session_id").desc()).limit(100)
    return t.hands.join(newest, "session_id", "left_semi").select("id")


@query("j10_key_resolution", "J10", uses="hands", sql="SELECT h.id, l.l_orderkey AS ref FROM (SELECT DISTINCT l_orderkey FROM lineitem) l JOIN b_hands h ON h.hand_id='H' || l.l_orderkey")
def _(t):
    keys = t.lineitem.select("l_orderkey").distinct().select(F.col("l_orderkey").alias("ref"), F.concat(F.lit("H"), "l_orderkey").alias("hand_id"))
    return keys.join(t.hands.select("id", "hand_id"), "hand_id").select("id", "ref")


@query("j16_not_yet_ingested", "J16 K5", sql="SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("w01_keep_latest", "W1", sql="""SELECT hand_id, site_name, id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY hand_id, site_name ORDER BY date_utc DESC NULLS FIRST, id DESC) AS rn FROM (SELECT l_orderkey::VARCHAR AS hand_id,
 CASE WHEN l_linenumber%3=0 THEN 'UNKNOWN' ELSE upper(l_returnflag) END AS site_name, CASE WHEN l_partkey%9<>0 THEN l_shipdate END AS date_utc, l_partkey*100000+l_suppkey*100+CAST(l_quantity AS BIGINT) AS id FROM lineitem)) WHERE rn=1""")
def _(t):
    f = F.col
    d = t.lineitem.select(f("l_orderkey").cast("string").alias("hand_id"), F.when(f("l_linenumber") % 3 != 0, F.lower("l_returnflag")).alias("site_name"),
                          F.when(f("l_partkey") % 9 != 0, f("l_shipdate")).alias("date_utc"), (f("l_partkey") * 100000 + f("l_suppkey") * 100 + f("l_quantity").cast("long")).alias("id"))
    return dedupe.keep_latest_per_site(d).select("hand_id", "site_name", "id")


@query("w02_keep_first", "W2", sql="SELECT l_orderkey, strftime(MIN(l_shipdate),'%Y-%m-%d') AS first_ship FROM lineitem GROUP BY 1")
def _(t):
    d = dedupe.keep_first(t.lineitem.select("l_orderkey", "l_shipdate"), ["l_orderkey"], [F.col("l_shipdate").asc()])
    return d.select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("first_ship"))


@query("t08_nulls_last", "T8", uses="spots", sql="SELECT id, bet_size FROM b_spots ORDER BY CASE WHEN bet_size=0 THEN NULL ELSE bet_size END NULLS LAST, id LIMIT 50")
def _(t):
    return t.spots.orderBy(F.nullif(F.col("bet_size"), F.lit(0)).asc_nulls_last(), "id").limit(50).select("id", "bet_size")


@query("t09_most_common", "T9", sql="SELECT p_brand, COUNT(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    return dedupe.most_common(t.part, F.col("p_brand"), "p_brand", 5)


@query("u02_key_union", "U1 U2 U7", sql="SELECT key, COUNT(*) AS n, MAX(balance) AS balance FROM (SELECT 's' || s_nationkey AS key, s_acctbal AS balance FROM supplier UNION ALL SELECT 'c' || c_nationkey, NULL FROM customer) GROUP BY 1")
def _(t):
    a = t.supplier.select(F.concat(F.lit("s"), "s_nationkey").alias("key"), F.col("s_acctbal").alias("balance"))
    b = t.customer.select(F.concat(F.lit("c"), "c_nationkey").alias("key"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("key").agg(F.count("*").alias("n"), F.max("balance").alias("balance"))


@query("u04_missing_features", "U4", sql="SELECT doc_id AS missing FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t):
    """Wanted keys less the ones that are there, as sets."""
    return t.documents.select(F.col("doc_id").alias("missing")).subtract(t.labels.select(F.col("doc_id").alias("missing")))


# ---- windows ----

POS, TILT = q.POS, q.TILT
TILT_OUT = """streaks, max_streak, ROUND(vd,6) AS vpip_delta, ROUND(ed,3) AS ev_delta, sample_size, hand_id, ROUND(LEAST(0.95::DOUBLE,0.45::DOUBLE+streaks/20.0+LEAST(0.25::DOUBLE,vd)),6) AS confidence,
 ROUND(LEAST(1.0::DOUBLE,0.55::DOUBLE+LEAST(0.25::DOUBLE,max_streak/10.0)+LEAST(0.2::DOUBLE,GREATEST(0,vd))),6) AS error_severity, ROUND(ev_real,4) AS ev_real FROM tl JOIN tot USING (k) WHERE ws>0 AND NOT (vd<0.08 AND max_streak<4)"""


def timed(t):
    return t.hands.select("hero_id", "id", "date_utc", play.in_bb("won_cents", "big_blind").alias("amount_bb"), F.col("hero_vpip").cast("double").alias("vpip"))


def tilt_cols(d, *keys):
    return d.select(*keys, "streaks", "max_streak", F.round("vpip_delta", 6).alias("vpip_delta"), F.round("ev_delta", 3).alias("ev_delta"), "sample_size", "hand_id", F.round("confidence", 6).alias("confidence"),
                    F.round("error_severity", 6).alias("error_severity"), F.round("ev_real", 4).alias("ev_real"))


@query("w08_loss_streaks", "W8", uses="hands", ctes=POS.format(k="hero_id", q="hero_id AS k", src="b_hands"), sql="SELECT k AS hero_id, start_pos, end_pos, streak_len, first_id FROM stk")
def _(t):
    pos = streaks.positioned(timed(t), ["hero_id"], F.col("amount_bb") < 0)
    return streaks.loss_streaks(pos, ["hero_id"]).select("hero_id", "start_pos", "end_pos", "streak_len", "first_id")


@query("w09_baselines", "W9", uses="hands", ctes=POS.format(k="hero_id", q="hero_id AS k", src="b_hands"), sql="SELECT k AS hero_id, ROUND(AVG(vpip),9) AS base_vpip, ROUND(AVG(amt),6) AS base_amount_bb FROM ps WHERE pos<=GREATEST(20,LEAST(80,n//2)) GROUP BY 1")
def _(t):
    pos = streaks.positioned(timed(t), ["hero_id"], F.col("amount_bb") < 0)
    b = streaks.baseline(pos, ["hero_id"], ["vpip", "amount_bb"])
    return b.select("hero_id", F.round("base_vpip", 9).alias("base_vpip"), F.round("base_amount_bb", 6).alias("base_amount_bb"))


@query("w10_after_streaks", "W10", uses="hands", ctes=POS.format(k="hero_id", q="hero_id AS k", src="b_hands") + TILT, sql="SELECT k AS hero_id, end_pos, ROUND(nv,9) AS next_vpip, ROUND(na,6) AS next_amount_bb FROM aft")
def _(t):
    pos = streaks.positioned(timed(t), ["hero_id"], F.col("amount_bb") < 0)
    a = streaks.after_streaks(pos, streaks.loss_streaks(pos, ["hero_id"]).where("n >= 30"), ["hero_id"], ["vpip", "amount_bb"])
    return a.select("hero_id", "end_pos", F.round("next_vpip", 9).alias("next_vpip"), F.round("next_amount_bb", 6).alias("next_amount_bb"))


@query("l08_tilt_per_player", "L8", uses="hands", ctes=POS.format(k="hero_id", q="hero_id AS k", src="b_hands") + TILT, sql=f"SELECT k AS hero_id, {TILT_OUT}")
def _(t):
    return tilt_cols(streaks.tilt(timed(t), ["hero_id"]), "hero_id")


@query("l08_tilt_overall", "L8", uses="hands", ctes=POS.format(k="1", q="1 AS k", src="b_hands") + TILT, sql=f"SELECT {TILT_OUT}")
def _(t):
    return tilt_cols(streaks.tilt(timed(t)))


@query("w11_walk_forward", "W11", uses="hands", sql="""SELECT session_id, CASE WHEN place<=GREATEST(1,CAST(floor(n*0.6::DOUBLE) AS BIGINT)) THEN 'train' WHEN place<=GREATEST(GREATEST(1,CAST(floor(n*0.6::DOUBLE) AS BIGINT))+1,CAST(floor(n*0.8::DOUBLE) AS BIGINT)) THEN 'val' ELSE 'test' END AS split
 FROM (SELECT session_id, ROW_NUMBER() OVER (ORDER BY MIN(date_utc), session_id) AS place, COUNT(*) OVER () AS n FROM b_hands GROUP BY 1)""")
def _(t):
    return splits.session_splits(t.hands)


@query("a53_split_baseline", "A53 W11", uses="hands", ctes="""sp AS (SELECT session_id, CASE WHEN place<=floor(n*0.6::DOUBLE) THEN 'train' WHEN place<=floor(n*0.8::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (SELECT session_id, ROW_NUMBER() OVER (ORDER BY MIN(date_utc), session_id) AS place, COUNT(*) OVER () AS n FROM b_hands GROUP BY 1)),
 lb AS (SELECT split, CASE WHEN contains(hero_action_preflop,'all-in') THEN 'RAISE' WHEN hero_action_preflop LIKE 'folds%' THEN 'FOLD' WHEN hero_action_preflop LIKE 'c%' THEN 'CALL' ELSE 'RAISE' END AS label FROM b_hands JOIN sp USING (session_id))""", sql="""
SELECT m AS baseline_label, (SELECT COUNT(*) FILTER (WHERE label=m)::DOUBLE/COUNT(*) FROM lb WHERE split='test') AS baseline_accuracy FROM (SELECT label AS m FROM lb WHERE split='train' GROUP BY 1 ORDER BY COUNT(*) DESC LIMIT 1)""")
def _(t):
    h = splits.walk_forward(t.hands)
    return splits.split_baseline(h.select("split", play.training_action("hero_action_preflop").alias("label")).where("label IS NOT NULL"))


# ---- weekly drift ----

WEEKS = f"""wk AS (SELECT *, CASE WHEN hand_date>a-7 THEN '{weekly.CURRENT}' ELSE '{weekly.PREVIOUS}' END AS week_label, {q.seat('hero_position')} AS position FROM b_spots, (SELECT MAX(hand_date) AS a FROM b_spots) WHERE hand_date>a-14)"""
BB100 = "SUM(coalesce(won_cents::DOUBLE/NULLIF(big_blind,0),0))/COUNT(*)*100"


@query("y03_week_windows", "Y3", uses="spots", ctes=WEEKS, sql="SELECT week_label, strftime(MIN(hand_date),'%Y-%m-%d') AS first_day, strftime(MAX(hand_date),'%Y-%m-%d') AS last_day, COUNT(*) AS n FROM wk GROUP BY 1")
def _(t):
    return weekly.with_week(t.spots).groupBy("week_label").agg(F.date_format(F.min("hand_date"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("hand_date"), "yyyy-MM-dd").alias("last_day"), F.count("*").alias("n"))


@query("a21_weekly_kpis", "A21 A22", uses="spots", ctes=WEEKS, sql=f"SELECT week_label, COUNT(*) AS hands, ROUND({BB100},4) AS bb100, ROUND(coalesce(AVG(CASE WHEN position='SB' AND big_blind>0 AND hero_stack_start/big_blind BETWEEN 15 AND 25 THEN hero_pfr END),0),4) AS sb_pfr_15_25bb FROM wk GROUP BY 1")
def _(t):
    return weekly.kpis(weekly.with_week(t.spots))


@query("j07_position_delta", "J7 A21 U2", uses="spots", ctes=WEEKS + f", g AS (SELECT week_label, position, ROUND({BB100},4) AS v FROM wk WHERE NOT (position='CO' AND week_label='{weekly.CURRENT}') GROUP BY 1,2)", sql=f"""SELECT position, coalesce(MAX(v) FILTER (WHERE week_label='{weekly.CURRENT}'),0.0) AS current_bb100, coalesce(MAX(v) FILTER (WHERE week_label='{weekly.PREVIOUS}'),0.0) AS previous_bb100,
 ROUND(coalesce(MAX(v) FILTER (WHERE week_label='{weekly.CURRENT}'),0.0)-coalesce(MAX(v) FILTER (WHERE week_label='{weekly.PREVIOUS}'),0.0),4) AS delta_bb100 FROM g GROUP BY 1""")
def _(t):
    w = weekly.with_week(t.spots)
    return weekly.position_delta(w.where(~((F.col("hero_position") == "CO") & (F.col("week_label") == weekly.CURRENT))))


DAY_DET = "\n".join([
    f"{q.PREP}, pw AS (SELECT prep.*, CASE WHEN hand_date>a-7 THEN '{weekly.CURRENT}' ELSE '{weekly.PREVIOUS}' END AS week_label FROM prep, (SELECT MAX(hand_date) AS a FROM b_spots) WHERE hand_date>a-14),",
    q.groups("d3", "hand_date, stack_bucket, position, phase", "pw") + ",", q.groups("d4", "hand_date, stack_bucket, position, phase, board_texture", "(SELECT * FROM pw WHERE fl<>'' OR tu<>'' OR ri<>'')") + ",",
    q.groups("d5", "hand_date, stack_bucket, position, phase, line_type", "(SELECT * FROM pw WHERE decision_time_ms>0)", ", quantile_cont(decision_time_ms::DOUBLE,0.25) AS t_q1, quantile_cont(decision_time_ms::DOUBLE,0.5) AS t_med, quantile_cont(decision_time_ms::DOUBLE,0.75) AS t_q3") + ",",
    "dz0 AS (SELECT hand_date, quantile_cont(bet_size::DOUBLE,0.9) AS q90 FROM pw GROUP BY 1), dz AS (SELECT hand_date, AVG(CASE WHEN bet_size>q90 THEN 1.0::DOUBLE ELSE 0 END) AS ratio, COUNT(bet_size) AS n FROM pw JOIN dz0 USING (hand_date) GROUP BY 1),",
    f"dr AS ({' UNION ALL '.join(f'SELECT hand_date, leak_code FROM ({x})' for x in q.group_rules('d3', 'd4', 'd5', 'hand_date, '))} UNION ALL SELECT hand_date, 'OVERBETTING' FROM dz WHERE ratio>0.10 AND n>=15),",
    POS.format(k="hand_date", q="hand_date AS k", src="b_hands").replace("FROM b_hands", "FROM pw") + TILT + ",",
    "dt AS (SELECT k AS hand_date FROM tl WHERE ws>0 AND NOT (vd<0.08 AND max_streak<4))",
])


@query("a23_daily_errors", "A23 U1 B2", uses="spots", ctes=DAY_DET, sql="""SELECT strftime(d.hand_date,'%Y-%m-%d') AS date, d.week_label, CASE WHEN d.n<12 THEN 0 ELSE (SELECT COUNT(*) FROM dr WHERE dr.hand_date=d.hand_date)+(SELECT COUNT(*) FROM dt WHERE dt.hand_date=d.hand_date) END AS technical_errors,
 CASE WHEN d.n<12 THEN 0 ELSE (SELECT COUNT(*) FROM dr WHERE dr.hand_date=d.hand_date AND leak_code LIKE 'ICM%') END AS icm_errors FROM (SELECT hand_date, week_label, COUNT(*) AS n FROM pw GROUP BY 1,2) d""")
def _(t):
    w = written(weekly.with_week(t.spots), "weeks")
    from tallyfold.plans import leaks as lk

    p = lk.prepare_once(w, keep=["hand_date"])
    s = weekly.series(weekly.error_counts(p, "hand_date"), w)
    return s.select(F.date_format("hand_date", "yyyy-MM-dd").alias("date"), "week_label", "technical_errors", "icm_errors")


WEEK_DET = ",\n".join([
    f"{q.PREP}, pw AS (SELECT prep.*, CASE WHEN hand_date>a-7 THEN '{weekly.CURRENT}' ELSE '{weekly.PREVIOUS}' END AS week_label FROM prep, (SELECT MAX(hand_date) AS a FROM b_spots) WHERE hand_date>a-14)",
    q.groups("w3", "week_label, stack_bucket, position, phase", "pw"),
    f"wr AS ({next(x for x in q.group_rules('w3', 'w3', '', 'week_label, ') if 'ICM_SUICIDE' in x)})",
    f"kp AS (SELECT week_label, COUNT(*) AS hands, ROUND({BB100},4) AS bb100, ROUND(coalesce(AVG(CASE WHEN position='SB' AND big_blind>0 AND hero_stack_start/big_blind BETWEEN 15 AND 25 THEN hero_pfr END),0),4) AS sb FROM pw GROUP BY 1)",
    """lg AS (SELECT week_label, unnest([struct_pack(k:='hands', v:=hands::DOUBLE), struct_pack(k:='bb100', v:=bb100::DOUBLE), struct_pack(k:='sb_pfr_15_25bb', v:=sb::DOUBLE),
 struct_pack(k:='icm_suicide', v:=(CASE WHEN hands<12 THEN 0 ELSE (SELECT COUNT(*) FROM wr WHERE wr.week_label=kp.week_label) END)::DOUBLE)]) AS x FROM kp)""",
])


@query("b02_weekly_report", "B2", uses="spots", ctes=WEEK_DET, sql=f"""SELECT kpi, previous, current, ROUND(current-previous,4) AS delta FROM (SELECT x.k AS kpi, coalesce(MAX(x.v) FILTER (WHERE week_label='{weekly.PREVIOUS}'),0.0) AS previous, coalesce(MAX(x.v) FILTER (WHERE week_label='{weekly.CURRENT}'),0.0) AS current FROM lg GROUP BY 1)""")
def _(t):
    from tallyfold.plans import leaks as lk

    w = written(weekly.with_week(t.spots), "weeks")
    return weekly.report(w, lk.prepare_once(w, keep=["week_label"]))


@query("a52_tilt_note", "A52 S8", sql="SELECT 'Disciplina de Tilt: ' || CASE WHEN a<15 THEN 'Excelente' WHEN a<30 THEN 'Moderada' ELSE 'Critica' END || ' (media ' || printf('%.1f', a) || '%).' AS note FROM (SELECT AVG(value) AS a FROM events WHERE ts>=TIMESTAMP '2024-01-24 00:00:00')")
def _(t):
    return weekly.tilt_note(t.events.where(F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")), "value")


# ---- quality and profiles ----


@query("a26_quality_issues", "A26 D27", sql="""WITH x AS (SELECT l_orderkey AS id, 'L' || l_orderkey || '-' || l_linenumber AS hand_id, CASE WHEN l_partkey%50=0 THEN 0 ELSE l_quantity END AS hero_stack_start, CASE WHEN l_suppkey%40=0 THEN NULL ELSE l_tax END AS big_blind, CASE WHEN l_partkey%77=0 THEN 2 ELSE 1 END AS hero_vpip FROM lineitem)
SELECT 'error' AS level, 'duplicate_hand_id' AS code, 'hand_id' AS "column", COUNT(*)-COUNT(DISTINCT hand_id) AS sample_size FROM x UNION ALL SELECT 'warning','numeric_nulls','big_blind', COUNT(*) FILTER (WHERE big_blind IS NULL) FROM x
UNION ALL SELECT 'error','invalid_stack_bb','hero_stack_start', COUNT(*) FILTER (WHERE hero_stack_start<=0 OR big_blind<=0 OR big_blind IS NULL) FROM x UNION ALL SELECT 'warning','rate_out_of_bounds','hero_vpip', COUNT(*) FILTER (WHERE hero_vpip>1) FROM x
UNION ALL SELECT 'error','missing_column', c, 0 FROM (VALUES ('hero_position'),('hero_action_preflop'),('won_cents'),('hero_result')) v(c)""")
def _(t):
    f = F.col
    d = t.lineitem.select(f("l_orderkey").alias("id"), F.concat(F.lit("L"), "l_orderkey", F.lit("-"), "l_linenumber").alias("hand_id"), F.when(f("l_partkey") % 50 == 0, 0.0).otherwise(f("l_quantity")).alias("hero_stack_start"),
                          F.when(f("l_suppkey") % 40 != 0, f("l_tax")).alias("big_blind"), F.when(f("l_partkey") % 77 == 0, 2).otherwise(1).alias("hero_vpip"), F.lit(0).alias("hero_pfr"))
    return quality.issues(d)


NUMS = ["login_days_r", "tickets_r", "nps_r", "mrr_cents", "max_users", "dias_no_contrato"]


@query("a45_describe", "A45 A16", uses="features", sql=" UNION ALL ".join(f"""SELECT '{c}' AS feature, COUNT({c}) AS count, COUNT(*)-COUNT({c}) AS nulls, ROUND(AVG({c}),4) AS mean, ROUND(stddev_samp({c}),4) AS std, MIN({c})::DOUBLE AS min, MAX({c})::DOUBLE AS max,
 quantile_cont({c}::DOUBLE,0.25) AS q25, quantile_cont({c}::DOUBLE,0.5) AS q50, quantile_cont({c}::DOUBLE,0.75) AS q75 FROM b_features""" for c in NUMS))
def _(t):
    return quality.describe(t.features, NUMS).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("a46_pivot", "A46", uses="features", sql="SELECT segment, ROUND(AVG(nps_r) FILTER (WHERE account_id%3=0),6) AS churned, ROUND(AVG(nps_r) FILTER (WHERE account_id%3<>0),6) AS renewed, 1-AVG(CASE WHEN account_id%3=0 THEN 0.0::DOUBLE ELSE 1 END) AS churn_rate, CAST(SUM(mrr_cents) FILTER (WHERE account_id%3=0) AS BIGINT) AS mrr_at_risk_cents FROM b_features GROUP BY 1")
def _(t):
    d = t.features.withColumn("outcome", F.when(F.col("account_id") % 3 == 0, "churned").otherwise("renewed"))
    p = d.groupBy("segment").pivot("outcome", ["churned", "renewed"]).agg(F.round(F.avg("nps_r"), 6))
    r = d.groupBy("segment").agg((1 - F.avg(F.when(F.col("outcome") == "renewed", 1.0).otherwise(0.0))).alias("churn_rate"), F.sum(F.when(F.col("outcome") == "churned", F.col("mrr_cents"))).alias("mrr_at_risk_cents"))
    return p.join(r, "segment")


@query("a47_histogram", "A47", sql="""SELECT event_type, 'value' AS feature, CAST(LEAST(floor((value-lo)/(hi-lo)*25),24) AS INT) AS bin, COUNT(*) AS n FROM events JOIN (SELECT event_type, MIN(value) AS lo, MAX(value) AS hi FROM events GROUP BY 1) USING (event_type) GROUP BY 1,2,3""")
def _(t):
    return quality.histogram(t.events, ["value"], "event_type")


@query("a48_correlations", "A48", uses="features", sql=" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, ROUND(corr({a},{b}),6) AS corr FROM b_features" for i, a in enumerate(NUMS) for b in NUMS[i + 1:]))
def _(t):
    return quality.correlations(t.features, NUMS).withColumn("corr", F.round("corr", 6))


SCORED = "sc AS (SELECT doc_id, ((doc_id*37)%101)/100.0::DOUBLE AS score, quality=1 AS y, (doc_id*13)%1000 AS money FROM labels)"
SWEEP = SCORED + ", th AS (SELECT unnest([" + ",".join(f"{x}::DOUBLE" for x in curves.THRESHOLDS) + "]) AS threshold), cf AS (SELECT threshold, COUNT(*) FILTER (WHERE score>=threshold AND y) AS tp, COUNT(*) FILTER (WHERE score>=threshold AND NOT y) AS fp, COUNT(*) FILTER (WHERE score<threshold AND y) AS fn, COUNT(*) FILTER (WHERE score<threshold AND NOT y) AS tn, CAST(coalesce(SUM(money) FILTER (WHERE score>=threshold AND y),0) AS BIGINT) AS caught, CAST(coalesce(SUM(money) FILTER (WHERE score<threshold AND y),0) AS BIGINT) AS missed, CAST(coalesce(SUM(money) FILTER (WHERE score>=threshold AND NOT y),0) AS BIGINT) AS false_alarm FROM th, sc GROUP BY 1), f1 AS (SELECT *, 2*(tp/(tp+fp+1e-9::DOUBLE))*(tp/(tp+fn+1e-9::DOUBLE))/((tp/(tp+fp+1e-9::DOUBLE))+(tp/(tp+fn+1e-9::DOUBLE))+1e-9::DOUBLE) AS f1 FROM cf)"


def labelled(t):
    return t.labels.select(((F.col("doc_id") * 37) % 101 / 100.0).alias("score"), (F.col("quality") == 1).alias("y"), ((F.col("doc_id") * 13) % 1000).alias("money"))


@query("a49_threshold_sweep", "A49", ctes=SWEEP, sql="SELECT threshold, tp, fp, fn, tn, ROUND(tp/(tp+fp+1e-9::DOUBLE),6) AS precision, ROUND(tp/(tp+fn+1e-9::DOUBLE),6) AS recall, ROUND(f1,6) AS f1 FROM f1")
def _(t):
    s = curves.threshold_sweep(labelled(t), F.col("score"), F.col("y"))
    return s.select("threshold", "tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("a49_best_threshold", "A49", ctes=SWEEP, sql="SELECT threshold, ROUND(f1,6) AS f1 FROM f1 ORDER BY f1.f1 DESC, threshold LIMIT 1")
def _(t):
    return curves.best_f1(curves.threshold_sweep(labelled(t), F.col("score"), F.col("y"))).withColumn("f1", F.round("f1", 6))


@query("a50_money_by_threshold", "A50", ctes=SWEEP, sql="SELECT threshold, caught, missed, false_alarm FROM cf")
def _(t):
    return curves.threshold_sweep(labelled(t), F.col("score"), F.col("y"), F.col("money")).select("threshold", "caught", "missed", "false_alarm")


RANKED = SCORED + ", h AS (SELECT score, COUNT(*) FILTER (WHERE y) AS p, COUNT(*) FILTER (WHERE NOT y) AS n FROM sc GROUP BY 1), r AS (SELECT *, SUM(p) OVER (ORDER BY score DESC) AS tp, SUM(n) OVER (ORDER BY score DESC) AS fp, SUM(p) OVER () AS tpt, SUM(n) OVER () AS fpt FROM h)"


@query("a51_curve_points", "A51", ctes=RANKED, sql="SELECT score, ROUND(tp/tpt,9) AS tpr, ROUND(fp/fpt,9) AS fpr, ROUND(tp/(tp+fp),9) AS precision FROM r")
def _(t):
    return curves.curve_points(labelled(t), F.col("score"), F.col("y")).select("score", *[F.round(x, 9).alias(x) for x in ("tpr", "fpr", "precision")])


@query("a51_curve_areas", "A51", ctes=RANKED, sql="SELECT ROUND(SUM(p*(fpt-fp+n/2.0::DOUBLE))/MAX(tpt*fpt),9) AS auc, ROUND(SUM(p/tpt*(tp/(tp+fp))),9) AS average_precision FROM r")
def _(t):
    return curves.curve_areas(labelled(t), F.col("score"), F.col("y")).select(F.round("auc", 9).alias("auc"), F.round("average_precision", 9).alias("average_precision"))


# ---- drift ----

LONG = "lg AS (SELECT event_type AS feature, value AS v, ts>=TIMESTAMP '2024-01-16 00:00:00' AS cur FROM events)"
PSISQL = LONG + """, eg AS (SELECT feature, list_distinct(quantile_cont(v, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) AS e0 FROM lg WHERE NOT cur GROUP BY 1), ed AS (SELECT feature, list_sort(e0) AS e FROM eg),
 bn AS (SELECT feature, CASE WHEN v=e[len(e)] THEN len(e)-1 ELSE len(list_filter(e, lambda x: x<=v)) END AS bin, COUNT(*) FILTER (WHERE NOT cur) AS b, COUNT(*) FILTER (WHERE cur) AS c FROM lg JOIN ed USING (feature) WHERE v>=e[1] AND v<=e[len(e)] GROUP BY 1,2),
 tt AS (SELECT feature, COUNT(*) FILTER (WHERE NOT cur) AS tb, COUNT(*) FILTER (WHERE cur) AS tc FROM lg GROUP BY 1),
 ps AS (SELECT feature, GREATEST(0,SUM(((c+0.5)/(tc+5.0)-(b+0.5)/(tb+5.0))*ln(((c+0.5::DOUBLE)/(tc+5.0::DOUBLE))/((b+0.5::DOUBLE)/(tb+5.0::DOUBLE))))) AS psi FROM bn JOIN tt USING (feature) GROUP BY 1)"""
KSSQL = LONG + """, kc AS (SELECT feature, v, COUNT(*) FILTER (WHERE NOT cur) AS b, COUNT(*) FILTER (WHERE cur) AS c FROM lg GROUP BY 1,2), kr AS (SELECT feature, SUM(b) OVER w AS cb, SUM(c) OVER w AS cc, SUM(b) OVER (PARTITION BY feature) AS tb, SUM(c) OVER (PARTITION BY feature) AS tc FROM kc WINDOW w AS (PARTITION BY feature ORDER BY v)),
 kd AS (SELECT feature, MAX(ABS(cb/tb-cc/tc)) AS ks, MAX(tb) AS nb, MAX(tc) AS nc FROM kr GROUP BY 1), kp AS (SELECT *, LEAST(1.0::DOUBLE,GREATEST(0.0::DOUBLE,list_sum(list_transform(range(1,101), lambda k: (CASE WHEN k%2=1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END)*exp(-2.0::DOUBLE*k*k*(nb*nc/(nb+nc))*ks*ks))))) AS p_value FROM kd)"""


def long(t):
    return t.events.select(F.col("event_type").alias("feature"), F.col("value").alias("v"), (F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).alias("is_current"))


@query("m29_psi", "M29", ctes=PSISQL, sql="SELECT feature, ROUND(psi,6) AS psi FROM ps")
def _(t):
    return drift.psi(long(t)).withColumn("psi", F.round("psi", 6))


@query("m30_ks", "M30", ctes=KSSQL, sql="SELECT feature, ROUND(ks,9) AS ks, ROUND(p_value,6) AS p_value FROM kp")
def _(t):
    return drift.ks(long(t)).select("feature", F.round("ks", 9).alias("ks"), F.round("p_value", 6).alias("p_value"))


@query("m30_mean_shift", "M30", ctes=LONG, sql="SELECT feature, ROUND(LEAST(ABS(AVG(v) FILTER (WHERE NOT cur)-AVG(v) FILTER (WHERE cur))/(stddev_pop(v) FILTER (WHERE NOT cur)+1e-9::DOUBLE),1.0::DOUBLE),6) AS stat FROM lg GROUP BY 1")
def _(t):
    return drift.mean_shift(long(t)).select("feature", F.round("stat", 6).alias("stat"))


@query("m31_drift_report", "M31 D19", ctes=PSISQL + KSSQL[len(LONG):], sql="""SELECT kp.feature, ROUND(AVG(v) FILTER (WHERE NOT cur),4) AS base_mean, ROUND(stddev_pop(v) FILTER (WHERE NOT cur),4) AS base_std, ROUND(AVG(v) FILTER (WHERE cur),4) AS cur_mean, ROUND(stddev_pop(v) FILTER (WHERE cur),4) AS cur_std,
 MAX(p_value)<0.05 OR MAX(psi)>0.25 AS drift_detected FROM kp JOIN ps USING (feature) JOIN lg USING (feature) GROUP BY 1""")
def _(t):
    return drift.check(long(t)).select("feature", *[F.round(x, 4).alias(x) for x in ("base_mean", "base_std", "cur_mean", "cur_std")], "drift_detected")


@query("m31_retrain_decision", "M31 R7", ctes=PSISQL + KSSQL[len(LONG):], sql="""SELECT COUNT(*) AS features, coalesce(string_agg(CASE WHEN (p_value<0.05 OR psi>0.25) AND feature IN ('view','click') THEN feature END, ',' ORDER BY feature),'') AS critical_features, COUNT(*) FILTER (WHERE (p_value<0.05 OR psi>0.25) AND feature IN ('view','click'))>=2 AS should_retrain FROM kp JOIN ps USING (feature)""")
def _(t):
    return drift.decision(drift.check(long(t)), ["view", "click"])


# ---- entities, vectors, sessions ----

ACTIONS = """ac AS (SELECT coalesce(villain_id,'') AS name, date_utc AS at, s.street, CASE WHEN contains(tok,'3BET') THEN '3bet' WHEN contains(tok,'4BET') THEN '4bet' WHEN contains(tok,'RAISE') THEN 'raise' WHEN contains(tok,'BET') THEN 'bet' WHEN contains(tok,'CALL') THEN 'call' WHEN contains(tok,'FOLD') THEN 'fold' ELSE 'check' END AS action
 FROM (SELECT villain_id, date_utc, unnest([struct_pack(street:='preflop',txt:=hero_action_preflop), struct_pack(street:='flop',txt:=hero_action_flop), struct_pack(street:='turn',txt:=hero_action_turn), struct_pack(street:='river',txt:=hero_action_river)]) AS s FROM b_spots), LATERAL (SELECT unnest(string_split(replace(s.txt,'→',','),',')) AS tok0), LATERAL (SELECT upper(trim(tok0)) AS tok) WHERE trim(tok0)<>'')"""


def observed(t):
    st = F.array(*[F.struct(F.lit(n).alias("street"), F.col(c).alias("txt")) for n, c in zip(["preflop", "flop", "turn", "river"], play.STREETS)])
    d = t.spots.select("villain_id", "date_utc", F.explode(st).alias("s"))
    d = d.select(F.coalesce("villain_id", F.lit("")).alias("name"), F.col("date_utc").alias("at"), "s.street", F.explode(F.split(F.replace("s.txt", F.lit("→"), F.lit(",")), ",")).alias("tok"))
    k = F.upper(F.trim("tok"))
    act = F.when(k.contains("3BET"), "3bet").when(k.contains("4BET"), "4bet").when(k.contains("RAISE"), "raise").when(k.contains("BET"), "bet").when(k.contains("CALL"), "call").when(k.contains("FOLD"), "fold").otherwise("check")
    return d.where(F.trim("tok") != "").select("name", "at", "street", act.alias("action"))


ENTITY = ACTIONS + """, en AS (SELECT name, COUNT(*) FILTER (WHERE street='preflop') AS hands_seen, COUNT(*) FILTER (WHERE street='preflop' AND action IN ('call','raise','3bet','4bet')) AS vpip_num, COUNT(*) FILTER (WHERE street='preflop' AND action IN ('raise','3bet','4bet')) AS pfr_num,
 COUNT(*) FILTER (WHERE street='preflop' AND action='3bet') AS tbet_num, COUNT(*) FILTER (WHERE street='preflop' AND action IN ('3bet','fold','call')) AS tbet_den, COUNT(*) FILTER (WHERE street='preflop' AND action='fold') AS f3b_den,
 COUNT(*) FILTER (WHERE street<>'preflop' AND action IN ('bet','raise','3bet','4bet')) AS agg_num, COUNT(*) FILTER (WHERE street<>'preflop') AS agg_den FROM ac WHERE name<>'' GROUP BY 1)"""


@query("a44_entity_accumulators", "A44 D22", uses="spots", ctes=ENTITY, sql="SELECT name, hands_seen, vpip_num, pfr_num, tbet_num, tbet_den, f3b_den, agg_num, agg_den, vpip_num::DOUBLE/hands_seen AS vpip, agg_num::DOUBLE/agg_den AS agg_freq, CASE WHEN f3b_den>0 THEN 1.0::DOUBLE ELSE 0.0 END AS fold_to_3bet FROM en")
def _(t):
    return entities.with_rates(entities.accumulate(observed(t))).select("name", "hands_seen", "vpip_num", "pfr_num", "tbet_num", "tbet_den", "f3b_den", "agg_num", "agg_den", "vpip", "agg_freq", "fold_to_3bet")


@query("x14_hud_lines", "X14", uses="spots")
def _(t):
    return entities.hud_line(entities.with_rates(entities.accumulate(observed(t))))


@query("c07_cosine_distance", "C7", ctes="q0 AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)", sql="""SELECT vec_id, ROUND(1.0-list_dot_product(embedding::DOUBLE[], q::DOUBLE[])/(sqrt(list_dot_product(embedding::DOUBLE[],embedding::DOUBLE[]))*sqrt(list_dot_product(q::DOUBLE[],q::DOUBLE[]))),6) AS distance FROM embeddings, q0""")
def _(t):
    first = t.embeddings.orderBy("vec_id").limit(1).select("embedding")
    return t.embeddings.withColumn("q", first.scalar()).select("vec_id", F.round(vx.cosine_distance(F.col("embedding"), F.col("q")), 6).alias("distance"))


RECALL = "d AS (SELECT e.label, qs.qid AS query_id, e.vec_id, 1.0-list_dot_product(e.embedding::DOUBLE[], x.embedding::DOUBLE[])/(sqrt(list_dot_product(e.embedding::DOUBLE[],e.embedding::DOUBLE[]))*sqrt(list_dot_product(x.embedding::DOUBLE[],x.embedding::DOUBLE[]))) AS dist FROM embeddings e JOIN qs USING (label) JOIN embeddings x ON x.vec_id=qs.qid)"
RECALLED = "SELECT label, query_id, vec_id, rank, ROUND(dist,6) AS distance FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label, query_id ORDER BY dist, vec_id) AS rank FROM d) WHERE rank<=5"


@query("w20_recall", "W20 C7", ctes=f"qs AS (SELECT label, MIN(vec_id) AS qid FROM embeddings GROUP BY 1), {RECALL}", sql=RECALLED)
def _(t):
    e = t.embeddings
    queries = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("x")).select("label", "x.*")
    return vx.recall(e, queries, "label", "embedding", "vec_id").withColumn("distance", F.round("distance", 6))


@query("w20_recall_two_queries", "W20 C7", ctes=f"qs AS (SELECT label, MIN(vec_id) AS qid FROM embeddings GROUP BY 1 UNION SELECT label, MAX(vec_id) FROM embeddings GROUP BY 1), {RECALL}", sql=RECALLED)
def _(t):
    """Two queries in every partition keep their own neighbours."""
    e = t.embeddings
    ends = e.groupBy("label").agg(*[f(F.struct("vec_id", "embedding"), "vec_id").alias(n) for n, f in (("a", F.min_by), ("b", F.max_by))])
    queries = ends.select("label", F.explode(F.array_distinct(F.array("a", "b"))).alias("x")).select("label", "x.*")
    return vx.recall(e, queries, "label", "embedding", "vec_id").withColumn("distance", F.round("distance", 6))


@query("c06_hash_embedding_benchmark", "C6", ctes="tk AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x<>'') AS toks FROM benchmark), tt AS (SELECT item_id, unnest(range(len(toks))) AS i, toks FROM tk), hx AS (SELECT item_id, i, sha256(i || ':' || toks[i+1]) AS h FROM tt), bx AS (SELECT item_id, i, j, CAST('0x' || substr(h, CAST(2*j+1 AS INT), 2) AS INT) AS b FROM (SELECT *, unnest(range(32)) AS j FROM hx)), sl AS (SELECT item_id, (i*131+j*17+b)%384 AS slot, SUM((b-127.5)/127.5::DOUBLE) AS v FROM bx GROUP BY 1,2), nm AS (SELECT item_id, sqrt(SUM(v*v)) AS n FROM sl GROUP BY 1)", sql="SELECT item_id, slot, ROUND(v/n,6) AS v FROM sl JOIN nm USING (item_id) WHERE ROUND(v/n,6)<>0")
def _(t):
    d = t.benchmark.select("item_id", F.posexplode(vx.hash_embedding(F.col("text"))).alias("slot", "v"))
    return d.select("item_id", F.col("slot").cast("long").alias("slot"), F.round("v", 6).alias("v")).where("v <> 0")


@query("c06_hash_embedding_documents", "C6")
def _(t):
    return t.documents.select("doc_id", vx.hash_embedding(F.col("text")).alias("e")).select("doc_id", F.size("e").alias("dims"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


@query("c08_session_messages", "C8 D25", sql="SELECT conv_id, turn, role, sha256(text) AS text_hash FROM conversations")
def _(t):
    back = vx.sessions_to_messages(vx.messages_to_sessions(t.conversations))
    return back.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_hash"))


@query("x16_content_hash", "X16 K12", sql="SELECT page_id, substr(sha256(html),1,16) AS short_hash, sha256(html) AS full_hash FROM pages")
def _(t):
    return t.pages.select("page_id", F.substring(F.sha2("html", 256), 1, 16).alias("short_hash"), F.sha2("html", 256).alias("full_hash"))


@query("u03_street_concat", "U3 X13 W13", uses="spots", ctes="ux AS (SELECT id, s.n AS n, s.street AS street, ord, upper(trim(tok0)) AS tok FROM (SELECT id, unnest([struct_pack(n:=1,street:='PREFLOP',txt:=hero_action_preflop), struct_pack(n:=2,street:='FLOP',txt:=hero_action_flop), struct_pack(n:=3,street:='TURN',txt:=hero_action_turn), struct_pack(n:=4,street:='RIVER',txt:=hero_action_river)]) AS s FROM b_spots), LATERAL (SELECT unnest(string_split(replace(s.txt,'→',','),',')) AS tok0, unnest(range(len(string_split(replace(s.txt,'→',','),',')))) AS ord) WHERE trim(tok0)<>'')", sql="""SELECT id, CAST(ROW_NUMBER() OVER (PARTITION BY id ORDER BY n, ord) AS INT) AS action_order, street, CASE WHEN contains(tok,'RAISE') THEN 'RAISE' WHEN contains(tok,'BET') THEN 'BET' WHEN contains(tok,'CALL') THEN 'CALL' WHEN contains(tok,'FOLD') THEN 'FOLD' WHEN contains(tok,'CHECK') THEN 'CHECK' ELSE 'UNKNOWN' END AS action_type, contains(tok,'ALL-IN') OR contains(tok,'ALL IN') AS is_all_in FROM ux""")
def _(t):
    from tallyfold.sources.play_log import actions_from_text

    return actions_from_text(t.spots).select("id", "action_order", "street", "action_type", "is_all_in")
