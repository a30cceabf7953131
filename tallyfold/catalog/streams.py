"""Streaming queries drained over the supplied events, with SQL twins of the final result."""

from pyspark.sql import functions as F

from tallyfold.catalog import decisions as cd, ingest as ci, operators as co
from tallyfold.catalog.registry import query
from tallyfold.sources import bindings
from tallyfold.session import scratch_path
from tallyfold.streaming import bounded, drains, play as sp, settings


def events(t):
    """The events table as a file stream; a typed timestamp is needed for watermarks."""
    path = f"{t.sf_dir}/events.parquet"
    schema = t.spark.read.parquet(path).schema
    return drains.files(t.spark, f"{t.sf_dir}/events.parque[t]", schema)  # a glob serves one file or a folder alike


def hands(t):
    d = events(t).selectExpr(*[f"{e} AS {n}" for n, e in bindings.HANDS])
    return d.withColumn("at", F.col("date_utc").cast("timestamp"))


def requests(t):
    return t.spark.sql(bindings._bind(bindings.REQUESTS, ["events"]), events=events(t))


@query("r01_stream_ingest", "R1 S10 K5", uses="hands", sql="SELECT id, hand_id, won_cents FROM b_hands")
def _(t):
    return sp.ingest(hands(t).select("id", "hand_id", "won_cents"), "hand_id")


@query("r01_log_facts", "R1 S10 D4", uses="", sql="SELECT CAST(event_id AS VARCHAR) AS hand_id, CAST(user_id AS VARCHAR) AS tournament_id, (2000+event_id%900)::DOUBLE AS hero_stack_start FROM events WHERE event_id%41<>0")
def _(t):
    facts, _ = sp.ingest_logs(t.spark, ci.write_logs(t), "Hero")
    return facts.select("hand_id", "tournament_id", "hero_stack_start")


@query("r01_log_actions", "R1 S10 K7", uses="", ctes=ci.LINES, sql="SELECT CAST(event_id AS VARCHAR) AS hand_id, COUNT(*) AS n, SUM(amt) AS amount FROM la GROUP BY 1")
def _(t):
    logs = ci.write_logs(t)
    t.blocks.select(F.concat("raw", F.lit("\n\n")).alias("value")).write.mode("append").text(logs)  # every record comes twice
    _, actions = sp.ingest_logs(t.spark, logs, "Hero", per_batch=8)
    return actions.groupBy(F.substring_index("record", ":", -1).alias("hand_id")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("r02_drop_repeats", "R2", sql="SELECT user_id, COUNT(*) AS n FROM (SELECT DISTINCT user_id, event_id FROM events) GROUP BY 1")
def _(t):
    e = events(t).select("user_id", F.sha2(F.to_json(F.struct("event_id", "event_type", "value", "props")), 256).alias("content_sha256"), F.col("ts").cast("timestamp").alias("at"))
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return sp.drop_repeats(twice, "at", ["user_id", "content_sha256"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("r03_stream_entities", "R3 A44", uses="spots", ctes=co.ENTITY, sql="SELECT name, hands_seen, vpip_num, pfr_num, tbet_num, tbet_den, f3b_den, agg_num, agg_den FROM en")
def _(t):
    spots = events(t).selectExpr(*[f"{e} AS {n}" for n, e in bindings.SPOTS])

    class Live:
        pass

    live = Live()
    live.spots = spots
    d = sp.entity_totals(co.observed(live))
    return d.select("name", "hands_seen", "vpip_num", "pfr_num", "tbet_num", "tbet_den", "f3b_den", "agg_num", "agg_den")


@query("r04_stream_settings", "R4", uses="requests", ctes=cd.CTXSQL, sql=f"SELECT request_id, {cd.CARRY.format(c='bb0')} AS bb, {cd.CARRY.format(c='ante0')} AS ante, {cd.CARRY.format(c='open0')} AS open_mult FROM sv")
def _(t):
    return sp.session_settings(requests(t)).select("request_id", "bb", "ante", "open_mult")


@query("r05_stream_counters", "R5 A43", uses="requests", ctes=cd.SCORE, sql="SELECT session_id, COUNT(*) AS requests, SUM(latency_us)::DOUBLE/COUNT(*) AS avg_latency_us, COUNT(*) FILTER (WHERE color_code='RED_FOLD') AS red FROM sc GROUP BY 1")
def _(t):
    return sp.session_counters(sp.request_scores(requests(t))).select("session_id", "requests", "avg_latency_us", "red")


@query("r06_stream_scores", "R6 B12", uses="requests", ctes=cd.SCORE, sql="SELECT request_id, decision, color_code FROM sc")
def _(t):
    return drains.append(sp.request_scores(requests(t)).select("request_id", "decision", "color_code"), "scores")


@query("r08_stream_audit", "R8 K4", uses="audit", sql="SELECT entry_id, event_type, CAST(details->>'$.risk_pct' AS INT) AS risk_pct FROM b_audit")
def _(t):
    log = t.spark.sql(bindings._bind(bindings.AUDIT, ["events"]), events=events(t))
    return drains.append(log.select("entry_id", "event_type", "details"), "audit").select("entry_id", "event_type", F.get_json_object("details", "$.risk_pct").cast("int").alias("risk_pct"))


@query("r09_daily_windows", "R9 A5", uses="hands", sql="SELECT strftime(hand_date,'%Y-%m-%d') AS date, COUNT(*) AS hands, AVG(hero_vpip) AS vpip, AVG(hero_pfr) AS pfr FROM b_hands GROUP BY 1")
def _(t):
    return drains.updates(sp.daily_trend(hands(t), "at"), "daily", ["date"])


@query("r09_sliding_week", "R9 A21", uses="hands", sql="SELECT strftime(hand_date-k,'%Y-%m-%d') AS from_date, COUNT(*) AS hands, CAST(SUM(won_cents) AS BIGINT) AS net_cents FROM (SELECT hand_date, won_cents, CAST(unnest(range(7)) AS INT) AS k FROM b_hands) GROUP BY 1")
def _(t):
    return drains.updates(sp.sliding_week(hands(t), "at"), "sliding", ["from_date"])


@query("r09_play_sessions", "R9", uses="hands", ctes="""g AS (SELECT *, CASE WHEN lag(date_utc) OVER (PARTITION BY hero_id ORDER BY date_utc, id) IS NULL OR date_utc-lag(date_utc) OVER (PARTITION BY hero_id ORDER BY date_utc, id)>=INTERVAL 6 HOURS THEN 1 ELSE 0 END AS b FROM b_hands),
 s AS (SELECT *, SUM(b) OVER (PARTITION BY hero_id ORDER BY date_utc, id ROWS UNBOUNDED PRECEDING) AS sid FROM g), ss AS (SELECT hero_id, sid, MIN(date_utc) AS st, MAX(date_utc) AS en, COUNT(*) AS hands, COUNT(*) FILTER (WHERE hero_result='win') AS wins FROM s GROUP BY 1,2)""",
       sql="SELECT hero_id, strftime(st,'%Y-%m-%d %H:%M:%S') AS started, hands, wins FROM ss")
def _(t):
    return drains.final(sp.play_sessions(hands(t), "at"), "play-sessions")


# ---- bounded state: rows arrive in four shares by date, every tenth row a share or more too late ----

LATENESS = "2 days"


def landed_events(t):
    """The events as they land: shares of eight days each, one after the other, with displaced rows."""
    path = scratch_path(t.spark, "landed")
    day = F.dayofmonth("ts")
    share = F.least(F.lit(3), F.floor((day - 1) / 8) + F.when(F.col("event_id") % 10 == 0, 1 + F.col("event_id") % 2).otherwise(0))
    for k in range(4):
        t.events.where(share == k).write.mode("append").parquet(path)
    return drains.files(t.spark, path, t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema, per_batch=4)


def landed(t):
    return landed_events(t).selectExpr(*[f"{e} AS {n}" for n, e in bindings.HANDS]).withColumn("at", F.col("date_utc").cast("timestamp"))


@query("r01_bounded_ingest", "R1 R9 K5", uses="hands", sql="SELECT id, hand_id, won_cents FROM b_hands")
def _(t):
    hands_ = landed(t).select("id", "hand_id", "won_cents", "at")
    return bounded.first_per_key(hands_, "at", ["hand_id"], LATENESS).rows.drop("at")


@query("r02_bounded_repeats", "R2", uses="hands", ctes="""rg AS (SELECT hero_id, hero_position, date_utc, CASE WHEN date_utc - lag(date_utc) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS b FROM b_hands WINDOW w AS (PARTITION BY hero_id, hero_position ORDER BY date_utc, id)),
 rs AS (SELECT *, SUM(b) OVER (PARTITION BY hero_id, hero_position ORDER BY date_utc ROWS UNBOUNDED PRECEDING) AS sid FROM rg)""",
       sql="SELECT hero_id, hero_position, strftime(MIN(date_utc),'%Y-%m-%d %H:%M:%S') AS first_at, COUNT(*) AS copies FROM rs GROUP BY hero_id, hero_position, sid")
def _(t):
    b = bounded.sessions(landed(t).select("hero_id", "hero_position", "at"), "at", LATENESS, "12 hours", ["hero_id", "hero_position"], {"copies": F.lit(1)})
    return b.rows.select("hero_id", "hero_position", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("first_at"), "copies")


@query("r09_bounded_daily", "R9 A5", uses="hands", sql="SELECT strftime(hand_date,'%Y-%m-%d') AS date, COUNT(*) AS hands, AVG(hero_vpip) AS vpip, AVG(hero_pfr) AS pfr FROM b_hands GROUP BY 1")
def _(t):
    b = bounded.windowed(landed(t).select("hero_vpip", "hero_pfr", "at"), "at", LATENESS, {"hands": F.lit(1), "v": F.col("hero_vpip"), "p": F.col("hero_pfr")}, "1 day")
    return b.rows.select(F.date_format("start", "yyyy-MM-dd").alias("date"), "hands", (F.col("v") / F.col("hands")).alias("vpip"), (F.col("p") / F.col("hands")).alias("pfr"))


@query("r09_bounded_week", "R9 A21", uses="hands", sql="SELECT strftime(hand_date-k,'%Y-%m-%d') AS from_date, COUNT(*) AS hands, CAST(SUM(won_cents) AS BIGINT) AS net_cents FROM (SELECT hand_date, won_cents, CAST(unnest(range(7)) AS INT) AS k FROM b_hands) GROUP BY 1")
def _(t):
    b = bounded.windowed(landed(t).select("won_cents", "at"), "at", LATENESS, {"hands": F.lit(1), "net_cents": F.col("won_cents")}, "7 days", "1 day")
    return b.rows.select(F.date_format("start", "yyyy-MM-dd").alias("from_date"), "hands", "net_cents")


@query("r04_bounded_settings", "R4 R3", uses="requests", ctes=cd.CTXSQL, sql=f"SELECT request_id, {cd.CARRY.format(c='bb0')} AS bb, {cd.CARRY.format(c='ante0')} AS ante, {cd.CARRY.format(c='open0')} AS open_mult FROM sv")
def _(t):
    rows = t.spark.sql(bindings._bind(bindings.REQUESTS, ["events"]), events=landed_events(t))
    return settings.with_settings(rows, LATENESS).rows.select("request_id", "bb", "ante", "open_mult")
