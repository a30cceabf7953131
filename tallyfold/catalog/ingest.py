"""Source, sink and text-ingestion queries with their SQL twins."""

from pyspark.sql import functions as F

from tallyfold.catalog.registry import query
from tallyfold.plans import play_stats as ps
from tallyfold.session import scratch_path, written
from tallyfold.sources import bucketed, file_versions, play_log as pl, readers, sinks

COLS = [f.name for f in readers.PLAY_SCHEMA.fields]
ROW = "SELECT id, hand_id, session_id, strftime(date_utc,'%Y-%m-%d %H:%M:%S') AS at, hero_position, hero_stack_start, big_blind, m_ratio, hero_vpip, hero_pfr, hero_result, won_cents FROM b_hands"


def shown(d):
    return d.select("id", "hand_id", "session_id", F.date_format("date_utc", "yyyy-MM-dd HH:mm:ss").alias("at"), *COLS[4:])


@query("s01_csv_round_trip", "S1 K2 S3", uses="hands", sql=ROW)
def _(t):
    path = scratch_path(t.spark, "play")
    sinks.export_table(t.hands.withColumn("date_utc", F.col("date_utc").cast("timestamp")).select(*COLS), path, parquet=False)
    return shown(readers.csv(t.spark, f"{path}/csv", readers.PLAY_SCHEMA))


@query("k02_parquet_round_trip", "K2 K3 S3 D2", uses="hands", sql=ROW)
def _(t):
    path = scratch_path(t.spark, "play")
    sinks.export_table(t.hands.select(*COLS), path, csv=False)
    return shown(readers.play_rows(t.spark, f"{path}/parquet"))


@query("k01_section_export", "K1", uses="hands", sql="SELECT m_zone, hands FROM (SELECT CASE WHEN m_ratio>=20 AND m_ratio<999 THEN 'green' WHEN m_ratio>=10 AND m_ratio<20 THEN 'yellow' WHEN m_ratio>=6 AND m_ratio<10 THEN 'orange' WHEN m_ratio>=0 AND m_ratio<6 THEN 'red' ELSE 'green' END AS m_zone, COUNT(*) AS hands FROM b_hands GROUP BY 1)")
def _(t):
    path = scratch_path(t.spark, "report")
    sinks.export_sections({"by_m_ratio": ps.by_zone(t.hands)}, path)
    return t.spark.read.schema("m_zone string, hands long, vpip_pct double, pfr_pct double, allin_pct double, win_pct double").option("header", True).csv(f"{path}/stats_by_m_ratio").select("m_zone", "hands")


@query("s04_text_scan", "S4 X12 K12", uses="blocks", sql="SELECT 'log_' || user_id AS name, COUNT(*) AS records FROM events GROUP BY 1")
def _(t):
    files = write_logs(t)
    d = readers.with_lineage(readers.record_blocks(t.spark, files), "play-log-1")
    # one text file per writer task; the name inside the text is the record's own file
    d = d.select(F.explode(F.regexp_extract_all("value", F.lit(r"Tournament #(\d+)"), F.lit(1))).alias("n"), "source_path", "content_sha256")
    return d.groupBy(F.concat(F.lit("log_"), F.col("n")).alias("name")).agg(F.count("*").alias("records"))


def write_logs(t):
    """Raw logs as text files, the way a client leaves them in a folder."""
    path = scratch_path(t.spark, "logs")
    t.blocks.select(F.concat("raw", F.lit("\n\n")).alias("value")).write.text(path)
    return path


@query("s05_json_log", "S5 K4 K13 R8", uses="audit", sql="SELECT entry_id, event_type, account_id, CAST(details->>'$.risk_pct' AS INT) AS risk_pct FROM b_audit")
def _(t):
    path = scratch_path(t.spark, "audit")
    sinks.append_log(t.audit.where("event_type = 'prediction'"), path)
    sinks.append_log(t.audit.where("event_type <> 'prediction'"), path)
    d = readers.json_lines(t.spark, path, "entry_id long, event_type string, account_id long, details string")
    return d.select("entry_id", "event_type", "account_id", F.get_json_object("details", "$.risk_pct").cast("int").alias("risk_pct"))


@query("s06_json_documents", "S6 D25", sql="SELECT conv_id, COUNT(*) AS messages FROM conversations GROUP BY 1")
def _(t):
    from tallyfold.functions import vectors as vx

    path = scratch_path(t.spark, "sessions")
    vx.messages_to_sessions(t.conversations).write.json(path)
    d = readers.json_lines(t.spark, path, "conv_id long, segment long, messages array<string>")
    return d.groupBy("conv_id").agg(F.sum(F.size("messages")).alias("messages"))


@query("s06_indented_documents", "S6", sql="""SELECT 'document' AS kind, COUNT(*) AS n, CAST(SUM(m) AS BIGINT) AS messages FROM (SELECT conv_id, COUNT(*) AS m FROM conversations GROUP BY 1) WHERE (conv_id//20)%5<>3
 UNION ALL SELECT 'quarantine', COUNT(DISTINCT conv_id//20), 0 FROM conversations WHERE (conv_id//20)%5=3""")
def _(t):
    """Session files of twenty indented documents each; every fifth file breaks off."""
    path = scratch_path(t.spark, "documents")
    one = t.conversations.groupBy("conv_id").agg(F.count("*").alias("m"))
    doc = F.format_string('{\n  "session_id": %d,\n  "counts": {\n    "messages": %d\n  }\n}', "conv_id", "m")
    files = one.groupBy(F.floor(F.col("conv_id") / 20).alias("file")).agg(F.array_join(F.collect_list(doc), ",\n").alias("docs"))
    text = F.concat(F.lit("[\n"), "docs", F.when(F.col("file") % 5 == 3, "").otherwise("\n]"))
    files.select("file", text.alias("value")).repartition("file").write.partitionBy("file").text(path)
    good, bad = readers.json_documents(t.spark, path, "session_id long, counts struct<messages:long>")
    good = good.agg(F.lit("document").alias("kind"), F.count("*").alias("n"), F.sum("counts.messages").alias("messages"))
    return good.unionByName(bad.agg(F.lit("quarantine").alias("kind"), F.count("*").alias("n"), F.lit(0).cast("long").alias("messages")))


@query("s08_recent_history", "S8 P7", sql="SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-24'")
def _(t):
    return readers.recent(t.events, "ts", "2024-01-31", 7).select("event_id")


@query("s09_profile_join", "S9", uses="accounts", sql="SELECT account_id, segment, CASE WHEN account_id%2=0 THEN 'healthy' END AS profile FROM b_accounts")
def _(t):
    prof = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("account_id"), F.lit("healthy").alias("profile"))
    return readers.with_profiles(t.accounts, prof).select("account_id", "segment", "profile")


@query("p16_aligned_schema", "P16 D4", uses="hands", sql="SELECT id, 0.0::DOUBLE AS ante, 'UNKNOWN' AS site_name, hero_vpip::DOUBLE AS hero_vpip FROM b_hands")
def _(t):
    return readers.align(t.hands, {"id": ("long", 0), "ante": ("double", 0.0), "site_name": ("string", "UNKNOWN"), "hero_vpip": ("double", 0.0)})


# ---- upserts over line items: the key repeats, as in re-ingested logs ----


@query("k05_insert_ignore", "K5 J16", sql="""SELECT key, v FROM (SELECT o_orderkey AS key, 0.0::DOUBLE AS v FROM orders WHERE o_orderkey%2=0 UNION ALL SELECT l_orderkey, MIN(l_quantity) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey%2=0) GROUP BY 1)""")
def _(t):
    target = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key"), F.lit(0.0).alias("v"))
    return sinks.insert_missing(target, t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("v")), ["key"])


@query("k06_insert_update", "K6", sql="""SELECT coalesce(o.o_orderkey,n.k) AS key, coalesce(o.o_orderstatus,'NEW') AS status, CASE WHEN n.k IS NOT NULL THEN n.q ELSE o.o_totalprice END AS total FROM (SELECT * FROM orders WHERE o_orderkey%3=0) o FULL JOIN (SELECT l_orderkey AS k, SUM(CAST(l_quantity AS BIGINT))::DOUBLE AS q FROM lineitem GROUP BY 1) n ON n.k=o.o_orderkey""")
def _(t):
    target = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    new = t.lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("total")).withColumn("status", F.lit("NEW"))
    return sinks.upsert(target, new, ["key"], ["total"])


@query("k07_replace_children", "K7", sql="""SELECT parent, n FROM (SELECT l_orderkey AS parent, COUNT(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus='F') GROUP BY 1 UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderstatus='F')""")
def _(t):
    target = t.lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("child"))
    new = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("parent"), F.lit(0).alias("child"))
    return sinks.replace_children(target, new, "parent").groupBy("parent").agg(F.count("*").alias("n"))


@query("k06_session_upsert_version", "K6 K3 K10 D1", uses="hands sessions", sql="SELECT source_file, COUNT(*) AS hands_count FROM b_hands GROUP BY 1")
def _(t):
    base = scratch_path(t.spark, "sessions")
    p1 = sinks.write_version(ps.file_rollup(t.hands.where("hand_date < DATE '2024-01-15'")), base, 1)
    new = ps.file_rollup(t.hands)
    p2 = sinks.write_version(sinks.upsert(t.spark.read.parquet(p1), new, ["source_file"], ["hands_count", "hands_won", "net_cents"]), base, 2)
    return t.spark.read.parquet(p2).select("source_file", "hands_count")


# ---- text parsing ----

BLOCK = """bl AS (SELECT *, 1+event_id%4 AS btn, 50*(1+event_id%4) AS sb, 2*50*(1+event_id%4) AS bb FROM events WHERE event_id%41<>0),
 pr AS (SELECT *, CASE (2-btn+4)%4 WHEN 0 THEN 'BTN' WHEN 1 THEN 'SB' WHEN 2 THEN 'BB' ELSE 'UTG' END AS pos, CASE event_type WHEN 'view' THEN 'folds' WHEN 'click' THEN 'calls 200' WHEN 'purchase' THEN 'raises 600' WHEN 'signup' THEN 'raises 1800 (all-in)' ELSE 'checks' END AS pf,
  CASE WHEN event_type='view' THEN '' ELSE CASE event_id%3 WHEN 0 THEN 'bets 300.50' WHEN 1 THEN 'checks' ELSE 'folds' END END AS fl, value>60 AND event_type<>'view' AS wins FROM bl)"""


@query("x08_log_parsing", "X8 X11 M26 M27 D4 B8", uses="", ctes=BLOCK, sql="""SELECT CAST(event_id AS VARCHAR) AS hand_id, CAST(user_id AS VARCHAR) AS tournament_id, CAST(1+event_id%9 AS INT) AS level, sb::DOUBLE AS small_blind, bb::DOUBLE AS big_blind, strftime(ts,'2024-01-%d 10:20:30') AS at, CAST(btn AS INT) AS btn_seat, 4 AS num_players, 2 AS hero_seat,
 (2000+event_id%900)::DOUBLE AS hero_stack_start, pos AS hero_position, 10.0::DOUBLE AS ante, pf AS hero_action_preflop, fl AS hero_action_flop, CASE WHEN event_type IN ('click','purchase','signup') THEN 1 ELSE 0 END AS hero_vpip, CASE WHEN event_type IN ('purchase','signup') THEN 1 ELSE 0 END AS hero_pfr,
 CASE WHEN event_type IN ('purchase','signup') OR fl LIKE 'bets%' THEN 1 ELSE 0 END AS hero_aggressor, CASE WHEN event_type='signup' THEN 1 ELSE 0 END AS hero_went_allin, CASE WHEN event_type IN ('purchase','signup') THEN 1 ELSE 0 END AS went_to_showdown, (500+event_id%250)::DOUBLE AS pot_final,
 CASE WHEN wins THEN 'win' WHEN event_type IN ('purchase','signup') THEN (CASE WHEN event_type='signup' THEN 'allin_loss' ELSE 'loss' END) ELSE 'fold' END AS hero_result, CASE WHEN wins THEN (100+event_id%77)::DOUBLE ELSE -(10.0::DOUBLE+CASE pos WHEN 'SB' THEN sb WHEN 'BB' THEN bb ELSE 0 END) END AS hero_amount_won,
 ROUND((2000+event_id%900)/(bb+sb+40.0::DOUBLE),2) AS m_ratio FROM pr""")
def _(t):
    files = t.blocks.select(F.col("raw").alias("value"), "file_name")
    d = pl.parse_records(pl.split_blocks(files), "Hero")
    return d.select("hand_id", "tournament_id", "level", "small_blind", "big_blind", F.date_format("date_utc", "yyyy-MM-dd HH:mm:ss").alias("at"), "btn_seat", "num_players", "hero_seat", "hero_stack_start", "hero_position", "ante",
                    "hero_action_preflop", "hero_action_flop", "hero_vpip", "hero_pfr", "hero_aggressor", "hero_went_allin", "went_to_showdown", "pot_final", "hero_result", "hero_amount_won", "m_ratio")


LINES = """ln AS (SELECT event_id, sb, bb, unnest([struct_pack(o:=1,actor:='Cid',street:='PREFLOP',v:='FOLD',amt:=0.0::DOUBLE),
  struct_pack(o:=2,actor:='Hero',street:='PREFLOP',v:=CASE event_type WHEN 'view' THEN 'FOLD' WHEN 'click' THEN 'CALL' WHEN 'purchase' THEN 'RAISE' WHEN 'signup' THEN 'RAISE' ELSE 'CHECK' END,amt:=CASE event_type WHEN 'click' THEN 200.0::DOUBLE WHEN 'purchase' THEN 600.0 WHEN 'signup' THEN 1800.0 ELSE 0.0 END),
  struct_pack(o:=3,actor:='Ann',street:='PREFLOP',v:='CALL',amt:=200.0::DOUBLE), struct_pack(o:=4,actor:='Ann',street:='FLOP',v:='CHECK',amt:=0.0::DOUBLE),
  struct_pack(o:=5,actor:='Hero',street:='FLOP',v:=CASE event_id%3 WHEN 0 THEN 'BET' WHEN 1 THEN 'CHECK' ELSE 'FOLD' END,amt:=CASE event_id%3 WHEN 0 THEN 300.5::DOUBLE ELSE 0.0 END), struct_pack(o:=6,actor:='Ann',street:='FLOP',v:='CALL',amt:=300.5::DOUBLE)]) AS s, event_type FROM (SELECT *, 50*(1+event_id%4) AS sb, 2*50*(1+event_id%4) AS bb FROM events)),
 la AS (SELECT event_id, s.o AS o, s.actor AS actor, s.street AS street, s.v AS v, s.amt AS amt, sb+bb+20 AS pot0, event_type FROM ln WHERE s.o<=3 OR event_type<>'view')"""


@query("x09_log_actions", "X9 X10 W12 W13 W14 D3", uses="", ctes=LINES, sql="""SELECT CAST(event_id AS VARCHAR) AS hand_id, CAST(o AS INT) AS action_order, street, actor AS actor_id, v AS action_type, amt AS amount, pot0+coalesce(SUM(amt) OVER (PARTITION BY event_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS pot_size_before, o=2 AND event_type='signup' AS is_all_in FROM la""")
def _(t):
    b = pl.split_blocks(t.blocks.select(F.col("raw").alias("value"), "file_name")).withColumn("hand_id", F.regexp_extract("raw", r"Game Hand #(\d+)", 1))
    return pl.block_actions(b, "hand_id")


@query("x10_amounts", "X10", sql="SELECT event_id, CASE event_id%4 WHEN 0 THEN event_id+0.5::DOUBLE WHEN 1 THEN (1000+event_id%1000)::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE event_id::DOUBLE END AS amount FROM events")
def _(t):
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, F.concat(i.cast("string"), F.lit(",5"))).when(i % 4 == 1, F.concat(F.lit("$1,"), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit(".00"))).when(i % 4 == 2, "abc").otherwise(i.cast("string"))
    return t.events.select("event_id", pl.amount(raw).alias("amount"))


@query("x11_site_and_name", "X11 X12", uses="hands", sql="SELECT id, CASE WHEN source_file LIKE 'ACR%' THEN 'acr' ELSE 'ps' END AS site, source_file AS name FROM b_hands")
def _(t):
    text = F.when(F.col("source_file").startswith("ACR"), F.lit("Game Hand #1 x")).otherwise("PokerStars Hand #1 x")
    return t.hands.select("id", pl.site_of(text).alias("site"), pl.name_from_path(F.concat(F.lit("s3a://b/in/"), "source_file", F.lit(".txt"))).alias("name"))


@query("b08_backfill", "B8 K6 K7 S4", uses="", ctes=LINES, sql="SELECT actor AS actor_id, CASE WHEN event_id%2=0 THEN v ELSE 'OLD' END AS action_type, COUNT(*) AS n FROM la GROUP BY 1,2")
def _(t):
    files = readers.record_blocks(t.spark, write_logs(t))
    b = pl.split_blocks(files).withColumn("hand_id", F.regexp_extract("raw", r"Game Hand #(\d+)", 1))
    acts = pl.block_actions(b, "hand_id")
    old = acts.withColumn("action_type", F.lit("OLD"))  # what an earlier run stored for every record
    acts = acts.where("CAST(hand_id AS BIGINT) % 2 = 0")
    return sinks.replace_children(old, acts, "hand_id").groupBy("actor_id", "action_type").agg(F.count("*").alias("n"))


# ---- upserts that rewrite only the buckets they touch ----

BUCKETS = 32


@query("k06_bucketed_upsert", "K6 K5", sql="""SELECT coalesce(o.o_orderkey,n.k) AS key, coalesce(o.o_orderstatus,'NEW') AS status, CASE WHEN n.k IS NOT NULL THEN n.q ELSE o.o_totalprice END AS total
 FROM (SELECT * FROM orders WHERE o_orderkey%3=0) o FULL JOIN (SELECT l_orderkey AS k, CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS q FROM lineitem GROUP BY 1) n ON o.o_orderkey=n.k""")
def _(t):
    path = scratch_path(t.spark, "bucketed")
    bucketed.create(t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total")), path, ["key"], BUCKETS)
    new = t.lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("total")).withColumn("status", F.lit("NEW"))
    bucketed.upsert(t.spark, path, new, ["total"])
    return bucketed.read(t.spark, path)


@query("b08_bucketed_backfill", "B8 K7 S4", uses="", ctes=LINES, sql="SELECT actor AS actor_id, CASE WHEN event_id%2=0 THEN v ELSE 'OLD' END AS action_type, COUNT(*) AS n FROM la WHERE event_id%6<>0 GROUP BY 1,2")
def _(t):
    """Stored actions of all records; a backfill brings half of them again, a third of those without any action."""
    files = readers.record_blocks(t.spark, write_logs(t))
    b = pl.split_blocks(files).withColumn("hand_id", F.regexp_extract("raw", r"Game Hand #(\d+)", 1))
    acts = written(pl.block_actions(b, "hand_id"), "actions")  # stored and brought again
    path = scratch_path(t.spark, "bucketed-actions")
    bucketed.create(acts.withColumn("action_type", F.lit("OLD")), path, ["hand_id"], BUCKETS)
    even = F.col("hand_id").cast("long") % 2 == 0
    none = F.col("hand_id").cast("long") % 6 == 0
    bucketed.replace_children(t.spark, path, acts.where(even & ~none), b.where(none))
    return bucketed.read(t.spark, path).groupBy("actor_id", "action_type").agg(F.count("*").alias("n"))


@query("r01_file_versions", "R1 S10 K6 K7", uses="", ctes=LINES, sql="""SELECT actor_id, action_type, COUNT(*) AS n FROM (SELECT actor AS actor_id, CASE WHEN actor='Cid' AND event_id%5=0 THEN 'CHECK' ELSE v END AS action_type FROM la WHERE event_id%3<>0
 UNION ALL SELECT unnest(['Ana','Hero','Rui']), unnest(['CALL','RAISE','FOLD']) FROM events WHERE event_id%3=0) GROUP BY 1,2""")
def _(t):
    """Logs of both dialects are read; then a fifth of the records of one come again in changed form."""
    path, base = scratch_path(t.spark, "log-folder"), scratch_path(t.spark, "log-tables")
    own = t.blocks.select(F.concat("raw", F.lit("\n\n")).alias("value"), F.col("block_id").alias("n"))
    other = t.events.where("event_id % 3 = 0").select(F.concat(
        F.lit("M\u00e3o PokerStars #"), F.col("event_id"), F.lit(": Torneio #"), F.col("user_id"), F.lit("\nAna: iguala $200\nHero: aumenta $200 para $600\n*** FLOP *** [Ah]\nRui: desiste\n*** RESUMO ***\nAna: aposta $9\n\n")).alias("value"))
    own.where("n % 3 <> 0").select("value").write.text(f"{path}/acr")
    other.write.text(f"{path}/ps")
    file_versions.poll(t.spark, path, "Hero", base)
    own.where("n % 3 <> 0 AND n % 5 = 0").select(F.replace("value", F.lit("Cid folds"), F.lit("Cid checks")).alias("value")).write.text(f"{path}/again")
    file_versions.poll(t.spark, path, "Hero", base)
    return file_versions.ingested(t.spark, base).actions.groupBy("actor_id", "action_type").agg(F.count("*").alias("n"))


@query("p23_row_isolation", "P23", uses="blocks", sql="SELECT CASE WHEN event_id%41=0 THEN 'quarantine' ELSE 'good' END AS kind, COUNT(*) AS n FROM events GROUP BY 1")
def _(t):
    files = t.blocks.select(F.col("raw").alias("value"), "block_id")
    blocks = pl.split_blocks(files)
    good = pl.parse_records(blocks, "Hero").select("block_id")
    bad = blocks.join(good, "block_id", "left_anti").select("block_id")
    return good.agg(F.lit("good").alias("kind"), F.count("*").alias("n")).unionByName(bad.agg(F.lit("quarantine").alias("kind"), F.count("*").alias("n")))


@query("k08_scored_export", "K8 B4", uses="predictions", sql="SELECT risk_level, COUNT(*) AS n FROM b_predictions GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "scored")
    sinks.export_table(t.predictions.select("account_id", "risk_pct", "risk_level", "upsell_pct"), path, parquet=False)
    d = t.spark.read.schema("account_id long, risk_pct int, risk_level string, upsell_pct int").option("header", True).csv(f"{path}/csv")
    return d.groupBy("risk_level").agg(F.count("*").alias("n"))


