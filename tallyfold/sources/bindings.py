"""Play-history and account tables derived from the supplied tables.

Each derived table is a list of (column, expression). The expressions use only syntax
that Spark SQL and ANSI engines share, so the same text gives the oracle its input rows;
what is computed on top of them is written separately on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RANKS_UP = "'23456789TJQKA'"
SUITS = "'hdcs'"


def _card(rank_expr: str, suit_expr: str, ranks: str = RANKS_UP) -> str:
    return (
        f"substr({ranks}, CAST(1 + ({rank_expr}) % 13 AS INT), 1) || "
        f"substr({SUITS}, CAST(1 + ({suit_expr}) % 4 AS INT), 1)"
    )


BLIND = "CASE event_id % 5 WHEN 0 THEN 50 WHEN 1 THEN 100 WHEN 2 THEN 200 WHEN 3 THEN 400 ELSE {z} END"
HANDS = [
    ("id", "event_id"),
    ("hand_id", "'H' || CAST(event_id AS STRING)"),
    ("session_id", "user_id*100 + CAST(day(ts) AS BIGINT)"),
    ("hero_id", "user_id"),
    ("date_utc", "ts"),
    ("hand_date", "CAST(ts AS DATE)"),
    ("hero_position", "CASE event_id % 8 WHEN 0 THEN 'UTG' WHEN 1 THEN 'UTG+1' WHEN 2 THEN 'MP' WHEN 3 THEN 'HJ' "
                      "WHEN 4 THEN 'CO' WHEN 5 THEN 'BTN' WHEN 6 THEN 'SB' ELSE 'BB' END"),
    ("big_blind", f"CAST({BLIND.format(z=0)} AS BIGINT)"),
    ("hero_stack_start", f"CAST({BLIND.format(z=100)} AS BIGINT) * (2 + (event_id*37) % 70)"),
    ("m_ratio", "CAST(2 + (event_id*37) % 70 AS DOUBLE) / 2"),
    ("hero_vpip", "CASE WHEN event_type IN ('click','purchase','signup') THEN 1 ELSE 0 END"),
    ("hero_pfr", "CASE WHEN event_type IN ('purchase','signup') THEN 1 ELSE 0 END"),
    ("hero_aggressor", "CASE WHEN event_type IN ('purchase','signup') OR event_id % 3 = 0 THEN 1 ELSE 0 END"),
    ("hero_went_allin", "CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END"),
    ("went_to_showdown", "CASE WHEN event_type = 'error' OR event_id % 4 = 0 THEN 1 ELSE 0 END"),
    ("hero_result", "CASE WHEN event_type = 'view' THEN 'fold' WHEN value > 60 THEN 'win' "
                    "WHEN event_type = 'signup' THEN 'allin_loss' ELSE 'loss' END"),
    ("won_cents", "CAST(ROUND(value*100) AS BIGINT) * (CASE WHEN event_type <> 'view' AND value > 60 THEN 1 ELSE -1 END)"),
    ("hero_action_preflop", "CASE event_type WHEN 'view' THEN 'folds' WHEN 'click' THEN 'calls 200' "
                            "WHEN 'purchase' THEN 'raises 600' WHEN 'signup' THEN 'raises 600 → raises 1800 (all-in)' ELSE 'checks' END"),
    ("hero_action_flop", "CASE event_id % 3 WHEN 0 THEN 'bets 300' WHEN 1 THEN 'checks' ELSE '' END"),
    ("hero_action_turn", "CASE event_id % 4 WHEN 0 THEN 'checks → folds' WHEN 1 THEN 'bets 500' ELSE '' END"),
    ("hero_action_river", "CASE event_id % 6 WHEN 0 THEN 'bets 900' WHEN 1 THEN 'folds' ELSE '' END"),
    ("board_flop", " || ' ' || ".join([_card("event_id", "event_id"), _card("event_id*3", "event_id*3"), _card("event_id*5", "event_id*7")])),
    ("hero_cards", _card("event_id", "event_id", "'AKQJT98765432'") + " || ' ' || " + _card("event_id*11", "event_id*5 + 1", "'AKQJT98765432'")),
    ("source_file", "CASE WHEN event_id % 2 = 0 THEN 'ACR_' ELSE 'PokerStars_' END || CAST(user_id AS STRING)"),
]

# Further play columns, so that every detector and classification has something to read.
SPOTS = [
    *[(n, "CASE WHEN event_id % 17 = 0 THEN '3BET 900 → folds' WHEN event_id % 19 = 0 THEN '4BET 2200' "
          "WHEN event_id % 7 = 0 THEN 'calls 400 → calls 900 (all-in)' WHEN event_id % 8 = 7 AND event_id % 5 < 3 THEN 'folds' ELSE " + e + " END") if n == "hero_action_preflop" else (n, e)
      for n, e in HANDS],
    ("board_turn", _card("event_id*9", "event_id*3 + 2")),
    ("site_name", "CASE event_id % 3 WHEN 0 THEN 'acr' WHEN 1 THEN 'stars' END"),
    ("tournament_name", "'T' || CAST(user_id % 20 AS STRING)"),
    ("hero_name", "CASE user_id % 3 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' ELSE 'Gamma' END"),
    ("villain_id", "CASE WHEN event_id % 11 <> 0 THEN 'V' || CAST((event_id*7) % 23 AS STRING) END"),
    ("villain_vpip", "CASE WHEN event_id % 9 <> 0 THEN ((event_id*13) % 60) / 100.0E0 END"),
    ("villain_pfr", "CASE WHEN event_id % 9 <> 0 THEN ((event_id*7) % 40) / 100.0E0 END"),
    ("villain_aggression", "CASE WHEN event_id % 9 <> 0 THEN ((event_id*11) % 90) / 100.0E0 END"),
    ("villain_fold_to_3bet", "CASE WHEN event_id % 9 <> 0 THEN ((event_id*17) % 80) / 100.0E0 END"),
    ("villain_wtsd", "CASE WHEN event_id % 9 <> 0 THEN ((event_id*19) % 50) / 100.0E0 END"),
    ("decision_time_ms", "CASE WHEN event_id % 13 <> 0 THEN (event_id*7919) % (CASE WHEN event_id % 8 < 3 THEN 2000 ELSE 14000 END) END"),
    ("bet_size", "CASE WHEN event_id % 40 <> 0 THEN (event_id*31) % 900 END"),
    ("num_players", "2 + event_id % 8"),
    ("ante", "CASE event_id % 5 WHEN 4 THEN 0 ELSE 10 END"),
    ("level", "1 + event_id % 60"),
]

SESSIONS = """SELECT session_id, MIN(hero_id) AS hero_id, MIN(source_file) AS source_file, MAX(date_utc) AS ingested_at,
  COUNT(*) AS hands_count, CAST(SUM(CASE WHEN hero_result = 'win' THEN 1 ELSE 0 END) AS BIGINT) AS hands_won,
  CAST(SUM(won_cents) AS BIGINT) AS net_cents FROM b_hands GROUP BY session_id"""

ACCOUNTS = """SELECT c_custkey AS account_id, CASE c_mktsegment WHEN 'MACHINERY' THEN 'ENTERPRISE' WHEN 'BUILDING' THEN 'MID_MARKET'
  WHEN 'AUTOMOBILE' THEN 'MID_MARKET' ELSE 'SMB' END AS segment, CAST(ROUND(c_acctbal*100) AS BIGINT) + 100000 AS mrr_cents,
  1 + c_custkey % 200 AS max_users, n_name AS csm_name, CAST(30 + (c_custkey*13) % 700 AS INT) AS dias_no_contrato
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""

INTERACTIONS = """SELECT user_id AS account_id, CAST(ts AS DATE) AS event_date,
  CAST(SUM(CASE WHEN event_type IN ('click','view') THEN 1 ELSE 0 END) AS BIGINT) AS logins_count,
  COUNT(DISTINCT event_type) AS active_users, CAST(SUM(CASE WHEN event_type='error' THEN 1 ELSE 0 END) AS BIGINT) AS tickets_open,
  MAX(CASE WHEN event_id % 5 = 0 THEN 1 + CAST(FLOOR(event_id / 5.0E0) AS BIGINT) % 10 END) AS nps_score
  FROM events GROUP BY user_id, CAST(ts AS DATE)"""

FEATURES = """SELECT a.account_id, a.segment, a.mrr_cents, a.max_users, a.csm_name, a.dias_no_contrato,
  CAST(COALESCE(i.login_days_r,0) AS BIGINT) AS login_days_r, CAST(COALESCE(i.login_days_p,0) AS BIGINT) AS login_days_p,
  CAST(COALESCE(i.tickets_r,0) AS BIGINT) AS tickets_r, CAST(COALESCE(i.tickets_p,0) AS BIGINT) AS tickets_p,
  COALESCE(i.nps_r, 5.0E0) AS nps_r, COALESCE(i.nps_p, 5.0E0) AS nps_p, COALESCE(datediff_days, 15) AS dias_sem_interacao
 FROM b_accounts a LEFT JOIN (
  SELECT account_id,
   SUM(CASE WHEN event_date > DATE '2024-01-16' AND logins_count > 0 THEN 1 ELSE 0 END) AS login_days_r,
   SUM(CASE WHEN event_date <= DATE '2024-01-16' AND logins_count > 0 THEN 1 ELSE 0 END) AS login_days_p,
   SUM(CASE WHEN event_date > DATE '2024-01-16' THEN tickets_open ELSE 0 END) AS tickets_r,
   SUM(CASE WHEN event_date <= DATE '2024-01-16' THEN tickets_open ELSE 0 END) AS tickets_p,
   AVG(CASE WHEN event_date > DATE '2024-01-16' THEN nps_score END) AS nps_r,
   AVG(CASE WHEN event_date <= DATE '2024-01-16' THEN nps_score END) AS nps_p,
   31 - MAX(CASE WHEN event_date > DATE '2024-01-16' THEN CAST(day(event_date) AS INT) END) AS datediff_days
  FROM b_interactions GROUP BY account_id) i ON a.account_id = i.account_id"""

# Scores on 0..100 spread over every rule band; shares are score/100.
PREDICTIONS = """SELECT account_id, segment, mrr_cents, dias_no_contrato, dias_sem_interacao, tickets_r AS tickets_abertos,
  nps_r AS nps_score, login_days_r*100/15.0E0 AS engajamento_pct, csm_name,
  (account_id*37) % 101 AS risk_pct, CASE WHEN (account_id*37) % 101 > 70 THEN 'HIGH' WHEN (account_id*37) % 101 > 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  (account_id*53) % 101 AS upsell_pct, CASE WHEN account_id % 3 = 0 THEN CAST(account_id % 11 - 8 AS INT) END AS trend_delta,
  mrr_cents * ((account_id*37) % 101) AS mrr_at_risk_pc FROM b_features"""

# Audit log over the events stream: predictions, interventions and drift notes with JSON details.
AUDIT = """SELECT event_id AS entry_id, ts AS logged_at, user_id*100 + CAST(day(ts) AS BIGINT) AS session_id, user_id AS account_id,
  CASE event_type WHEN 'view' THEN 'prediction' WHEN 'click' THEN 'prediction' WHEN 'purchase' THEN 'intervention'
   WHEN 'signup' THEN 'drift' ELSE 'recommendation' END AS event_type,
  '{"risk_pct":' || CAST((event_id*37) % 101 AS STRING) || ',"risk_level":"' ||
   CASE WHEN (event_id*37) % 101 > 70 THEN 'HIGH' WHEN (event_id*37) % 101 > 40 THEN 'MEDIUM' ELSE 'LOW' END ||
   '","mrr_at_risk_cents":' || CAST(CAST(ROUND(value*100) AS BIGINT) AS STRING) ||
   ',"actions":"' || CASE event_id % 3 WHEN 0 THEN 'SEND_EMAIL' WHEN 1 THEN 'CREATE_CRM_TASK|SCHEDULE_CALL' ELSE 'MONITOR_ONLY' END ||
   '","channels":"' || CASE event_id % 4 WHEN 0 THEN 'console' WHEN 1 THEN 'console|file' WHEN 2 THEN 'console|email' ELSE 'console|slack' END ||
   '","ok":"' || CASE event_id % 5 WHEN 0 THEN '1|0' WHEN 1 THEN '0' ELSE '1|1' END || '"}' AS details
  FROM events"""

FEEDBACK = """SELECT event_id AS feedback_id, 'C' || CAST(event_id % 997 AS STRING) AS correlation_id, user_id AS account_id,
  CASE event_type WHEN 'view' THEN 'NO_RESPONSE' WHEN 'click' THEN 'CUSTOMER_RESPONDED' WHEN 'purchase' THEN 'RENEWAL_HAPPENED'
   WHEN 'signup' THEN 'UPSELL_CLOSED' ELSE 'CHURN_HAPPENED' END AS outcome, ts AS recorded_at, value AS churn_risk_after
  FROM events"""

# Request lines as a socket client would send them, including malformed ones and SET commands.
REQUESTS = """SELECT event_id AS request_id, ts AS received_at, user_id AS session_id,
  CAST(ROUND(value*100) AS BIGINT) AS latency_us,
  CASE WHEN event_id % 23 = 0 THEN 'SET BB=' || CAST(100*(1 + event_id % 7) AS STRING) || ' ANTE=' || CAST(event_id % 50 AS STRING)
   WHEN event_id % 29 = 0 THEN 'SET OPEN=2.5 COLOR=9' WHEN event_id % 31 = 0 THEN 'AKs BTN 2.5' WHEN event_id % 37 = 0 THEN 'AKs BTN x 40 N'
   WHEN event_id % 41 = 0 THEN 'QQ CO 2.5 0 N' WHEN event_id % 43 = 0 THEN 'QQ CO 2.5 40 maybe'
   WHEN event_id % 47 = 0 THEN 'QQ CO 2 8 N Ah Kd' WHEN event_id % 53 = 0 THEN 'QQ CO 2 8 N Ah Kd Ah' WHEN event_id % 59 = 0 THEN 'QQ CO -1 20 N'
   ELSE CASE WHEN event_id % 13 = 0 THEN 'REVIEW ' ELSE '' END ||
    substr('AKQJT98765432', CAST(1 + event_id % 13 AS INT), 1) || substr('hdcs', CAST(1 + event_id % 4 AS INT), 1) ||
    substr('AKQJT98765432', CAST(1 + (event_id*11) % 13 AS INT), 1) || substr('hdcs', CAST(1 + (event_id*5 + 1) % 4 AS INT), 1) || ' ' ||
    CASE event_id % 7 WHEN 0 THEN 'utg' WHEN 1 THEN 'LJ' WHEN 2 THEN 'HJ' WHEN 3 THEN 'CO' WHEN 4 THEN 'BTN' WHEN 5 THEN 'SB' ELSE 'BB' END || ' ' ||
    CASE event_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '2.5' ELSE '9' END || ' ' || CAST(3 + (event_id*37) % 97 AS STRING) || ' ' ||
    CASE WHEN event_id % 2 = 0 THEN 'N' ELSE 'y' END ||
    CASE WHEN event_id % 3 = 2 THEN ' 3BET' WHEN event_id % 10 = 0 THEN ' 2h 7d Jc' ELSE '' END END AS line
  FROM events"""

LOG_VERB = "CASE event_type WHEN 'view' THEN 'folds' WHEN 'click' THEN 'calls 200' WHEN 'purchase' THEN 'raises 400 to 600' WHEN 'signup' THEN 'raises 1200 to 1800 and is all-in' ELSE 'checks' END"

# One raw text block per record in the log dialect the parser reads.
LOG_BLOCKS = f"""SELECT event_id AS block_id, 'log_' || CAST(user_id AS STRING) || '.txt' AS file_name,
  'Game Hand #' || CAST(event_id AS STRING) || ' - Tournament #' || CAST(user_id AS STRING) || ' - Holdem(No Limit) - Level ' || CAST(1 + event_id % 9 AS STRING) ||
  ' (' || CAST(50*(1 + event_id % 4) AS STRING) || '.00/' || CAST(100*(1 + event_id % 4) AS STRING) || '.00) - 2024/01/' || lpad(CAST(day(ts) AS STRING), 2, '0') || ' 10:20:30 UTC' || chr(10) ||
  'Table ''T ' || CAST(user_id AS STRING) || ''' 6-max Seat #' || CAST(1 + event_id % 4 AS STRING) || ' is the button' || chr(10) ||
  'Seat 1: Ann (' || CAST(1000 + event_id % 500 AS STRING) || '.00)' || chr(10) || 'Seat 2: Hero (' || CAST(2000 + event_id % 900 AS STRING) || '.00)' || chr(10) ||
  'Seat 3: Bob (1500.00)' || chr(10) || 'Seat 4: Cid (1800.50)' || chr(10) ||
  'Ann posts ante 10.00' || chr(10) || 'Hero posts ante 10.00' || chr(10) || 'Ann posts the small blind ' || CAST(50*(1 + event_id % 4) AS STRING) || '.00' || chr(10) ||
  'Bob posts the big blind ' || CAST(100*(1 + event_id % 4) AS STRING) || '.00' || chr(10) || '*** HOLE CARDS ***' || chr(10) ||
  CASE WHEN event_id % 41 = 0 THEN '' ELSE 'Dealt to Hero [' || {_card("event_id", "event_id", "'AKQJT98765432'")} || ' ' || {_card("event_id*11", "event_id*5 + 1", "'AKQJT98765432'")} || ']' || chr(10) END ||
  'Cid folds' || chr(10) || 'Hero ' || {LOG_VERB} || chr(10) || 'Ann calls 200' || chr(10) ||
  CASE WHEN event_type = 'view' THEN '' ELSE '*** FLOP *** [' || {_card("event_id", "event_id")} || ' ' || {_card("event_id*3", "event_id*3")} || ' ' || {_card("event_id*5", "event_id*7")} || ']' || chr(10) ||
   'Ann checks' || chr(10) || 'Hero ' || CASE event_id % 3 WHEN 0 THEN 'bets 300.50' WHEN 1 THEN 'checks' ELSE 'folds' END || chr(10) || 'Ann calls 300.50' || chr(10) END ||
  CASE WHEN event_type IN ('purchase','signup') THEN '*** SHOW DOWN ***' || chr(10) ELSE '' END ||
  CASE WHEN value > 60 AND event_type <> 'view' THEN 'Hero collected ' || CAST(100 + event_id % 77 AS STRING) || '.00 from main pot' || chr(10) ELSE '' END ||
  '*** SUMMARY ***' || chr(10) || 'Total pot ' || CAST(500 + event_id % 250 AS STRING) || '.00' || chr(10) ||
  CASE WHEN event_type IN ('purchase','signup') AND value <= 60 THEN 'Seat 2: Hero showed [Ah Kd] and lost' || chr(10) ELSE '' END || 'Hero calls 999' AS raw
 FROM events"""

SQL_TABLES = {
    "b_sessions": (SESSIONS, ["b_hands"]),
    "b_accounts": (ACCOUNTS, ["customer", "nation"]),
    "b_interactions": (INTERACTIONS, ["events"]),
    "b_features": (FEATURES, ["b_accounts", "b_interactions"]),
    "b_predictions": (PREDICTIONS, ["b_features"]),
    "b_audit": (AUDIT, ["events"]),
    "b_feedback": (FEEDBACK, ["events"]),
    "b_requests": (REQUESTS, ["events"]),
    "b_blocks": (LOG_BLOCKS, ["events"]),
}
EXPR_TABLES = {"b_hands": HANDS, "b_spots": SPOTS}


# Derived tables whose consumers do heavy per-row text work.
HEAVY = {"b_spots", "b_blocks", "b_requests", "documents"}


def spread(df: DataFrame) -> DataFrame:
    """On a local master, use every core where a scan has fewer splits than cores; on a cluster a scan is left as it is."""
    if not df.sparkSession.sparkContext.master.startswith("local["):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, or a derived one built from them."""
    if name in EXPR_TABLES:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        if name in HEAVY:
            events = spread(events)
        return events.selectExpr(*[f"{e} AS {n}" for n, e in EXPR_TABLES[name]])
    if name in SQL_TABLES:
        text, needs = SQL_TABLES[name]
        used = {}
        for need in sorted(needs, key=len, reverse=True):
            used[need] = table(spark, sf_dir, need)
            if name in HEAVY:
                used[need] = spread(used[need])
        return spark.sql(_bind(text, needs), **used)
    plain = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(plain) if name in HEAVY else plain


def _bind(text: str, needs: list[str]) -> str:
    """Mark the FROM/JOIN inputs so Spark binds them to DataFrames."""
    out = text.replace("{", "{{").replace("}", "}}")
    for need in needs:
        for word in ("FROM", "JOIN"):
            out = out.replace(f"{word} {need}", f"{word} {{{need}}}")
    return out


def with_clause(*names: str) -> str:
    """The same derived tables as common table expressions for an SQL oracle."""
    done: dict[str, str] = {}

    def add(n: str) -> None:
        if n in done:
            return
        if n in EXPR_TABLES:
            done[n] = "SELECT " + ", ".join(f"{e} AS {k}" for k, e in EXPR_TABLES[n]) + " FROM events"
        elif n in SQL_TABLES:
            text, needs = SQL_TABLES[n]
            for need in needs:
                add(need)
            done[n] = text

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in done.items()) if done else ""


def shares(predictions: DataFrame) -> DataFrame:
    """Scored contexts with probabilities and money in units, as the policy rules read them."""
    return predictions.select(
        "*",
        (F.col("risk_pct") / 100.0).alias("churn_risk"),
        (F.col("upsell_pct") / 100.0).alias("upsell_probability"),
        (F.col("mrr_cents") / 100.0).alias("mrr"),
    )
