"""Request-log scoring: tokenise lines, apply session settings, decide, colour, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyfold.functions import cards, play
from tallyfold.operators.scan import carry_forward
from tallyfold.plans import decisions

SETTINGS = {"sb": ("SB", "SMALL_BLIND"), "bb": ("BB", "BIG_BLIND"), "ante": ("ANTE",), "open_mult": ("OPEN", "OPEN_MULT", "OPEN_SIZE")}
CARD = r"^[2-9TJQKAtjqka][hdcsHDCS]$"


def _tok(tokens: Column, i: int) -> Column:
    return F.coalesce(F.try_element_at(tokens, F.lit(i)), F.lit(""))


def tokenise(requests: DataFrame) -> DataFrame:
    """One typed row per request line; ``error`` names the first check that failed."""
    raw = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    head = F.upper(F.coalesce(F.try_element_at(raw, F.lit(1)), F.lit("")))
    d = requests.withColumns({"is_set": head == "SET", "is_review": head == "REVIEW", "_raw": raw})
    d = d.withColumn("_t", F.when(F.col("is_review"), F.slice("_raw", 2, F.greatest(F.lit(0), F.size("_raw") - 1))).otherwise(F.col("_raw")))
    t = F.col("_t")
    rest = F.when(F.size(t) > 5, F.slice(t, 6, F.greatest(F.lit(0), F.size(t) - 5))).otherwise(F.array().cast("array<string>"))
    d = d.withColumns({"_rest": rest}).withColumn("is_3bet_spot", (F.size("_rest") > 0) & F.coalesce(F.upper(F.try_element_at("_rest", F.lit(-1))) == "3BET", F.lit(False)))
    d = d.withColumns({
        "board": F.when(F.col("is_3bet_spot"), F.slice("_rest", 1, F.size("_rest") - 1)).otherwise(F.col("_rest")),
        "hand": cards.label_from_any(_tok(t, 1)), "position": F.upper(_tok(t, 2)),
        "open_bb": _tok(t, 3).try_cast("double"), "stack_bb": _tok(t, 4).try_cast("double"), "_mw": F.upper(_tok(t, 5)),
    })
    n_board = F.size("board")
    error = (
        F.when(F.size("_raw") == 0, "empty")
        .when(F.size("_t") < 5, "tokens")
        .when(F.col("open_bb").isNull() | F.col("stack_bb").isNull(), "numeric")
        .when(F.col("stack_bb") <= 0, "stack")
        .when(F.col("open_bb") < 0, "open")
        .when(~F.col("_mw").isin("Y", "N"), "multiway")
        .when(n_board.isin(1, 2), "board_short")
        .when(n_board > 5, "board_long")
        .when(F.exists("board", lambda x: ~x.rlike(CARD)), "board_card")
        .when(F.size(F.array_distinct(F.transform("board", F.lower))) < n_board, "board_duplicate")
    )
    return d.withColumns({"error": F.when(F.col("is_set"), None).otherwise(error), "is_multiway": F.col("_mw") == "Y"}).drop("_t", "_rest", "_mw")


def setting(tokens: Column, names: tuple[str, ...]) -> Column:
    """Last readable KEY=value of a SET line for one of the key's names, else null."""
    pairs = F.transform(F.filter(tokens, lambda x: x.contains("=")), lambda x: F.split(x, "=", 2))
    mine = F.filter(pairs, lambda p: F.upper(F.trim(p[0])).isin(*names) & p[1].try_cast("double").isNotNull())
    return F.try_element_at(mine, F.lit(-1))[1].try_cast("double")


def setting_errors(tokens: Column) -> Column:
    known = [n for names in SETTINGS.values() for n in names]
    pairs = F.transform(F.filter(tokens, lambda x: x.contains("=")), lambda x: F.split(x, "=", 2))
    return F.size(F.filter(pairs, lambda p: ~F.upper(F.trim(p[0])).isin(*known) | p[1].try_cast("double").isNull()))


def with_session_settings(parsed: DataFrame) -> DataFrame:
    """Latest SET values of the session on every later row. A session of any size is scanned in time slices."""
    d = parsed.withColumns({k: F.when(F.col("is_set"), setting(F.col("_raw"), names)) for k, names in SETTINGS.items()})
    by = F.unix_micros(F.col("received_at").cast("timestamp"))
    return carry_forward(d, ["session_id"], ["received_at", "request_id"], list(SETTINGS), by, tie=F.col("request_id"))


def score(parsed: DataFrame) -> DataFrame:
    """Decision and colour of valid requests; board and malformed requests answer WARNING."""
    f = F.col
    ok = f("error").isNull()
    h = decisions.heuristic(f("hand"), f("position"), f("stack_bb"), f("is_3bet_spot"))
    action = F.when(~ok | (F.size("board") > 0), "WARNING").otherwise(h["action"])
    d = parsed.where(~f("is_set")).withColumn("action", action)
    four = F.when(f("action") == "WARNING", "WARNING").otherwise(play.contract_action("action", F.lit("")))
    return d.withColumn("decision", four).withColumn("color_code", F.when(f("decision") == "WARNING", "YELLOW").otherwise(play.color_of(f("decision"))))
