"""Text-log ingestion: blocks to typed rows and action rows with built-in columns only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyfold.functions import fixed_values as fv
from tallyfold.functions.play import STREETS, lookup

NUM = r"(\d+\.?\d*)"
HEADER = r"Game Hand #(\d+) - Tournament #(\d+) - .+? - Level (\d+) \(" + NUM + "/" + NUM + r"\) - (\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) UTC"


def site_of(text: Column) -> Column:
    ps = text.contains("PokerStars Hand #") | text.contains("Mao PokerStars #") | text.contains("Mão PokerStars #")
    return F.when(ps, "ps").when(text.contains("Game Hand #"), "acr").otherwise("unknown")


def split_blocks(files: DataFrame, text: str = "value") -> DataFrame:
    """One row per record of each file: split before every record header."""
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), r"(?=Game Hand #|Mão PokerStars #|Mao PokerStars #)")
    d = files.withColumn("site", site_of(F.col(text))).select("*", F.posexplode(parts).alias("block_no", "raw")).drop(text)
    return d.withColumn("raw", F.trim("raw")).where("raw <> '' AND site <> 'unknown'")


def amount(raw: Column) -> Column:
    """Locale-tolerant number: a lone comma is the decimal mark, otherwise commas group."""
    t = F.replace(F.trim(raw), F.lit("$"), F.lit(""))
    lone = t.contains(",") & ~t.contains(".")
    clean = F.when(lone, F.replace(t, F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    return F.coalesce(clean.try_cast("double"), F.lit(0.0))


def name_from_path(path: Column) -> Column:
    """Tournament name: the file's stem."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _got(pattern: str, g: int = 1) -> Column:
    return F.nullif(F.regexp_extract("raw", pattern, g), F.lit(""))


def _seat_name(hero_i: Column, btn_i: Column, n: Column) -> Column:
    rel = F.pmod(hero_i - btn_i, n)
    six = F.element_at(F.array(*[F.lit(x) for x in fv.SEATS_FROM_BUTTON_6]), (rel + 1).cast("int"))
    eight = F.try_element_at(F.array(*[F.lit(x) for x in fv.SEATS_FROM_BUTTON_8]), (rel + 1).cast("int"))
    return F.when(n <= 6, six).otherwise(F.coalesce(eight, F.concat(F.lit("MP"), rel - 3)))


def _tags(lines: Column, hero: str, start: Column, end: Column) -> Column:
    """The hero's actions between two line numbers as display tags."""
    part = F.when(start.isNotNull() & (end > start), F.slice(lines, (start + 1).cast("int"), F.greatest(end - start - 1, F.lit(0)).cast("int"))).otherwise(F.array().cast("array<string>"))
    mine = F.filter(part, lambda x: x.rlike(rf"^{hero} (folds|checks|calls|bets|raises)"))

    def tag(x: Column) -> Column:
        pat = rf"^{hero} (folds|checks|calls|bets|raises)(?: {NUM})?(?: to {NUM})?"
        verb, a1, a2 = [F.regexp_extract(x, pat, i) for i in (1, 2, 3)]
        amt = F.when(a2 != "", a2).otherwise(a1)
        body = F.when(amt != "", F.concat(verb, F.lit(" "), amt)).otherwise(verb)
        return F.when(x.contains("and is all-in"), F.concat(body, F.lit(" (all-in)"))).otherwise(body)

    return F.array_join(F.transform(mine, tag), " → ")


def parse_records(blocks: DataFrame, hero: str) -> DataFrame:
    """Typed play records of one player. Blocks without the header, the player's seat or the
    player's cards are dropped, as are unreadable ones; nothing here runs row-wise Python."""
    f = F.col
    d = blocks.withColumn("h", F.regexp_extract_all("raw", F.lit(HEADER), F.lit(0)))
    d = d.where(F.size("h") > 0).withColumns({
        "lines": F.split("raw", "\n"),
        "seat_nos": F.transform(F.regexp_extract_all("raw", F.lit(r"(?m)^Seat (\d+): \S+ \(\d+\.?\d*\)"), F.lit(1)), lambda x: x.cast("int")),
        "seat_names": F.regexp_extract_all("raw", F.lit(r"(?m)^Seat \d+: (\S+) \(\d+\.?\d*\)"), F.lit(1)),
        "seat_stacks": F.transform(F.regexp_extract_all("raw", F.lit(r"(?m)^Seat \d+: \S+ \((\d+\.?\d*)\)"), F.lit(1)), lambda x: x.cast("double")),
        "hero_cards": _got(rf"Dealt to {hero} \[(.+?)\]"),
    })
    d = d.withColumn("hero_at", F.array_position("seat_names", hero)).where((f("hero_at") > 0) & f("hero_cards").isNotNull())
    line_no = F.transform("lines", lambda x, i: F.struct(x.alias("t"), i.alias("i")))

    def first_line(mark: str) -> Column:
        return F.array_min(F.transform(F.filter("numbered", lambda z: z["t"].contains(mark)), lambda z: z["i"]))

    d = d.withColumn("numbered", line_no)
    d = d.withColumns({k: first_line(m) for k, m in {"i_hole": "*** HOLE CARDS ***", "i_flop": "*** FLOP ***", "i_turn": "*** TURN ***", "i_river": "*** RIVER ***", "i_sum": "*** SUMMARY ***"}.items()})
    end = F.coalesce("i_sum", F.size("lines"))
    stops = {"preflop": (F.lit(0), F.coalesce("i_flop", end)), "flop": (f("i_flop"), F.coalesce("i_turn", end)), "turn": (f("i_turn"), F.coalesce("i_river", end)), "river": (f("i_river"), end)}
    d = d.withColumns({f"hero_action_{s}": _tags(f("lines"), hero, a, b) for s, (a, b) in stops.items()})
    before_summary = F.array_join(F.slice("lines", 1, F.greatest(end, F.lit(0)).cast("int")), "\n")
    all_acts = F.concat_ws(" → ", *STREETS)
    btn = _got(r"Table '(?:.+?)' \d+-max Seat #(\d+) is the button").cast("int")
    sorted_seats = F.array_sort("seat_nos")
    hero_seat = F.element_at("seat_nos", f("hero_at").cast("int"))
    max_seats = _got(r"Table '(?:.+?)' (\d+)-max").cast("int")
    near = F.array_min(F.transform(sorted_seats, lambda s, i: F.struct(F.pmod(s - F.coalesce(btn, F.lit(0)), F.coalesce(max_seats, F.lit(9))).alias("g"), i.alias("i"))))["i"]
    at_btn = F.array_position(sorted_seats, F.coalesce(btn, F.lit(-1)))
    btn_i = F.when(at_btn > 0, at_btn - 1).otherwise(near)
    n = F.size("seat_nos")
    won = F.aggregate(F.transform(F.regexp_extract_all("raw", F.lit(rf"(?m){hero} collected {NUM} from (?:main pot|side pot|pot)"), F.lit(1)), lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    shown_won = _got(rf"Seat \d+: {hero}.*?(?:showed .+? and won|did not show and won) {NUM}").cast("double")
    lost = f("raw").rlike(rf"Seat \d+: {hero}.*?showed .+? and lost")
    d = d.select(
        "*",
        _got(HEADER, 1).alias("hand_id"), _got(HEADER, 2).alias("tournament_id"), _got(HEADER, 3).cast("int").alias("level"),
        _got(HEADER, 4).cast("double").alias("small_blind"), _got(HEADER, 5).cast("double").alias("big_blind"),
        F.try_to_timestamp(_got(HEADER, 6), F.lit("yyyy/MM/dd HH:mm:ss")).alias("date_utc"),
        _got(r"Table '(.+?)' \d+-max").alias("table_id"), max_seats.alias("max_seats"), btn.alias("btn_seat"), n.alias("num_players"),
        hero_seat.alias("hero_seat"), F.element_at("seat_stacks", f("hero_at").cast("int")).alias("hero_stack_start"),
        _seat_name(F.array_position(sorted_seats, hero_seat) - 1, btn_i, n.cast("long")).alias("hero_position"),
        F.coalesce(_got(rf"(?m)^{hero} posts ante {NUM}").cast("double"), F.lit(0.0)).alias("ante"),
        F.coalesce(_got(r"\*\*\* FLOP \*\*\* \[(.+?)\]"), F.lit("")).alias("board_flop"),
        F.coalesce(_got(r"\*\*\* TURN \*\*\* \[.+?\] \[(.+?)\]"), F.lit("")).alias("board_turn"),
        F.coalesce(_got(r"\*\*\* RIVER \*\*\* \[.+?\] \[(.+?)\]"), F.lit("")).alias("board_river"),
        F.coalesce(_got(rf"Total pot {NUM}").cast("double"), F.lit(0.0)).alias("pot_final"),
        before_summary.contains("*** SHOW DOWN ***").cast("int").alias("went_to_showdown"),
        f("hero_action_preflop").rlike("(^|→ )(calls|raises)").cast("int").alias("hero_vpip"),
        f("hero_action_preflop").rlike("(^|→ )raises").cast("int").alias("hero_pfr"),
        all_acts.rlike("(^|→ )(bets|raises)").cast("int").alias("hero_aggressor"),
        all_acts.contains("(all-in)").cast("int").alias("hero_went_allin"),
        F.when(won > 0, won).otherwise(F.coalesce(shown_won, F.lit(0.0))).alias("_won"), lost.alias("_lost"),
    )
    invested = f("ante") + F.when(f("hero_position") == "SB", f("small_blind")).when(f("hero_position") == "BB", f("big_blind")).otherwise(0.0)
    d = d.withColumns({
        "hero_result": F.when(f("_won") > 0, "win").when(f("_lost"), F.when(f("hero_went_allin") == 1, "allin_loss").otherwise("loss")).otherwise("fold"),
        "hero_amount_won": F.when(f("_won") > 0, f("_won")).otherwise(-invested),
        "m_ratio": F.round(F.try_divide(f("hero_stack_start"), f("big_blind") + f("small_blind") + f("ante") * f("num_players")), 2),
    }).withColumn("hero_stack_end", f("hero_stack_start") + f("hero_amount_won"))
    scratch = ["h", "lines", "seat_nos", "seat_names", "seat_stacks", "hero_at", "numbered", "i_hole", "i_flop", "i_turn", "i_river", "i_sum", "_won", "_lost"]
    return d.drop(*scratch)


def record_key() -> Column:
    """Site and number of a record of either dialect."""
    return F.concat_ws(":", "site", F.regexp_extract("raw", r"(?:Game Hand|PokerStars Hand|PokerStars) #(\d+)", 1))


ACTION = "array<struct<street:string,actor_id:string,action_type:string,amount:double,pot_size_before:double,is_all_in:boolean>>"


def block_actions(blocks: DataFrame, *keep: str) -> DataFrame:
    """Action rows of every actor with street, order and the pot before the action, beside the kept columns.

    Streets carry forward from the last marker; the running pot adds antes, blinds and earlier calls, bets and raises.
    A record is one row, so all of it is array work inside that row: nothing is shuffled and records never mix.
    """
    verb_acr = r"(?i)^([^:]+?)(?::)?\s+(folds|checks|calls|bets|raises)(?:\s+\$?([\d.,]+))?(?:\s+to\s+\$?([\d.,]+))?"
    verb_ps = r"(?i)^([^:]+):\s+(desiste|passa|iguala|aposta|aumenta)(?:\s+\$?([\d.,]+))?(?:\s+para\s+\$?([\d.,]+))?"
    post_acr = r"(?i)^(?:\S+)\s+posts\s+(?:ante|the\s+(?:small|big)\s+blind)\s+\$?([\d.,]+)"
    post_ps = r"(?i)^(?:\S+):\s+(?:coloca\s+ante|paga\s+o\s+(?:small blind|big blind))\s+\$?([\d.,]+)"
    acr = F.col("site") == "acr"

    def has(x: Column, words: tuple[str, ...]) -> Column:
        return reduce(or_, [x.contains(w) for w in words])

    # What a pattern can match holds one of its words, in any case: most lines hold none and go before any pattern is tried.
    def acts_in(low: Column) -> Column:
        return F.when(acr, has(low, ("folds", "checks", "calls", "bets", "raises"))).otherwise(has(low, ("desiste", "passa", "iguala", "aposta", "aumenta")))

    def posts_in(low: Column) -> Column:
        return F.when(acr, low.contains("posts")).otherwise(has(low, ("coloca", "paga")))

    def read(x: Column) -> Column:
        grp = lambda i: F.when(x["acts"], F.when(acr, F.regexp_extract(x["t"], verb_acr, i)).otherwise(F.regexp_extract(x["t"], verb_ps, i))).otherwise("")
        up = F.upper(x["t"])
        return F.struct(
            F.when(x["mark"], F.when(up.contains("*** FLOP ***"), "FLOP").when(up.contains("*** TURN ***"), "TURN").when(up.contains("*** RIVER ***"), "RIVER")).alias("marker"),
            (x["mark"] & (up.contains("*** SUMMARY ***") | up.contains("*** RESUMO ***"))).alias("stop"),
            F.when(x["posts"], F.when(acr, F.regexp_extract(x["t"], post_acr, 1)).otherwise(F.regexp_extract(x["t"], post_ps, 1))).otherwise("").alias("post"),
            F.trim(grp(1)).alias("actor"), F.lower(grp(2)).alias("verb"), grp(3).alias("a1"), grp(4).alias("a2"),
            (x["low"].contains("all-in") | x["low"].contains("all in")).alias("all_in"),
        )

    def priced(x: Column) -> Column:
        posted = F.when(x["post"] == "", 0.0).otherwise(amount(x["post"]))
        return F.struct(x.alias("x"), posted.alias("posted"), F.when(x["a2"] != "", x["a2"]).otherwise(x["a1"]).alias("paid"))

    def classed(y: Column) -> Column:
        x = y["x"]
        is_act = (x["verb"] != "") & (y["posted"] == 0)
        return F.struct(
            x["marker"].alias("marker"), x["stop"].alias("stop"), y["posted"].alias("posted"), x["actor"].alias("actor"), x["all_in"].alias("all_in"),
            F.when(is_act, lookup(x["verb"], fv.VERBS, "")).alias("type"), F.when(is_act & (y["paid"] != ""), amount(y["paid"])).otherwise(0.0).alias("amount"),
        )

    def step(s: Column, x: Column) -> Column:
        live = ~x["stop"] & ~s["stopped"] & x["marker"].isNull()
        adds = x["posted"] + F.when(x["type"].isin("CALL", "BET", "RAISE"), x["amount"]).otherwise(0.0)
        act = F.struct(
            s["street"].alias("street"), x["actor"].alias("actor_id"), x["type"].alias("action_type"), x["amount"].alias("amount"), s["pot"].alias("pot_size_before"), x["all_in"].alias("is_all_in")
        )
        return F.struct(
            F.coalesce(x["marker"], s["street"]).alias("street"), (s["stopped"] | x["stop"]).alias("stopped"), (s["pot"] + F.when(live, adds).otherwise(0.0)).alias("pot"),
            F.when(live & x["type"].isNotNull(), F.concat(s["acts"], F.array(act))).otherwise(s["acts"]).alias("acts"),
        )

    lines = F.transform(F.transform(F.split("raw", "\n"), F.trim), lambda x: F.struct(x.alias("t"), F.lower(x).alias("low")))
    lines = F.transform(lines, lambda x: F.struct(x["t"].alias("t"), x["low"].alias("low"), x["t"].contains("***").alias("mark"), acts_in(x["low"]).alias("acts"), posts_in(x["low"]).alias("posts")))
    lines = F.filter(lines, lambda x: x["mark"] | x["acts"] | x["posts"])
    start = F.struct(F.lit("PREFLOP").alias("street"), F.lit(False).alias("stopped"), F.lit(0.0).alias("pot"), F.array().cast(ACTION).alias("acts"))
    acts = F.aggregate(F.transform(F.transform(F.transform(lines, read), priced), classed), start, step, lambda s: s["acts"])
    d = blocks.select(*keep, F.posexplode(acts).alias("_at", "_act"))
    return d.select(*keep, (F.col("_at") + 1).alias("action_order"), "_act.*")


def actions_from_text(hands: DataFrame, key: str = "id") -> DataFrame:
    """Action rows rebuilt from the per-street action text, numbered across streets."""
    none = F.array().cast("array<string>")

    def toks(col: str) -> Column:
        parts = F.transform(F.split(F.replace(F.coalesce(F.col(col), F.lit("")), F.lit("→"), F.lit(",")), ","), F.trim)
        return F.coalesce(F.filter(parts, lambda x: x != ""), none)

    def tagged(col: str, street: str) -> Column:
        return F.transform(toks(col), lambda x: F.struct(F.lit(street).alias("street"), F.upper(x).alias("tok")))

    per = [tagged(c, s) for c, s in zip(STREETS, ["PREFLOP", "FLOP", "TURN", "RIVER"])]
    d = hands.select(key, F.posexplode(F.concat(*per)).alias("i", "a"))
    t = F.col("a.tok")
    kind = F.when(t.contains("RAISE"), "RAISE").when(t.contains("BET"), "BET").when(t.contains("CALL"), "CALL").when(t.contains("FOLD"), "FOLD").when(t.contains("CHECK"), "CHECK").otherwise("UNKNOWN")
    return d.select(key, (F.col("i") + 1).alias("action_order"), F.col("a.street").alias("street"), kind.alias("action_type"), (t.contains("ALL-IN") | t.contains("ALL IN")).alias("is_all_in"))
