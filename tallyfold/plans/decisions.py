"""Decision rules as columns and the decision audit over historical play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyfold.functions import cards, fixed_values as fv, play
from tallyfold.functions.numeric import count_where, ratio
from tallyfold.functions.play import lookup
from tallyfold.operators import ranges

LATE = ["CO", "BTN"]
BLINDS = ["SB", "BB"]


def open_size(limpers: Column) -> Column:
    return 2.0 + 2.0 * limpers


def reraise_size(villain_raise: Column) -> Column:
    return F.round(villain_raise * 3.5, 1)


def four_bet_size(villain_3bet: Column) -> Column:
    return F.round(villain_3bet * 2.5, 1)


def push(tier: Column, stack_bb: Column, seat: Column) -> Column:
    """Short-stack shove by tier, stack and seat; labels without a tier never shove."""
    ok = tier > 0
    return ok & (((stack_bb <= 10) & (tier <= 2)) | ((stack_bb <= 15) & (tier <= 3)) | ((stack_bb <= 20) & (tier <= 2) & seat.isin(*LATE, *BLINDS)))


def heuristic(label: Column, seat: Column, stack_bb: Column, is_3bet: Column) -> Column:
    """Tier ladder used when no model is available. Labels are matched in upper case,
    so only pairs have a tier here; a zero tier folds."""
    tier = cards.tier_of(F.upper(F.replace(label, F.lit(" "), F.lit(""))))
    rated = tier > 0
    action = F.when(rated & (tier <= 2), "RAISE").when(rated & (tier <= 4), F.when(F.upper(seat).isin("BTN", "CO", "SB"), "CALL").otherwise("FOLD")).otherwise("FOLD")
    conf = F.when(rated & (tier <= 2), 0.66).when(rated & (tier <= 4), 0.56).otherwise(0.72)
    short = (stack_bb <= 12) & rated & (tier <= 4)
    action = F.when(short, "RAISE").otherwise(action)
    conf = F.when(short, F.greatest(conf, F.lit(0.60))).otherwise(conf)
    action = F.when(is_3bet & rated & (tier > 4), "FOLD").otherwise(action)
    return F.struct(action.alias("action"), F.round(conf, 3).alias("confidence"), tier.alias("tier"))


def gated(label: Column, seat: Column, stack_bb: Column, players: Column, is_3bet: Column) -> Column:
    """Input contract: rows missing their context abstain with a warning."""
    bad = (F.coalesce(label, F.lit("")) == "") | (F.coalesce(seat, F.lit("")) == "") | (stack_bb <= 0) | (players < 2)
    h = heuristic(label, seat, stack_bb, is_3bet)
    return F.struct(
        F.when(bad, "WARNING").otherwise(h["action"]).alias("action"), F.when(bad, 0.0).otherwise(h["confidence"]).alias("confidence"),
        F.when(bad, "abstain_missing_required_context").otherwise("model_unavailable").alias("warning"), bad.alias("abstained"),
    )


def against_open(in_value: Column, in_bluff: Column, in_flat: Column, tier: Column, multiway: Column) -> Column:
    return (
        F.when(in_value | in_bluff, "3-BET")
        .when(in_flat & ~multiway, "FLAT")
        .when(in_flat & multiway & (tier <= 3), "FLAT")
        .otherwise("FOLD")
    )


def against_3bet(label: Column, tier: Column, seat: Column, stack_bb: Column, villain_3bet: Column) -> Column:
    """Response ladder without a chart: shove, four-bet, pot-odds call, set-mining call, fold."""
    t = F.when(tier == 0, 6).otherwise(tier)
    premium = (t == 1) | label.isin("AKs", "AKo", "QQ")
    size = four_bet_size(villain_3bet)
    equity = lookup(label, fv.TIER2_EQUITY, 0.5)
    odds = F.try_divide(villain_3bet, villain_3bet * 3)
    pair = (F.length(label) == 2) & (F.substring(label, 1, 1) == F.substring(label, 2, 1))
    return (
        F.when((stack_bb <= 25) & (t <= 2), "ALL-IN")
        .when(premium & (size >= stack_bb * 0.65), "ALL-IN")
        .when(premium, "4-BET")
        .when((t == 2) & (equity > odds), "CALL")
        .when(t == 2, "FOLD")
        .when((t == 3) & pair & seat.isin(*LATE), "CALL")
        .otherwise("FOLD")
    )


def flat_requirement(raise_size: Column, label: Column, multiway: Column) -> Column:
    """Stack a flat call needs: a multiple of the raise by call category."""
    m = fv.FLAT_MULTIPLE
    mult = F.when(label.isin(*fv.SET_MINING.split()), m["set_mining"]).when(multiway, m["multiway"]).otherwise(m["general"])
    return raise_size * mult


def judged(hands: DataFrame, strict: bool = True) -> DataFrame:
    """Every playable row with its label, bucket, charted expectation and actual action.

    Seats without an opening chart have no expectation above the push depth.
    """
    f = F.col
    rows = hands.where("big_blind > 0").select(
        "id", "hero_vpip", "hero_pfr", "hero_aggressor", "m_ratio", "won_cents", "hero_action_preflop", "hero_action_flop", "hero_position",
        *(["pot_final"] if "pot_final" in hands.columns else [F.lit(0.0).alias("pot_final")]), "big_blind",
        play.seat("hero_position").alias("seat"), cards.label_from_pair("hero_cards").alias("label"),
        play.in_bb("hero_stack_start", "big_blind").alias("stack_bb"),
    )
    rows = ranges.with_range_flags(rows.where("label <> ''"), strict=strict).withColumn("tier", cards.tier_of(f("label")))
    expected = F.when(f("stack_bb") <= 20, F.when(push(f("tier"), f("stack_bb"), f("seat")), "ALL-IN").otherwise("FOLD")).when(
        f("seat").isin(*fv.OPENING), F.when(f("in_open"), "BET").otherwise("FOLD")
    )
    actual = play.chart_action("hero_action_preflop")
    rows = rows.withColumns({"bucket": play.stack_summary("stack_bb"), "expected": expected, "actual": actual})
    return rows.withColumn("actual", F.when((f("actual") == "ALL-IN") & f("expected").isin("BET", "CALL", "FOLD"), "BET").otherwise(f("actual")))


def concordance(rows: DataFrame) -> DataFrame:
    """Share of expected actions taken, per stack bucket and overall in one rollup."""
    g = rows.where("expected IS NOT NULL").rollup("bucket").agg(F.count("*").alias("n"), ratio(count_where(F.col("expected") == F.col("actual")), F.count("*")).alias("share"))
    return g.select(F.coalesce("bucket", F.lit("overall")).alias("bucket"), "n", F.round("share", 3).alias("share"))


def mistakes(rows: DataFrame) -> DataFrame:
    """First matching mistake per row out of five ordered rules.

    The charted-fold rule comes first, so the shove rule only sees rows at very low m;
    the cheap-blind rule swallows blind folds and needs pot odds below 0.30.
    """
    f = F.col
    pf, fl = play.action_class("hero_action_preflop"), play.action_class("hero_action_flop")
    pot_bb = f("pot_final") / f("big_blind")
    cheap = (f("pot_final") > 0) & (pot_bb < 6) & (play.pot_odds(pot_bb, pot_bb / 2) < 0.30)
    kind = (
        F.when((pf == "fold") & f("in_open") & (f("m_ratio") > 3), "FOLD_GTO_RANGE")
        .when((f("hero_vpip") == 1) & (f("hero_pfr") == 0) & (f("seat") != "BB") & (f("m_ratio") > 8), "LIMP_INITIATIVE")
        .when((f("seat") == "BB") & (pf == "fold"), F.when(cheap, "BB_FOLD_CHEAP"))
        .when((f("hero_vpip") == 1) & fl.isin("check", "call") & (f("hero_aggressor") == 0) & (f("stack_bb") > 15), "PASSIVE_POSTFLOP")
        .when((pf == "fold") & (f("m_ratio") <= 7) & f("in_open"), "PUSH_FOLD_MISS")
    )
    return rows.withColumn("mistake", kind).where("mistake IS NOT NULL").select("id", "seat", "label", "mistake", "won_cents")


def mistake_counts(m: DataFrame) -> DataFrame:
    return m.groupBy("mistake").agg(F.count("*").alias("n")).withColumn("name", lookup(F.col("mistake"), fv.MISTAKE_NAMES, "")).orderBy(F.col("n").desc(), "mistake")


def costliest_mistakes(m: DataFrame, n: int = 15) -> DataFrame:
    return m.orderBy("won_cents", "id").limit(n)


def before_acting(actions: DataFrame, actor: str, big_blind: DataFrame, key: str = "record") -> DataFrame:
    """(key, limpers, open_size_bb, is_3bet_spot): what the actor of a record had seen before acting for the first time.

    ``actions`` has key, action_order, street, actor_id, action_type, amount; ``big_blind`` has key and big_blind. Callers before any
    raise are limpers; the first raise gives the open size. Records in which the actor doesn't act before the flop have no row.
    """
    f = F.col
    pre = actions.where("street = 'PREFLOP'")
    whole = Window.partitionBy(key)  # one record's actions
    mine = F.min(F.when(f("actor_id") == actor, f("action_order"))).over(whole)
    seen = pre.withColumn("_mine", mine).where(f("_mine").isNotNull() & (f("action_order") <= f("_mine")))
    raised = f("action_type").isin("RAISE", "BET") & (f("action_order") < f("_mine"))
    seen = seen.withColumn("_first", F.min(F.when(raised, f("action_order"))).over(whole))
    limped = (f("action_type") == "CALL") & (f("action_order") < F.coalesce(F.least("_mine", "_first"), "_mine"))
    one = seen.groupBy(key).agg(F.count(F.when(limped, 1)).alias("limpers"), F.max(F.when(f("action_order") == f("_first"), f("amount"))).alias("_open"), F.coalesce(F.max(F.when(raised, True)), F.lit(False)).alias("is_3bet_spot"))
    met = one.join(big_blind.select(key, f("big_blind").cast("double").alias("_bb")), key, "left")
    return met.select(key, "limpers", F.coalesce(F.try_divide("_open", F.nullif("_bb", F.lit(0.0))), F.lit(0.0)).alias("open_size_bb"), "is_3bet_spot")


def model_features(hands: DataFrame, *keep: str) -> DataFrame:
    """Numeric encodings of a play row for the value models."""
    f = F.col
    order = {s: i for i, s in enumerate(fv.FEATURE_SEATS)}
    ratio_ = F.try_divide(f("hero_stack_start").cast("double"), F.nullif(f("big_blind"), F.lit(0)))
    m = F.coalesce(f("m_ratio"), F.lit(10.0))
    a = F.lower(F.coalesce(f("hero_action_preflop"), F.lit("")))
    tex = cards.board_texture_code("board_flop")
    players = F.least(F.greatest(F.coalesce(f("num_players"), F.lit(6)), F.lit(2)), F.lit(9))
    return hands.select(
        "id", *keep,
        lookup(f("hero_position"), order, 4).alias("position_ord"),
        *[(f("hero_position") == s).cast("int").alias(f"pos_{s}") for s in fv.ONE_HOT_SEATS],
        F.when(ratio_.isNull(), 1).when(ratio_ < 20, 0).when(ratio_ < 50, 1).otherwise(2).alias("stack_zone"),
        F.when(m < 6, 0).when(m < 10, 1).when(m < 20, 2).otherwise(3).alias("m_zone"),
        F.least(F.greatest(m, F.lit(0.0)), F.lit(50.0)).alias("m_ratio"),
        F.when(a.rlike("raise|3bet|all-in"), 2).when(a.rlike("call|flat"), 1).otherwise(0).alias("action_preflop"),
        f("hero_vpip").alias("vpip"), f("hero_pfr").alias("pfr"), f("hero_aggressor").alias("aggressor"), f("hero_went_allin").alias("went_allin"),
        tex.alias("board_texture"), (tex > 0).cast("int").alias("has_board"), players.cast("int").alias("num_players"), (players > 2).cast("int").alias("multiway"),
        cards.tier_of(cards.label_from_any(F.replace(f("hero_cards"), F.lit(" "), F.lit("")))).alias("hand_tier"),
        F.least(F.greatest(F.coalesce(f("level"), F.lit(1)), F.lit(1)), F.lit(50)).cast("int").alias("level"),
        f("went_to_showdown").alias("wtsd"), f("won_cents").alias("target_amount"), (f("hero_result") == "win").cast("int").alias("target_win"),
    )
