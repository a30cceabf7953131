"""Per-opponent behaviour accumulators from observed actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyfold.functions.numeric import count_where, ratio

POST = ["flop", "turn", "river"]


def accumulate(actions: DataFrame) -> DataFrame:
    """Numerators and denominators per opponent: additive, so batch and stream share it."""
    f = F.col
    name = F.trim(F.coalesce(f("name"), F.lit("")))
    a, s = F.lower(F.trim("action")), F.lower(F.trim("street"))
    pre, post = s == "preflop", s.isin(*POST)
    d = actions.withColumns({"name": name}).where("name <> ''")
    return d.groupBy("name").agg(
        count_where(pre).alias("hands_seen"),
        count_where(pre & a.isin("call", "raise", "3bet", "4bet", "limp")).alias("vpip_num"), count_where(pre).alias("vpip_den"),
        count_where(pre & a.isin("raise", "3bet", "4bet")).alias("pfr_num"), count_where(pre).alias("pfr_den"),
        count_where(pre & (a == "3bet")).alias("tbet_num"), count_where(pre & a.isin("3bet", "fold", "call")).alias("tbet_den"),
        count_where(pre & (a == "fold")).alias("f3b_num"), count_where(pre & (a == "fold")).alias("f3b_den"),
        count_where(post & a.isin("bet", "raise", "3bet", "4bet")).alias("agg_num"), count_where(post).alias("agg_den"),
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"),
    )


def with_rates(acc: DataFrame) -> DataFrame:
    f = F.col
    return acc.withColumns({
        "vpip": ratio(f("vpip_num"), f("vpip_den")), "pfr": ratio(f("pfr_num"), f("pfr_den")), "three_bet_pct": ratio(f("tbet_num"), f("tbet_den")),
        "fold_to_3bet": ratio(f("f3b_num"), f("f3b_den")), "agg_freq": ratio(f("agg_num"), f("agg_den")),
    })


def hud_line(rates: DataFrame) -> DataFrame:
    def p(c: str) -> Column:
        return F.concat(F.format_string("%.0f", F.bround(F.col(c) * 100, 0)), F.lit("%"))

    n = F.col("hands_seen")
    line = F.concat(
        F.lit("["), F.col("name"), F.lit("] VPIP:"), p("vpip"), F.lit(" PFR:"), p("pfr"), F.lit(" 3B:"), p("three_bet_pct"), F.lit(" F3B:"), p("fold_to_3bet"),
        F.lit(" AGG:"), p("agg_freq"), F.lit(" ("), n, F.lit(" mão"), F.when(n != 1, "s").otherwise(""), F.lit(")"),
    )
    none = F.concat(F.lit("["), F.col("name"), F.lit("] Sem histórico — primeiro encontro"))
    return rates.select("name", F.when(n == 0, none).otherwise(line).alias("hud"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add two accumulator tables, as an incremental run does."""
    nums = [c for c in old.columns if c.endswith(("_num", "_den")) or c == "hands_seen"]
    u = old.unionByName(new)
    return u.groupBy("name").agg(*[F.sum(c).alias(c) for c in nums], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
