"""Behaviour-leak detection: prepare, group metrics, rules, contexts, severity, study plan.

Play is read once and reduced to a few hundred group rows; every detector is a rule over
those groups, so all later steps work on small tables whatever the size of the input.
Grouping keys can be extended (for example by day or week) to run the detection per slice.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyfold.functions import cards, fixed_values as fv, play
from tallyfold.functions.numeric import clamp, count_where, finite, fixed, rate
from tallyfold.operators import dedupe, quality, streaks
from tallyfold.operators.scan import exact_quantiles
from tallyfold.session import written

VILLAIN = ["villain_vpip", "villain_pfr", "villain_aggression", "villain_fold_to_3bet", "villain_wtsd"]
OPPONENT_KEYS = ["villain_id", "opponent_id", "villain_name", "opponent_name"]


def _or(df: DataFrame, name: str, default, kind: str = "string") -> Column:
    """A column if the input has it, else a typed default."""
    return F.col(name) if name in df.columns else F.lit(default).cast(kind)


def opponent_key(df: DataFrame) -> Column:
    """First opponent column the input has, else the inferred type; null is 'unknown'."""
    for name in OPPONENT_KEYS:
        if name in df.columns:
            return F.coalesce(F.col(name).cast("string"), F.lit("unknown"))
    return F.coalesce(F.col("opponent_type"), F.lit("unknown"))


def opponent_rates(spots: DataFrame) -> DataFrame:
    """Behaviour rates per opponent key."""
    pf, fl = F.upper(F.coalesce(F.col("hero_action_preflop"), F.lit(""))), F.upper(F.coalesce(F.col("hero_action_flop"), F.lit("")))
    return spots.groupBy(opponent_key(spots).alias("opponent_key")).agg(
        F.count("*").alias("samples"),
        rate(pf.rlike("RAISE|3BET|4BET|ALL-IN|BET")).alias("aggression_rate"),
        rate(pf.rlike("CALL|FLAT")).alias("call_rate"),
        rate(pf.contains("FOLD")).alias("fold_rate"),
        rate(fl.contains("BET")).alias("cbet_rate"),
    )


def prepared_rates(prep: DataFrame) -> DataFrame:
    """``opponent_rates`` of the hands that ``open_prepared`` was made from, without reading them again."""
    pf = F.col("pf")
    return prep.groupBy(F.coalesce("_okey", F.lit("unknown")).alias("opponent_key")).agg(
        F.count("*").alias("samples"),
        rate(pf.rlike("RAISE|3BET|4BET|ALL-IN|BET")).alias("aggression_rate"),
        rate(pf.rlike("CALL|FLAT")).alias("call_rate"),
        rate(pf.contains("FOLD")).alias("fold_rate"),
        rate(F.col("flop").contains("BET")).alias("cbet_rate"),
    )


def cluster_by_rule(rates: DataFrame) -> DataFrame:
    name = F.when(F.col("aggression_rate") >= 0.45, "Aggro").when(F.col("call_rate") >= 0.35, "Station").otherwise("Passive")
    return rates.withColumn("opponent_cluster", name)


#: A column is a sizing column if its name has one of these.
SIZING_NAMES = ("bet_size", "raise_size", "sizing", "amount_bet")


def sizing_columns(hands: DataFrame) -> list[str]:
    return [c for c in hands.columns if any(k in c.lower() for k in SIZING_NAMES)]


def deduped(hands: DataFrame) -> DataFrame:
    """One row per hand and site, the last by time; hands without an id column stay as they are."""
    if "hand_id" not in hands.columns:
        return hands
    return dedupe.keep_latest_per_site(hands if "site_name" in hands.columns else hands.withColumn("site_name", F.lit("UNKNOWN")))


def prepare(hands: DataFrame, clusters: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Derived columns every detector reads. ``clusters`` maps opponent_key to a cluster name;
    without it each row's cluster follows from the inferred opponent type."""
    return with_clusters(open_prepared(hands, keep), clusters)


def prepare_once(hands: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Deduplicated hands prepared and written, with clusters by rule: the one pass over play that all detectors share.

    Clusters are written too: their size is known before play is joined, so play is not dealt by opponent where they are few.
    They have one row for each opponent; that ``dropDuplicates`` tells it lets readers that need no cluster leave out the join.
    """
    one = written(open_prepared(deduped(hands), keep), "prepared")
    if "_okey" not in one.columns:
        return with_clusters(one, None)
    return with_clusters(one, written(cluster_by_rule(prepared_rates(one)), "clusters").dropDuplicates(["opponent_key"]))


def open_prepared(hands: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``prepare`` before clusters are known; ``_okey`` is the opponent where the input names one."""
    sizes = [F.struct(F.lit(c).alias("size_name"), F.col(c).try_cast("double").alias("size")) for c in sizing_columns(hands)]
    # Columns read many times below are projected first, so each is built once per row and the
    # generated code stays small.
    one = hands.select(
        *keep, "id", "date_utc", "hero_stack_start", "big_blind", "hero_cards", "hero_position", "m_ratio", *play.STREETS,
        *[finite(x).alias(y) for x, y in (("hero_vpip", "vpip"), ("hero_pfr", "pfr"), ("went_to_showdown", "showdown"))],
        _or(hands, "won_cents", 0, "long").alias("amount"),
        _or(hands, "tournament_phase", None).alias("_phase"),
        play.in_bb("hero_stack_start", "big_blind").alias("stack_bb"),
        play.in_bb(_or(hands, "won_cents", 0, "long"), "big_blind").alias("amount_bb"),
        *[finite(_or(hands, v, None, "double"), -1.0).alias(f"_{v}") for v in VILLAIN],
        *[F.upper(F.coalesce(F.col(x), F.lit(""))).alias(y) for x, y in zip(play.STREETS, ["pf", "flop", "turn", "river"])],
        cards.parse_board("board_flop").alias("_cards"),
        play.action_list().alias("_acts"),
        _or(hands, "decision_time_ms", None, "double").cast("double").alias("decision_ms"),
        (F.array(*sizes) if sizes else F.array().cast("array<struct<size_name:string,size:double>>")).alias("sizes"),
        *[F.col(k).cast("string").alias("_okey") for k in OPPONENT_KEYS[:1] if k in hands.columns],
        _or(hands, "hero_name", "UNKNOWN").alias("hero_name"),
    )
    one = one.withColumns({"_ranks": cards.ranks_of(F.col("_cards")), "_suits": cards.suits_of(F.col("_cards"))})
    return one.select(
        *keep, "id", "date_utc", "vpip", "pfr", "showdown", "stack_bb", "amount_bb", "hero_stack_start", "big_blind", "hero_cards", "amount",
        "pf", "flop", "turn", "river", "decision_ms", "sizes", "hero_name", *([F.col("_okey")] if "_okey" in one.columns else []),
        F.expr(play.seat_sql("hero_position")).alias("position"),
        play.phase("m_ratio", "_phase").alias("phase"),
        cards.texture_from(F.size("_cards"), F.col("_ranks"), F.col("_suits"), cards.rank_places(F.col("_ranks"))).alias("board_texture"),
        play.line_type(F.col("_acts")).alias("line_type"),
        play.line_type_by_street().alias("line_street"),
        play.opponent_from([F.col(f"_{v}") for v in VILLAIN], F.col("stack_bb")).alias("opponent_type"),
        play.cascade_score("flop", "turn", "river", "amount").alias("cascade"),
        F.expr(play.band_sql("stack_bb", 0)).alias("stack_depth_bucket"),
        F.expr(play.band_sql("stack_bb", 1)).alias("stack_bucket"),
    )


def with_clusters(out: DataFrame, clusters: DataFrame | None) -> DataFrame:
    if clusters is not None and "_okey" in out.columns:
        out = out.withColumn("opponent_key", F.coalesce("_okey", "opponent_type"))
        out = out.join(clusters.select("opponent_key", "opponent_cluster"), "opponent_key", "left").drop("opponent_key")
        out = out.withColumn("opponent_cluster", F.coalesce("opponent_cluster", F.lit("Passive")))
    else:
        kind = F.col("opponent_type")
        out = out.withColumn(
            "opponent_cluster",
            F.when(kind.isin("reg agressivo", "maniaco", "short stack pressionador"), "Aggro")
            .when(kind.isin("calling station", "recreativo"), "Station")
            .otherwise("Passive"),
        )
    return out.drop("_okey")


MODE_COLUMNS = ("stack_depth_bucket", "opponent_type", "opponent_cluster", "board_texture", "line_type")
GROUP = ["stack_bucket", "position", "phase"]

# Additive measures of a play row, summed once and re-summed by every coarser grouping.
SUMS = {
    "n": "1",
    "vpip": "vpip",
    "pfr": "pfr",
    "call": "IF(pf RLIKE 'CALL|FLAT', 1, 0)",
    "fold": "IF(contains(pf, 'FOLD'), 1, 0)",
    "raise": "IF(pf RLIKE 'RAISE|3BET|4BET|ALL-IN', 1, 0)",
    "cbet": "IF(contains(flop, 'BET'), 1, 0)",
    "bluff": "IF(river RLIKE 'BET|RAISE' AND amount_bb < 0, 1, 0)",
    "pot3": "IF(line_type = '3BET_POT', 1, 0)",
    "pot3_fold": "IF(line_type = '3BET_POT' AND contains(pf, 'FOLD'), 1, 0)",
    "bet3": "IF(contains(pf, '3BET'), 1, 0)",
    "bet4": "IF(contains(pf, '4BET'), 1, 0)",
    "cascade": "cascade",
    "ev": "amount_bb",
    "won": "IF(amount_bb > 0, 1, 0)",
    "sd": "showdown",
    "river_agg": "IF(river RLIKE 'BET|RAISE', 1, 0)",
    "jam": "IF(line_type IN ('JAM', '3BET_POT'), 1, 0)",
    "jam_call": "IF(line_type IN ('JAM', '3BET_POT') AND contains(pf, 'CALL'), 1, 0)",
    "jam_ev": "IF(line_type IN ('JAM', '3BET_POT'), amount_bb, 0)",
    "jam_sd": "IF(line_type IN ('JAM', '3BET_POT') AND showdown > 0, 1, 0)",
}
# Rates read by the rules, from the sums.
RATES = {
    "n": "s_n",
    "vpip": "s_vpip / s_n",
    "pfr": "s_pfr / s_n",
    "call_rate": "s_call / s_n",
    "fold_rate": "s_fold / s_n",
    "raise_rate": "s_raise / s_n",
    "cbet_rate": "s_cbet / s_n",
    "river_bluff_rate": "s_bluff / s_n",
    "fold_to_3bet_rate": "coalesce(try_divide(s_pot3_fold, s_pot3), 0D)",
    "three_bet_rate": "s_bet3 / s_n",
    "four_bet_rate": "s_bet4 / s_n",
    "cascade_rate": "s_cascade / s_n",
    "ev_real": "s_ev",
    "win_rate": "s_won / s_n",
    "showdown_rate": "s_sd / s_n",
    "river_agg_rate": "s_river_agg / s_n",
    "jam_n": "s_jam",
    "jam_call_rate": "coalesce(try_divide(s_jam_call, s_jam), 0D)",
    "jam_ev_real": "s_jam_ev",
    "jam_showdown_rate": "coalesce(try_divide(s_jam_sd, s_jam), 0D)",
    "total_ev_lost": "greatest(0D, -s_ev)",
    "avg_loss": "greatest(0D, -s_ev) / s_n",
}


def base_groups(prep: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Play reduced to every combination of the categories: the only full pass over play.

    The number of rows is bounded by the category sizes, not by the input, and partial
    sums are made before the shuffle, so a dominant group costs nothing extra.
    """
    keys = [*extra, *GROUP, *MODE_COLUMNS, "postflop", "timed"]
    src = prep.withColumns({
        "postflop": F.expr("flop <> '' OR turn <> '' OR river <> ''"),
        "timed": F.expr("coalesce(decision_ms > 0, false)"),
    })
    return src.groupBy(*keys).agg(*[F.expr(f"sum({e})").alias(f"s_{k}") for k, e in SUMS.items()], _rep_min("rep", "TRUE"), _rep_min("jam_rep", "line_type IN ('JAM', '3BET_POT')"))


REP_FIELDS = ("id", "showdown", "hero_cards", "opponent_type", "line_type", "stack_bb", "amount", "big_blind", "hero_stack_start", "hero_name", "phase", "board_texture", "line_street")


def _rep_min(name: str, where: str) -> Column:
    """The worst result as (amount_bb, id, row); smallest id on ties."""
    row = ", ".join(f"'{x}', {x}" for x in REP_FIELDS)
    return F.expr(f"min(IF({where}, named_struct('a', amount_bb, 'i', id, 'row', named_struct({row})), NULL))").alias(name)


SETS = {
    "seat": "TRUE",
    "texture": "postflop",
    "timing": "timed",
}


def group_metrics(base: DataFrame, extra: Sequence[str] = (), sets: Sequence[str] = ("seat", "texture", "timing")) -> DataFrame:
    """Measures and most frequent labels of all rule groups, from the base groups.

    ``grouping`` tells the three group kinds apart: per seat, per seat and board texture
    (play that saw a flop), per seat and line (play with a decision time).
    """
    member = {
        "seat": "named_struct('grouping', 'seat', 'by', '')",
        "texture": "IF(postflop, named_struct('grouping', 'texture', 'by', board_texture), NULL)",
        "timing": "IF(timed, named_struct('grouping', 'timing', 'by', line_type), NULL)",
    }
    rows = base.withColumn("g", F.expr(f"explode(array_compact(array({', '.join(member[x] for x in sets)})))"))
    keys = [*extra, *GROUP, "grouping", "by"]
    rows = rows.withColumns({"grouping": F.col("g.grouping"), "by": F.col("g.by")})
    sums = rows.groupBy(*keys).agg(*[F.sum(f"s_{k}").alias(f"s_{k}") for k in SUMS], F.min("rep").alias("rep"), F.min("jam_rep").alias("jam_rep"))
    pairs = ", ".join(f"named_struct('k', '{m}', 'v', {m})" for m in MODE_COLUMNS)
    votes = rows.select(*keys, "s_n", F.expr(f"explode(array({pairs}))").alias("p")).groupBy(*keys, "p").agg(F.sum("s_n").alias("c"))
    modes = votes.groupBy(*keys).agg(*[
        F.expr(f"min_by(p.v, IF(p.k = '{m}', named_struct('c', -c, 'v', p.v), NULL))").alias(f"m_{m}") for m in MODE_COLUMNS
    ])
    return sums.join(modes, keys).select(*keys, *[F.expr(e).alias(k) for k, e in RATES.items()], F.col("rep.row").alias("rep"), F.col("jam_rep.row").alias("jam_rep"), *[f"m_{m}" for m in MODE_COLUMNS])


def group_quantiles(prep: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Stack median of late-phase seats and quartiles of decision time, exact, in one scan."""
    values = prep.select(*extra, *GROUP, F.expr(
        "explode(array_compact(array("
        f"IF(phase IN ({_quoted(fv.LATE_PHASES)}), named_struct('grouping', 'seat', 'by', '', 'v', stack_bb), NULL), "
        "IF(decision_ms > 0, named_struct('grouping', 'timing', 'by', line_type, 'v', decision_ms), NULL))))"
    ).alias("x")).select(*extra, *GROUP, "x.*")
    keys = [*extra, *GROUP, "grouping", "by"]
    return exact_quantiles(values, keys, F.col("v"), {"q1": 0.25, "q2": 0.5, "q3": 0.75})


def _quoted(names) -> str:
    return ", ".join(f"'{x}'" for x in names)


def _case(col: str, table: dict, default) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else f"{float(v)!r}D"

    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default)} END"


def _limit(i: int) -> str:
    return _case("stack_bucket", {k: v[i] for k, v in fv.DETECTOR_LIMITS.items()}, fv.DETECTOR_LIMITS["MID"][i])


DERIVED = {
    "seat_adj": f"({_case('position', fv.SEAT_FACTOR, 1.0)}) * ({_case('phase', fv.PHASE_FACTOR, 1.0)})",
    "late": f"phase IN ({_quoted(fv.LATE_PHASES)})",
    "call_max": _limit(4),
    "fold_max": _limit(5),
}
LIMITS = {
    "vpip_max": f"({_limit(1)}) * seat_adj",
    "vpip_min": f"({_limit(0)}) * least(1D, seat_adj + 0.05D)",
    "pfr_min": f"({_limit(2)}) * seat_adj",
    "pfr_max": f"({_limit(3)}) * (seat_adj + 0.05D)",
}

# grouping, condition, code, metric, benchmark, base severity, minimum rows, evidence, context overrides.
# Evidence is (name, measure) pairs printed with two decimals, or fixed text.
CLUSTER = {"opponent_cluster": "m_opponent_cluster"}
PRESSURE = {**CLUSTER, "bubble_factor": "round(bf, 3)"}
TEXTURE = {**CLUSTER, "board_texture": "by"}
LINE = {**CLUSTER, "line_type": "by"}
SUMMARY_DEPTH = {"stack_depth_bucket": "stack_bucket"}


def _vop(rate: str, limit: str) -> str:
    return f"abs(least(1D, {rate}) - {limit}) / {limit}"


RULES = [
    ("seat", "vpip > vpip_max", "VPIP_LOOSE", "vpip", "vpip_max", 0.70, 15, [("vpip", "vpip"), ("max", "vpip_max")], CLUSTER),
    ("seat", "vpip < vpip_min", "VPIP_TIGHT", "vpip", "vpip_min", 0.55, 15, [("vpip", "vpip"), ("min", "vpip_min")], CLUSTER),
    ("seat", "pfr < pfr_min", "PFR_LOW", "pfr", "pfr_min", 0.65, 15, [("pfr", "pfr"), ("min", "pfr_min")], CLUSTER),
    ("seat", "pfr > pfr_max", "C_BET_STRONG", "pfr", "pfr_max", 0.55, 15, [("pfr", "pfr"), ("max", "pfr_max")], CLUSTER),
    ("seat", "position IN ('CO', 'BTN', 'SB', 'BB') AND fold_rate > fold_max", "FOLD_EXCESSIVE", "fold_rate", "fold_max", 0.60, 15,
     [("fold_rate", "fold_rate"), ("max", "fold_max"), ("vop_dev", _vop("fold_rate", "fold_max"))], {}),
    ("seat", "position IN ('UTG', 'LJ', 'HJ', 'CO', 'BTN') AND call_rate > call_max", "CALL_EXCESSIVE", "call_rate", "call_max", 0.55, 15,
     [("call_rate", "call_rate"), ("max", "call_max"), ("vop_dev", _vop("call_rate", "call_max"))], {}),
    ("seat", "three_bet_rate >= 0.08D", "THREE_BET_WRONG", "three_bet_rate", "0.05D", 0.50, 15, [("3bet_rate", "three_bet_rate")], {}),
    ("seat", "fold_to_3bet_rate > 0.55D", "FOLD_VS_3BET_HIGH", "fold_to_3bet_rate", "0.55D", 0.62, 15,
     [("fold_to_3bet", "fold_to_3bet_rate"), "baseline=0.55", ("vop_dev", _vop("fold_to_3bet_rate", "0.55D"))],
     {**CLUSTER, **SUMMARY_DEPTH, "line_type": "'3BET_POT'"}),
    ("seat", "four_bet_rate >= 0.03D", "FOUR_BET_WRONG", "four_bet_rate", "0.02D", 0.55, 15, [("4bet_rate", "four_bet_rate")], SUMMARY_DEPTH),
    ("seat", "late AND fold_rate > 0.70D AND bf <= 1.40D AND position IN ('SB', 'BB', 'BTN', 'CO')", "ICM_PASSIVITY", "fold_rate", "0.55D", 0.78, 15,
     [("fold_rate", "fold_rate"), ("bubble_factor", "bf"), "icm_passivity=true"], PRESSURE),
    ("seat", "late AND n >= 15 AND jam_call_rate > 0.24D AND bf >= 1.25D", "ICM_SUICIDE", "jam_call_rate", "0.20D", 0.84, 15,
     [("call_rate_jam", "jam_call_rate"), ("bubble_factor", "bf"), "icm_suicide=true"], {**PRESSURE, "subset": "jam_"}),
    ("seat", "late AND bf >= 1.30D AND raise_rate < 0.14D AND position IN ('CO', 'BTN', 'SB')", "ICM_PASSIVITY", "raise_rate", "0.18D", 0.76, 15,
     [("raise_rate", "raise_rate"), ("bubble_factor", "bf"), "icm_passivity=true"], PRESSURE),
    ("texture", "cbet_rate < 0.18D AND position IN ('BTN', 'CO', 'HJ') AND phase <> 'FINAL_TABLE'", "C_BET_WEAK", "cbet_rate", "0.25D", 0.50, 20,
     [("cbet_rate", "cbet_rate")], TEXTURE),
    ("texture", "cbet_rate > 0.70D AND stack_bucket IN ('LOW', 'MID')", "C_BET_STRONG", "cbet_rate", "0.65D", 0.45, 20, [("cbet_rate", "cbet_rate")], TEXTURE),
    ("texture", "river_bluff_rate > 0.22D AND win_rate < 0.45D", "BLUFF_BAD", "river_bluff_rate", "0.15D", 0.75, 20,
     [("river_bluff_rate", "river_bluff_rate"), ("win_rate", "win_rate")], TEXTURE),
    ("texture", "avg_loss > 0 AND vpip > 0.30D AND pfr < 0.18D", "OVERPLAY_MEDIUM", "avg_loss", "0D", 0.70, 20,
     [("avg_loss", "avg_loss"), ("vpip", "vpip"), ("pfr", "pfr")], TEXTURE),
    ("texture", "cascade_rate > 0.45D", "BLUFF_BAD", "cascade_rate", "0.30D", 0.66, 20,
     [("cascade_rate", "cascade_rate"), "cascade_effect=flop->turn/river"], TEXTURE),
    ("texture", "showdown_rate > 0.25D AND win_rate < 0.52D AND cbet_rate < 0.45D", "VALUE_BET_LOST", "showdown_rate", "0.25D", 0.60, 20,
     [("wtsd", "showdown_rate"), ("win_rate", "win_rate")], TEXTURE),
    ("timing", "by IN ('3BET_POT', 'JAM', 'AGGRESSIVE_POSTFLOP') AND q2 < greatest(1200D, q1)", "TIMING_IMPULSIVE", "q2", "greatest(1800D, q3)", 0.58, 15,
     [("decision_ms_median", "q2"), "complex_spot"], LINE),
    ("timing", "by IN ('AGGRESSIVE_POSTFLOP', 'MIXED') AND river_agg_rate > 0.25D AND q2 > greatest(8000D, q3 * 1.5D)", "TIMING_TELEGRAPH", "q2",
     "greatest(3500D, q3)", 0.50, 15, [("decision_ms_median", "q2"), "slow_bluff_pattern"], LINE),
]


def _evidence(items) -> str:
    out = []
    for it in items:
        if isinstance(it, str):
            out.append("concat('complex_spot=', by)" if it == "complex_spot" else f"'{it}'")
        elif len(it) == 3:  # the name starts with a column's value
            out.append(f"concat({it[0]}, '{it[1]}=', format_string('%.2f', bround({it[2]}, 2)))")
        else:
            d = 0 if it[0] == "decision_ms_median" else 2
            out.append(f"concat('{it[0]}=', format_string('%.{d}f', bround({it[1]}, {d})))")
    return f"array({', '.join(out)})"


def compile_rule(rule) -> str:
    """One rule as SQL text: a detection struct where it fires, else null."""
    kind, cond, code, metric, bench, base, min_n, evidence, ctx = rule
    sub = ctx.get("subset", "")
    fields = {
        "leak_code": f"'{code}'", "metric": f"CAST({metric} AS DOUBLE)", "benchmark": f"CAST({bench} AS DOUBLE)", "base": f"{base}D",
        "sample_size": f"CAST({sub}n AS BIGINT)", "ev_real": f"{sub}ev_real", "showdown_rate": f"{sub}showdown_rate", "rep": f"{sub}rep",
        "stack_depth_bucket": "m_stack_depth_bucket", "stack_bucket": "stack_bucket", "opponent_type": "m_opponent_type", "opponent_cluster": "'Passive'",
        "board_texture": "m_board_texture", "line_type": "m_line_type", "bubble_factor": "CAST(NULL AS DOUBLE)",
    }
    fields.update({k: v for k, v in ctx.items() if k in fields})
    body = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return f"IF(grouping = '{kind}' AND {sub}n >= {min_n} AND ({cond}), named_struct({body}, 'evidence', {_evidence(evidence)}), NULL)"


def apply_rules(groups: DataFrame, extra: Sequence[str] = (), rules=RULES) -> DataFrame:
    """Every rule over every group in one projection; one output row per rule that fires."""
    g = groups.withColumns({k: F.expr(v) for k, v in DERIVED.items()}).withColumns(
        {**{k: F.expr(v) for k, v in LIMITS.items()}, "bf": play.bubble_factor("q2", "phase")}
    )
    hits = F.expr(f"explode(array_compact(array({', '.join(compile_rule(r) for r in rules)})))").alias("d")
    own = [*extra, "position", "phase"]
    return g.select(*own, hits).select(*own, "d.*")


def detect(prep: DataFrame, extra: Sequence[str] = (), rules=RULES, sizing: bool = True, tilt: bool = True) -> DataFrame:
    """Run the given detectors. ``extra`` keys split the detection (day, week); tilt reads play as one run and leaves them out."""
    extra = list(extra)
    keys = [*extra, *GROUP, "grouping", "by"]
    found = None
    if rules:
        sets = [x for x in SETS if any(r[0] == x for r in rules)]
        groups = group_metrics(base_groups(prep, extra), extra, sets)
        if any(re.search(r"\b(bf|q[123])\b", repr(r)) for r in rules):
            groups = groups.join(group_quantiles(prep, extra), keys, "left")
        else:
            groups = groups.withColumns({q: F.lit(None).cast("double") for q in ("q1", "q2", "q3")})
        found = apply_rules(groups, extra, rules)
    if sizing:
        sized = sizing_detection(prep, extra)
        found = sized if found is None else found.unionByName(sized)
    out = None if found is None else score_detections(found)
    if tilt and not extra:
        shifted = tilt_detection(prep)
        out = shifted if out is None else out.unionByName(shifted, allowMissingColumns=True)
    return out


def validated(hands: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The whole first half of the report chain: (detections, validation issues).

    Hands are deduplicated, then validated and searched. Detections carry ``validation_ok`` and ``validation_issues``, so a report
    shows whether its input could be trusted; nothing is held back.
    """
    one = deduped(hands)
    found = written(quality.issues(one), "validation")
    det = detect(prepare_once(hands, keep))
    ok = quality.is_ok(found)
    return det.withColumns({"validation_ok": ok.select("ok").scalar(), "validation_issues": ok.select("issues").scalar()}), found


def tilt_detection(prep: DataFrame) -> DataFrame:
    """The play-style shift after losing runs as a detection (at most one row), with its worst run's first hand as example."""
    f = F.col
    one = streaks.tilt(prep.select("id", "date_utc", "amount_bb", "vpip")).withColumnRenamed("ev_real", "total")
    rep = prep.select(
        "id", "position", "phase", "opponent_type", "board_texture", "line_type", "line_street", "hero_name", f("stack_bb").alias("rep_stack_bb")
    )
    d = rep.join(F.broadcast(one), f("id") == f("hand_id"))
    evidence = F.array(
        F.concat(F.lit("streak_clusters="), "streaks"), F.concat(F.lit("max_streak="), "max_streak"),
        F.concat(F.lit("vpip_delta_post_loss="), fixed("vpip_delta", 3)), F.concat(F.lit("ev_decay_post_loss="), fixed("ev_delta", 3)),
    )
    unknown = F.lit("UNKNOWN")
    return d.select(
        "position", "phase", F.lit("TILT_PATTERN").alias("leak_code"), f("sample_size").cast("long").alias("sample_size"), f("total").alias("ev_real"),
        unknown.alias("stack_depth_bucket"), unknown.alias("stack_bucket"), "opponent_type", F.lit("Passive").alias("opponent_cluster"), "board_texture", "line_type",
        evidence.alias("evidence"), "deviation_pct", "confidence", "hand_id", "hero_name", "error_severity", *[F.lit(None).cast("double").alias(x) for x in ("metric", "benchmark", "showdown_rate", "bubble_factor", "ev_expected", "ev_delta")],
        F.lit("loss_streak + vpip_shift").alias("confidence_reason"), "rep_stack_bb", f("phase").alias("rep_phase"), f("opponent_type").alias("rep_opponent"),
        f("board_texture").alias("rep_texture"), f("line_street").alias("rep_line"), F.lit(fv.LEAK_CODES["TILT_PATTERN"][0]).alias("category"),
    )


def sizing_shares(prep: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """For every sizing column, the share of sizes above their own 90th percentile; rows with no size lower the share.

    All columns are unpivoted into (name, size), so their quantiles are one scan, whatever their number. The quantiles are one row for each
    column (and slice), so they are broadcast: joined by a shuffle, all play of a column would go to one task.
    """
    keys = [*extra, "size_name"]
    each = prep.select(*[c for c in prep.columns if c != "sizes"], F.inline("sizes"))
    q = exact_quantiles(each.select(*keys, "size"), keys, F.col("size"), {"q90": 0.9})
    return each.join(F.broadcast(q), keys).groupBy(*keys).agg(
        F.expr("avg(IF(size > q90, 1D, 0D))").alias("ratio"),
        F.expr("count(size)").alias("n"),
        F.expr("sum(IF(size IS NOT NULL, amount_bb, NULL))").alias("ev_real"),
        F.expr("avg(IF(size IS NOT NULL, showdown, NULL))").alias("showdown_rate"),
        _rep_min("rep", "size IS NOT NULL"),
    )


def sizing_detection(prep: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """A detection for every sizing column with too large a share of large sizes."""
    g = sizing_shares(prep, extra)
    names = ("stack_bucket", "m_stack_depth_bucket", "m_board_texture", "m_line_type", "position", "phase")
    g = g.withColumns({**{k: F.lit("UNKNOWN") for k in names}, "m_opponent_type": F.lit("unknown"), "grouping": F.lit("all"), "rep": F.col("rep.row")})
    rule = ("all", "ratio > 0.10D", "OVERBETTING", "ratio", "0.05D", 0.45, fv.MIN_SAMPLE, [("size_name", " high frequency", "ratio")], {})
    return g.select(*extra, "position", "phase", F.expr(f"explode(array_compact(array({compile_rule(rule)})))").alias("d")).select(*extra, "position", "phase", "d.*")


def score_detections(d: DataFrame) -> DataFrame:
    """Confidence, severity and expected value of raw rule hits."""
    f = F.col
    dev = F.abs(f("metric") - f("benchmark")) / F.when(f("benchmark") == 0, 1.0).otherwise(f("benchmark")) * 100.0
    n = f("sample_size").cast("double")
    d = d.withColumn("deviation_pct", dev)
    first = F.least(F.lit(1.0), F.lit(0.15) + n / (n + 40.0) + F.least(F.lit(0.25), f("deviation_pct") / 200.0))
    quiet = f("showdown_rate") < 0.35
    conf = F.when(quiet, F.least(F.lit(1.0), first + F.least(F.lit(0.20), f("deviation_pct") / 150.0))).otherwise(first)
    est = play.expected_value("rep.showdown", "rep.hero_cards", "rep.opponent_type", "rep.line_type", "rep.stack_bb", "rep.amount", "rep.big_blind")
    extra = F.array(
        F.when(quiet, F.concat(F.lit("freq_priority_no_showdown="), fixed("deviation_pct", 1), F.lit("%"))),
        F.concat(F.lit("showdown_rate="), fixed("showdown_rate", 2)),
        F.concat(F.lit("ev_source="), f("est.source")),
    )
    d = d.withColumn("confidence", conf).withColumn("est", est)
    return d.select(
        "*",
        f("rep.id").alias("hand_id"),
        f("rep.hero_name").alias("hero_name"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), f("base") * (F.lit(0.75) + f("confidence") / 2.0))).alias("error_severity"),
        f("est.expected_ev").alias("ev_expected"),
        (f("est.expected_ev") - f("est.real_ev")).alias("ev_delta"),
        f("est.note").alias("confidence_reason"),
        play.in_bb("rep.hero_stack_start", "rep.big_blind").alias("rep_stack_bb"),
        f("rep.phase").alias("rep_phase"), f("rep.opponent_type").alias("rep_opponent"),
        f("rep.board_texture").alias("rep_texture"), f("rep.line_street").alias("rep_line"),
        F.array_compact(F.concat(f("evidence"), extra)).alias("_ev"),
        play.lookup(f("leak_code"), {k: v[0] for k, v in fv.LEAK_CODES.items()}).alias("category"),
    ).withColumn("evidence", f("_ev")).drop("_ev", "est", "rep", "base")


DETECTION_ORDER = ["error_severity", "confidence", "sample_size"]


def ordered(detections: DataFrame) -> DataFrame:
    return detections.orderBy(*[F.col(x).desc() for x in DETECTION_ORDER], "leak_code", "position", "phase", "stack_bucket", "board_texture", "line_type")


# ---- contexts ---------------------------------------------------------------

CONTEXT_KEYS = [
    "leak_code", "hero_name", "network", "position", "stack_bucket", "stack_depth_bucket", "opponent_type", "opponent_cluster",
    "phase", "board_texture", "street", "line_type",
]


def contexts(detections: DataFrame, networks: dict[str, str] | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """One row per finding context with sample-weighted means.

    A context's loss is the group's net result, positive when it won.
    """
    f = F.col
    upper_seat = play.seat("position")
    blank = F.upper("phase") == "UNKNOWN"  # take the example row's own labels where the group has none

    def fill(x: str, missing: str, rep: str) -> Column:
        return F.when(blank & (f(x) == missing), f(rep)).otherwise(f(x))

    d = detections.select(
        *extra,
        "leak_code",
        F.coalesce(f("hero_name"), F.lit("UNKNOWN")).alias("hero_name"),
        play.network_of("hero_name", networks or {}).alias("network"),
        upper_seat.alias("position"),
        F.when(F.upper("stack_bucket") == "UNKNOWN", play.stack_band("rep_stack_bb")).otherwise(F.upper("stack_bucket")).alias("stack_bucket"),
        F.when(F.upper("stack_depth_bucket") == "UNKNOWN", play.stack_summary("rep_stack_bb")).otherwise(F.upper("stack_depth_bucket")).alias("stack_depth_bucket"),
        fill("opponent_type", "unknown", "rep_opponent").alias("opponent_type"),
        F.initcap(F.trim("opponent_cluster")).alias("opponent_cluster"),
        fill("phase", "UNKNOWN", "rep_phase").alias("phase"),
        fill("board_texture", "NO_BOARD", "rep_texture").alias("board_texture"),
        F.when(f("category") == "PREFLOP", "PREFLOP").otherwise("POSTFLOP").alias("street"),
        fill("line_type", "UNKNOWN", "rep_line").alias("line_type"),
        f("sample_size").cast("double").alias("w"),
        f("confidence"), f("ev_real"), f("ev_expected"), f("ev_delta"),
        (f("deviation_pct") / 100.0).alias("vop"),
        f("confidence_reason"),
        F.array_join("evidence", " | ").alias("evidence"),
    )

    def wmean(x: str, default=None) -> Column:
        ok = f(x).isNotNull() & (f("w") > 0)
        m = F.try_divide(F.sum(F.when(ok, f(x) * f("w"))), F.sum(F.when(ok, f("w"))))
        return m if default is None else F.coalesce(m, F.lit(default))

    keys = [*extra, *CONTEXT_KEYS]
    return d.groupBy(*keys).agg(
        F.round(F.sum("w")).cast("long").alias("frequency"),
        F.round(F.sum("w")).cast("long").alias("sample_size"),
        F.coalesce(F.try_divide(F.sum(f("confidence") * f("w")), F.sum("w")), F.lit(0.0)).alias("confidence"),
        F.sum(F.coalesce("ev_real", F.lit(0.0))).alias("total_ev_lost"),
        F.coalesce(F.try_divide(F.sum(F.coalesce("ev_real", F.lit(0.0))), F.sum("w")), F.lit(0.0)).alias("avg_loss_per_hand"),
        wmean("ev_expected").alias("ev_expected"),
        wmean("ev_real").alias("ev_real"),
        wmean("ev_delta").alias("ev_delta"),
        wmean("vop", 0.0).alias("vop_deviation"),
        F.lit(0.0).alias("cascade_rate"),
        F.array_join(F.array_sort(F.collect_set("confidence_reason")), "; ").alias("confidence_reason"),
        F.array_join(F.array_sort(F.collect_list("evidence")), " || ").alias("evidence"),
    )


# ---- severity ---------------------------------------------------------------


def severity(ctx: DataFrame, profiles: DataFrame | None = None, extra: Sequence[str] = (), k: float = fv.SHRINK_K) -> DataFrame:
    """Composite 0-100 severity with shrinkage, penalties, label and global rank.

    ``profiles`` (hero_name, network, roi, itm, early_finish_rate) boosts players in a known slump.
    The context table is small (bounded by the category combinations), so the rank window is too.
    """
    f = F.col
    by_all = Window.partitionBy(*extra) if extra else Window.partitionBy(F.lit(1))
    by_code = Window.partitionBy(*extra, "leak_code")
    s = ctx.withColumn("impact_scale", F.greatest(F.percentile("total_ev_lost", F.lit(0.9)).over(by_all), F.lit(1.0)))
    s = s.withColumn("baseline_loss", F.greatest(F.lit(0.0), F.median("avg_loss_per_hand").over(by_code)))
    n = f("sample_size").cast("double")
    loss = F.greatest(F.lit(0.0), f("total_ev_lost"))
    avg_loss = F.greatest(F.lit(0.0), f("avg_loss_per_hand"))
    s = s.withColumn("bayesian_ev_loss", n / (n + k) * avg_loss + F.lit(k) / (n + k) * f("baseline_loss"))
    bayes = f("bayesian_ev_loss")
    vop = clamp("vop_deviation", 0, 2)
    mult = (
        play.stack_weight("stack_depth_bucket")
        * play.lookup(f("position"), fv.SEVERITY_SEAT, 1.0)
        * play.lookup(f("phase"), fv.SEVERITY_PHASE, 1.0)
    )
    depth = F.upper("stack_depth_bucket")
    mult = F.when((f("phase") == "FINAL_TABLE") | depth.isin("20-25BB", "15-20BB"), mult * 2.0).otherwise(mult)
    difficulty = play.lookup(f("leak_code"), fv.REPAIR_DIFFICULTY, 0.60)
    ease = clamp(F.lit(1.0) - difficulty, 0, 1)
    ease = F.when(f("leak_code").isin(*fv.EASY_CODES), clamp(ease * 1.2, 0, 1)).otherwise(ease)
    seen = F.array_distinct(F.array("position", "stack_bucket", "stack_depth_bucket", "opponent_type", "phase", "board_texture", "line_type"))
    delta = F.coalesce(f("ev_delta"), F.lit(0.0))
    dist = F.when(f("ev_expected").isNotNull(), clamp(F.abs(delta) / F.greatest(loss, F.lit(1.0)), 0, 1)).otherwise(
        clamp(F.abs(bayes) / f("impact_scale"), 0, 1)
    )
    s = s.withColumn("context_multiplier", mult).withColumn("repair_difficulty", difficulty).withColumn("ease", ease)
    s = s.select(
        "*",
        F.size(seen).alias("distinct_context_values"),
        clamp(F.log1p(f("frequency").cast("double")) / F.log1p(F.lit(60.0)) * 100.0, 0, 100).alias("frequency_score"),
        clamp(bayes / f("impact_scale") * 100.0, 0, 100).alias("impact_score"),
        clamp((f("context_multiplier") - 0.8) * 100.0, 0, 100).alias("context_importance"),
        clamp(clamp(F.size(seen) / 7.0 * 100.0, 0, 100) * (F.lit(1.0) + F.least(F.lit(0.30), vop / 2.0)), 0, 100).alias("recurrence_score"),
        clamp(F.greatest(dist, F.least(F.lit(1.0), vop)), 0, 1).alias("distance_from_optimal"),
        clamp((f("context_multiplier") - 1.0) * 30.0 + f("ease") * 40.0 + clamp("cascade_rate", 0, 1) * 30.0, 0, 100).alias("cascade_score"),
    )
    parts = {
        "impact_ev": f("impact_score") * fv.W_IMPACT,
        "recurrence_volume": f("recurrence_score") * fv.W_RECURRENCE,
        "frequency": f("frequency_score") * fv.W_FREQUENCY,
        "context_stack_phase": f("context_importance") * fv.W_CONTEXT,
        "ease_of_fix": f("ease") * 100.0 * fv.W_DIFFICULTY,
        "distance_from_optimal": f("distance_from_optimal") * 100.0 * fv.W_DISTANCE,
        "cascade_effect": f("cascade_score") * fv.W_CASCADE,
    }
    raw = parts["frequency"] + parts["impact_ev"] + parts["recurrence_volume"] + parts["context_stack_phase"]
    raw = raw + parts["ease_of_fix"] + parts["distance_from_optimal"] + parts["cascade_effect"]
    parts["vop_deviation"] = F.least(F.lit(100.0), vop * 100.0) * 0.05
    penalty = F.when(f("sample_size") > 0, F.least(F.lit(1.0), n / 40.0)).otherwise(0.0)
    conf = clamp("confidence", 0, 1)
    score = clamp(raw * (F.lit(0.55) + F.lit(0.45) * penalty) * (F.lit(0.60) + F.lit(0.40) * conf), 0, 100)
    s = s.withColumn("_score", score)
    if profiles is not None:
        s = _slump_boost(s, profiles)
    capped = F.when((f("sample_size") < 12) | (f("confidence") < 0.45), F.least(f("_score"), F.lit(59.0))).otherwise(f("_score"))
    s = s.withColumn("severity_score", capped)
    label = None
    for at, name in fv.SEVERITY_LABELS:
        label = F.when(f("severity_score") >= at, name) if label is None else label.when(f("severity_score") >= at, name)
    label = label.otherwise(fv.SEVERITY_LOWEST)
    s = s.withColumn("_label", label).withColumn(
        "severity_label",
        F.when(f("sample_size") < 12, fv.SEVERITY_LOWEST).when((f("sample_size") < 20) & (f("_label") == "CRÍTICO"), "ALTO").otherwise(f("_label")),
    )
    gain = bayes * f("frequency")
    s = s.select(
        "*",
        F.when(f("severity_label").isin("CRÍTICO", "ALTO"), gain).otherwise(gain * 0.5).alias("potential_roi_gain"),
        (bayes * 100.0).alias("bayesian_bb100"),
        F.create_map(*[x for kv in ((F.lit(k_), F.round(v, 4)) for k_, v in parts.items()) for x in kv]).alias("components"),
        F.transform(
            F.slice(F.reverse(F.array_sort(F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(k_).alias("k")) for i, (k_, v) in enumerate(parts.items())]))), 1, 3),
            lambda x: F.concat(x["k"], F.lit("="), F.format_string("%.1f", x["v"])),
        ).alias("_top"),
    )
    order = [f("severity_score").desc(), f("confidence").desc(), f("sample_size").desc(), *[f(x) for x in CONTEXT_KEYS]]
    w = Window.partitionBy(*extra).orderBy(*order) if extra else Window.partitionBy(F.lit(1)).orderBy(*order)
    return s.withColumn("why_i_lost", F.array_join("_top", ", ")).withColumn("priority_rank", F.row_number().over(w)).drop("_score", "_label", "_top", "impact_scale")


def _slump_boost(s: DataFrame, profiles: DataFrame) -> DataFrame:
    f = F.col
    p = profiles.select(F.upper("hero_name").alias("_h"), F.upper("network").alias("_n"), "roi", "itm", "early_finish_rate")
    j = s.join(p, (F.upper(s.hero_name) == f("_h")) & (f("network").isin("", "UNKNOWN") | f("_n").isin("") | (F.upper(s.network) == f("_n"))), "left")
    depth = F.upper("stack_depth_bucket")
    small = clamp(
        F.when(f("leak_code").isin(*fv.SMALL_BALL_CODES), 0.35).otherwise(0.0)
        + F.when(F.upper("line_type").isin("SINGLE_RAISED_POT", "UNKNOWN", "CALL_LINE"), 0.10).otherwise(0.0)
        + F.when(f("position").isin("BTN", "CO", "SB", "BB"), 0.10).otherwise(0.0)
        + F.when(depth.isin("15-20BB", "20-25BB", "25-35BB"), 0.15).otherwise(0.0),
        0,
        1,
    )
    boost = (
        F.lit(1.0)
        + F.when(f("roi") <= -80.0, 0.12).otherwise(0.0)
        + F.when(f("itm") < 10.0, 0.10).otherwise(0.0)
        + F.when(f("early_finish_rate") >= 0.95, 0.08).otherwise(0.0)
        + small * 0.18
        + F.when(depth.isin("15-20BB", "20-25BB"), 0.14).otherwise(0.0)
        + F.when(f("leak_code").startswith("ICM_"), 0.10).otherwise(0.0)
    )
    boosted = F.when(f("_h").isNotNull(), clamp(f("_score") * boost, 0, 100)).otherwise(f("_score"))
    return j.withColumn("_score", boosted).drop("_h", "_n", "roi", "itm", "early_finish_rate")


# ---- study plan and report --------------------------------------------------


def representative_hands(detections: DataFrame, top_n: int = 5, extra: Sequence[str] = ()) -> DataFrame:
    """The strongest distinct example rows of every code, best first."""
    f = F.col
    keys = [*extra, "leak_code"]
    best = [f("error_severity"), f("confidence"), F.coalesce(F.abs("ev_delta"), F.lit(0.0))]
    one = detections.where(f("hand_id").isNotNull()).groupBy(*keys, "hand_id").agg(F.max(F.struct(*[b.alias(f"b{i}") for i, b in enumerate(best)])).alias("b"))
    w = Window.partitionBy(*keys).orderBy(f("b").desc(), f("hand_id"))
    top = one.withColumn("rn", F.row_number().over(w)).where(f("rn") <= top_n)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "hand_id"))), lambda x: x["hand_id"]).alias("representative_hand_ids"))


def study_plan(scores: DataFrame, detections: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    f = F.col
    ok = (f("sample_size") >= 12) & (f("confidence") >= 0.45) & f("severity_label").isin("CRÍTICO", "ALTO", "MÉDIO")
    weight = F.when(f("leak_code").isin(*fv.EASY_CODES), 1.30).when(f("leak_code").isin(*fv.COMPLEX_CODES), 0.85).otherwise(1.0)
    n = f("sample_size").cast("double")
    hours = 2.0 * play.lookup(f("severity_label"), fv.STUDY_HOURS, 1.0) * (F.lit(1.0) + F.least(F.lit(0.6), n / 100.0)) * (
        F.lit(1.0) + F.greatest(F.lit(0.0), F.lit(1.0) - f("confidence"))
    )
    evs = F.greatest(F.lit(0.0), f("bayesian_ev_loss")) * F.greatest(F.lit(1.0), n) * weight * F.greatest(F.lit(0.5), f("confidence"))
    focus = F.coalesce(play.lookup(f("leak_code"), fv.STUDY_FOCUS), F.concat(F.lit("Revisar "), f("leak_code")))
    p = scores.where(ok).select(
        *extra, "leak_code", "severity_label", "priority_rank", "position", "stack_depth_bucket", "sample_size", "confidence", "bayesian_bb100",
        "evidence", *[x for x in CONTEXT_KEYS if x not in ("leak_code", "position", "stack_depth_bucket")],
        F.concat(f("position"), F.lit(" vs field "), f("stack_depth_bucket")).alias("spot"),
        focus.alias("study_focus"),
        F.bround(clamp(hours, 0.5, 12.0), 1).alias("estimated_hours"),
        f("potential_roi_gain").alias("expected_roi_gain"),
        evs.alias("evs_score"),
    )
    order = [f("evs_score").desc(), f("expected_roi_gain").desc(), f("confidence").desc(), f("priority_rank")]
    w = Window.partitionBy(*extra).orderBy(*order) if extra else Window.partitionBy(F.lit(1)).orderBy(*order)
    reps = representative_hands(detections, extra=extra)
    return p.withColumn("priority", F.row_number().over(w)).join(reps, [*extra, "leak_code"], "left")


def recommendation_text(plan: DataFrame) -> DataFrame:
    f = F.col
    lead = F.array_join(F.slice(F.split("evidence", r"\s*\|\|\s*"), 1, 3), "; ")
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("PRIORIDADE "), f("priority_rank"), F.lit(": "), f("severity_label")),
        F.concat(F.lit("Leak: "), f("leak_code")),
        F.concat(F.lit("Contexto: "), f("position"), F.lit(" / "), f("stack_depth_bucket")),
        F.concat(F.lit("Foco: "), f("study_focus")),
        F.concat(F.lit("EV perdido estimado: "), fixed("expected_roi_gain", 2), F.lit(" bb")),
        F.concat(F.lit("Perda Bayesiana: "), fixed("bayesian_bb100", 2), F.lit(" bb/100")),
        F.concat(F.lit("Amostra: "), f("sample_size"), F.lit(" | Confiança: "), fixed("confidence", 2)),
        F.when(lead != "", F.concat(F.lit("Evidência: "), lead)),
    )
    return plan.withColumn("recommendation_text", lines)


def breakdown(ctx: DataFrame) -> DataFrame:
    """Counts and sample-weighted means by position, stack, phase and opponent in one pass."""
    f = F.col
    dims = {"position": "position", "stack_depth_bucket": "stack", "phase": "phase", "opponent_type": "opponent"}
    cols = list(dims)
    g = ctx.groupingSets([[F.col(x)] for x in cols], *cols).agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("count"),
        F.sum("total_ev_lost").alias("total_ev_lost"),
        F.sum("sample_size").alias("sample_size"),
        F.coalesce(F.try_divide(F.sum(f("confidence") * f("sample_size")), F.sum("sample_size").cast("double")), F.avg("confidence")).alias("avg_confidence"),
        F.coalesce(F.try_divide(F.sum(f("avg_loss_per_hand") * f("sample_size")), F.sum("sample_size").cast("double")), F.avg("avg_loss_per_hand")).alias("avg_loss_per_hand"),
    )
    kept = {0b0111: "position", 0b1011: "stack", 0b1101: "phase", 0b1110: "opponent"}
    return g.select(
        play.lookup(f("gid"), kept).alias("dimension"),
        F.coalesce(*cols).alias("value"),
        "count", "total_ev_lost", "sample_size", "avg_confidence", "avg_loss_per_hand",
    )


def severity_counts(scores: DataFrame) -> DataFrame:
    """Counts per label, zero rows included, without touching the data twice."""
    names = [n for _, n in fv.SEVERITY_LABELS] + [fv.SEVERITY_LOWEST]
    wide = scores.agg(*[count_where(F.col("severity_label") == n).alias(n) for n in names])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("severity_label"), F.coalesce(F.col(n), F.lit(0)).alias("n")) for n in names])).alias("r")).select("r.*")


def costly_spots(ctx: DataFrame, n: int = 10) -> DataFrame:
    return ctx.orderBy(F.col("total_ev_lost").desc(), *CONTEXT_KEYS).limit(n)


def report_metrics(hands: DataFrame, detections: DataFrame, ctx: DataFrame, scores: DataFrame, plan: DataFrame) -> DataFrame:
    """One-row executive summary joined from five small aggregates."""
    f = F.col
    h = hands.agg(
        F.count("*").alias("total_hands"),
        F.greatest(F.lit(0), -F.sum("won_cents")).alias("total_cents_lost"),
        rate(f("hero_result") == "win").alias("win_rate"),
    )
    one = [
        h,
        detections.agg(F.count("*").alias("leaks_detected")),
        ctx.agg(F.count("*").alias("contexts_analyzed")),
        scores.agg(
            count_where(f("severity_label") == "CRÍTICO").alias("critical_leaks"),
            count_where(f("severity_label") == "ALTO").alias("high_leaks"),
            F.sum("potential_roi_gain").alias("total_potential_gain"),
            F.sum(F.when(f("priority_rank") <= 10, f("potential_roi_gain"))).alias("top10_potential_gain"),
            F.max(F.when(f("priority_rank") == 1, f("leak_code"))).alias("top_leak"),
        ),
        plan.agg(
            F.sum("estimated_hours").alias("estimated_study_hours"),
            F.sum(F.when(f("priority") <= 5, f("estimated_hours"))).alias("recommended_study_hours"),
        ),
    ]
    out = one[0].withColumn("_k", F.lit(1))
    for o in one[1:]:
        out = out.join(o.withColumn("_k", F.lit(1)), "_k")
    warn = F.when(f("total_hands") == 0, "no_hands").when(f("total_hands") < 20, "small_sample").otherwise("")
    return out.withColumn("analysis_warning", warn).drop("_k")


def study_labels(detections: DataFrame, scores: DataFrame) -> DataFrame:
    """One label per example row: its code's score (the code's lowest-ranked context), most severe kept."""
    from tallyfold.operators.dedupe import label_per_fact

    f = F.col
    last = scores.groupBy("leak_code").agg(F.max_by(F.struct("severity_score", "severity_label", "priority_rank"), "priority_rank").alias("s"))
    lab = detections.join(last, "leak_code", "left").select(
        "hand_id",
        f("leak_code").alias("study_leak_code"),
        F.coalesce(f("s.severity_score"), F.lit(0.0)).alias("study_severity_score"),
        f("confidence").alias("study_confidence"),
        F.coalesce(f("s.severity_label"), F.lit("BAIXO")).alias("study_severity_label"),
        F.coalesce(f("s.priority_rank"), F.lit(999)).alias("study_priority_rank"),
    )
    return label_per_fact(lab)


def enrich_with_labels(hands: DataFrame, labels: DataFrame) -> DataFrame:
    f = F.col
    j = hands.join(labels.withColumnRenamed("hand_id", "id"), "id", "left")
    return j.withColumns({
        "study_leak_code": F.coalesce(f("study_leak_code"), F.lit("NONE")),
        "study_severity_score": F.coalesce(f("study_severity_score"), F.lit(0.0)),
        "study_confidence": F.coalesce(f("study_confidence"), F.lit(0.0)),
        "study_severity_label": F.coalesce(f("study_severity_label"), F.lit("BAIXO")),
        "study_priority_rank": F.coalesce(f("study_priority_rank"), F.lit(999)),
    })


def weekly_missions(enriched: DataFrame, top_n: int = 3) -> DataFrame:
    f = F.col
    loss = F.coalesce(F.try_divide(F.greatest(-f("won_cents"), F.lit(0)).cast("double"), F.nullif(f("big_blind"), F.lit(0))), F.lit(0.0))
    return (
        enriched.where(f("study_leak_code") != "NONE")
        .groupBy(f("study_leak_code").alias("topic"))
        .agg(
            F.min("study_priority_rank").alias("study_priority_rank"),
            F.round(F.max("study_severity_score"), 3).alias("study_severity_score"),
            F.round(F.avg("study_confidence"), 3).alias("study_confidence"),
            F.round(F.sum(loss), 3).alias("ev_loss_accumulated_bb"),
            F.count("*").alias("occurrences"),
        )
        .orderBy("study_priority_rank", f("ev_loss_accumulated_bb").desc())
        .limit(top_n)
    )
