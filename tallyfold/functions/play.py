"""Row-level play classifications: seats, stacks, phases, actions, lines, opponents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyfold.functions import fixed_values as fv
from tallyfold.functions.numeric import c, clamp, finite, safe_div

STREETS = ["hero_action_preflop", "hero_action_flop", "hero_action_turn", "hero_action_river"]


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small constant table as a CASE ladder."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def seat(position) -> Column:
    p = F.upper(F.trim(F.coalesce(c(position), F.lit("UNKNOWN"))))
    named = F.coalesce(lookup(p, fv.SEAT_ALIASES), p)
    return F.when(named == "", "UNKNOWN").otherwise(named)


def _band(value: Column, pick: int) -> Column:
    out = None
    for lo, hi, label, summary in fv.STACK_BANDS:
        hit = (value >= lo) if hi == fv.INF else (value >= lo) & (value < hi)
        name = F.lit((label, summary)[pick])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(("50bb+", "HIGH")[pick])


def band_sql(col: str, pick: int) -> str:
    """The band ladder as SQL text over a clean column."""
    rows = [f"WHEN {col} >= {lo} AND {col} < {hi} THEN '{(a, b)[pick]}'" for lo, hi, a, b in fv.STACK_BANDS if hi != fv.INF]
    return f"CASE {' '.join(rows)} ELSE '{('50bb+', 'HIGH')[pick]}' END"


def seat_sql(col: str) -> str:
    p = f"upper(trim(coalesce({col}, 'UNKNOWN')))"
    return f"CASE {p} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.SEAT_ALIASES.items()) + f" WHEN '' THEN 'UNKNOWN' ELSE {p} END"


def stack_band(stack_bb) -> Column:
    return _band(finite(stack_bb), 0)


def stack_summary(stack_bb) -> Column:
    return _band(finite(stack_bb), 1)


def m_zone(m) -> Column:
    """Zone by m-ratio; missing, negative and very large values count as green."""
    v = c(m).cast("double")
    out = None
    for name, lo, hi in fv.M_ZONES:
        hit = (v >= lo) & (v < hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("green")


def phase(m, explicit=None) -> Column:
    v = finite(m)
    out = F.when(v <= 0, "UNKNOWN")
    for above, name in fv.PHASES_BY_M:
        out = out.when(v > above, name)
    out = out.otherwise("FINAL_TABLE")
    if explicit is None:
        return out
    e = F.upper(F.trim(F.coalesce(c(explicit), F.lit(""))))
    return F.when(e.isin(*fv.PHASES), e).otherwise(out)


def bubble_factor(stack_bb, phase_col) -> Column:
    s, p = finite(stack_bb), F.upper(F.coalesce(c(phase_col), F.lit("")))
    premium = F.when(s < 10, 0.18).when(s < 15, 0.25).when(s < 25, 0.34).when(s < 35, 0.24).otherwise(0.18)
    premium = F.when(p == "FINAL_TABLE", premium + 0.08).otherwise(premium)
    return F.when(~p.isin(*fv.LATE_PHASES) | (s <= 0), 1.0).otherwise(F.lit(1.0) + premium)


def stack_weight(summary) -> Column:
    return lookup(F.upper(F.coalesce(c(summary), F.lit(""))), fv.STACK_WEIGHT, 1.0)


def distance_penalty(distance) -> Column:
    return clamp(F.lit(1.0) - finite(distance), 0, 1)


def in_bb(amount, big_blind) -> Column:
    """Amount in big blinds; blinds below one count as one."""
    return finite(amount) / F.greatest(finite(big_blind, 1.0), F.lit(1.0))


def action_class(text) -> Column:
    a = F.lower(F.coalesce(c(text), F.lit("")))
    has = a.contains
    return (
        F.when(has("all-in") | has("all in"), "allin")
        .when(has("raises") | has("bets"), "raise")
        .when(has("calls"), "call")
        .when(has("checks"), "check")
        .when(has("folds") | has("desiste"), "fold")
        .otherwise("")
    )


def training_action(text) -> Column:
    """FOLD / CALL / RAISE label, null where the text says nothing."""
    a = F.upper(F.trim(F.coalesce(c(text), F.lit(""))))
    return (
        F.when(a.contains("ALL") & a.contains("IN"), "RAISE")
        .when(a.startswith("FOLD"), "FOLD")
        .when(a.startswith("CALL") | a.startswith("CHECK"), "CALL")
        .when(a.rlike("RAISE|BET|RFI"), "RAISE")
    )


def chart_action(text) -> Column:
    """ALL-IN / FOLD / CALL / BET, anything else FOLD."""
    a = F.upper(F.coalesce(c(text), F.lit("")))
    return (
        F.when(a.contains("ALL") & a.contains("IN"), "ALL-IN")
        .when(a.contains("FOLD"), "FOLD")
        .when(a.rlike("CALL|FLAT"), "CALL")
        .when(a.rlike("RAISE|RFI|BET"), "BET")
        .otherwise("FOLD")
    )


def contract_action(action, detail) -> Column:
    """Four-action contract from an action and its longer decision text."""
    a = F.upper(F.trim(F.coalesce(c(action), F.lit(""))))
    d = F.upper(F.trim(F.coalesce(c(detail), F.lit(""))))
    bet = "BET|RAISE|RFI"
    return (
        F.when((a.contains("ALL") & a.contains("IN")) | (d.contains("ALL") & d.contains("IN")), "ALL-IN")
        .when(a.startswith("FOLD") | d.startswith("FOLD"), "FOLD")
        .when(a.startswith("CALL") | a.contains("FLAT") | d.contains("CALL") | d.contains("FLAT"), "CALL")
        .when(a.rlike(bet) | d.rlike(bet), "BET")
        .otherwise("FOLD")
    )


def color_of(action: Column) -> Column:
    return F.when(action == "ALL-IN", "PURPLE_ALLIN").when(action == "FOLD", "RED_FOLD").otherwise("GREEN_INTENSE")


def color_with_value(decision, ev) -> Column:
    """Colour ladder that also looks at a numeric value: losing decisions turn red."""
    d = F.trim(F.element_at(F.split(F.upper(F.coalesce(c(decision), F.lit(""))), r" \| "), 1))
    return (
        F.when(d.contains("ALL IN") | d.contains("ALL-IN"), "PURPLE_ALLIN")
        .when(d.startswith("FOLD"), "RED_FOLD")
        .when(c(ev) <= 0, "RED_FOLD")
        .otherwise("GREEN_INTENSE")
    )


def normal_action(text) -> Column:
    t = F.upper(F.trim(F.coalesce(c(text), F.lit(""))))
    t = F.replace(t, F.lit("→"), F.lit(":"))
    t = F.replace(t, F.lit("BET/RAISE"), F.lit("RAISE"))
    return F.replace(t, F.lit("ALL IN"), F.lit("ALL-IN"))


def action_list(streets=STREETS) -> Column:
    """The non-empty street actions, normalised, in street order."""
    return F.filter(F.array(*[normal_action(s) for s in streets]), lambda a: a != "")


def line_type(acts: Column | None = None) -> Column:
    """Line over the non-empty street actions; the first non-empty one counts as the opening action."""
    acts = action_list() if acts is None else acts
    first = F.coalesce(F.try_element_at(acts, F.lit(1)), F.lit(""))
    later_bet = F.exists(F.slice(acts, 2, 4), lambda a: a.contains("BET"))
    return (
        F.when(F.size(acts) == 0, "UNKNOWN")
        .when(F.exists(acts, lambda a: a.contains("ALL-IN")), "JAM")
        .when(first.contains("3BET") | first.contains("4BET"), "3BET_POT")
        .when(first.rlike("RAISE|BET") & later_bet, "AGGRESSIVE_POSTFLOP")
        .when(first.rlike("RAISE|BET"), "AGGRESSIVE_PREFLOP")
        .when(first.contains("CALL") & later_bet, "CALL_LEAD")
        .when(F.forall(acts, lambda a: a.rlike("CHECK|FOLD")), "PASSIVE")
        .otherwise("MIXED")
    )


def line_type_by_street(streets=STREETS) -> Column:
    """Second line ladder: streets keep their place and calls get their own label."""
    a = [F.upper(F.coalesce(c(s), F.lit(""))) for s in streets]
    arr = F.array(*a)
    return (
        F.when(F.forall(arr, lambda x: x == ""), "UNKNOWN")
        .when(F.exists(arr, lambda x: x.contains("ALL-IN")), "JAM")
        .when(a[0].contains("3BET") | a[0].contains("4BET"), "3BET_POT")
        .when(F.exists(F.array(*a[1:]), lambda x: x.contains("BET")), "AGGRESSIVE_POSTFLOP")
        .when(F.exists(arr, lambda x: x.contains("CALL")), "CALL_LINE")
        .when(F.forall(arr, lambda x: x.rlike("CHECK|FOLD") | (x == "")), "PASSIVE")
        .otherwise("MIXED")
    )


def opponent_type(vpip, pfr, agg, f3b, wtsd, stack, big_blind) -> Column:
    raw = [finite(x, -1.0) for x in (vpip, pfr, agg, f3b, wtsd)]
    return opponent_from(raw, in_bb(stack, big_blind))


def opponent_from(rates: list[Column], depth: Column) -> Column:
    """The opponent ladder over clean rates, -1 where unknown."""
    seen = F.greatest(*rates) >= 0
    v, p, a, f, w = [F.greatest(x, F.lit(0.0)) for x in rates]
    return (
        F.when(~seen, "unknown")
        .when((v >= 0.45) & (p <= 0.12), "calling station")
        .when((v >= 0.40) & (p >= 0.25) & (a >= 0.60), "maniaco")
        .when((v <= 0.22) & (p >= 0.18) & (a >= 0.50), "reg agressivo")
        .when((v <= 0.20) & (f >= 0.60), "fit-or-fold")
        .when((v >= 0.35) & (p <= 0.10) & (w >= 0.35), "passive")
        .when((v <= 0.18) & (p <= 0.08), "overfolder")
        .when((depth <= 20) & (a >= 0.50), "short stack pressionador")
        .when((v >= 0.28) & (p <= 0.16), "recreativo")
        .otherwise("unknown")
    )


def cascade_score(flop, turn, river, amount) -> Column:
    f, t, r = [F.upper(F.coalesce(c(x), F.lit(""))) for x in (flop, turn, river)]
    early = f.rlike("BET|RAISE")
    quit_ = "CHECK|FOLD"
    return clamp(
        F.when(early & t.rlike(quit_), 0.45).otherwise(0.0)
        + F.when(early & r.rlike(quit_), 0.35).otherwise(0.0)
        + F.when(finite(amount) < 0, 0.20).otherwise(0.0),
        0,
        1,
    )


def range_value(opponent, line, stack_bb, amount, big_blind) -> Column:
    """Expected value without a showdown: baseline by opponent and line plus a stack term."""
    o = F.lower(F.trim(F.coalesce(c(opponent), F.lit("unknown"))))
    ln = F.upper(F.trim(F.coalesce(c(line), F.lit("UNKNOWN"))))
    base = None
    for (who, how), v in fv.RANGE_EV.items():
        hit = (o == who) & (ln == how)
        base = F.when(hit, v) if base is None else base.when(hit, v)
    base = base.otherwise(0.0)
    depth = stack_summary(stack_bb)
    conf = F.when(o != "unknown", 0.55).otherwise(0.40) + F.when(ln.isin("3BET_POT", "JAM"), 0.10).otherwise(0.0)
    note = F.concat(F.lit("range bridge: opp="), o, F.lit(", line="), ln, F.lit(", stack="), depth)
    return F.struct(
        (base + lookup(depth, fv.RANGE_EV_STACK, 0.0)).alias("expected_ev"),
        in_bb(amount, big_blind).alias("real_ev"),
        F.lit("range_bridge").alias("source"),
        clamp(conf, 0.20, 0.80).alias("confidence"),
        note.alias("note"),
    )


def expected_value(showdown, cards, opponent, line, stack_bb, amount, big_blind) -> Column:
    """Expected-value dispatch. Rows that reached showdown without sizes get a reason code."""
    bb = finite(big_blind)
    real = F.when(bb > 0, finite(amount) / F.when(bb > 0, bb)).otherwise(finite(amount))

    def none(source: str, note: str) -> Column:
        return F.struct(
            F.lit(None).cast("double").alias("expected_ev"), real.alias("real_ev"), F.lit(source).alias("source"),
            F.lit(0.0).alias("confidence"), F.lit(note).alias("note"),
        )

    return (
        F.when(finite(showdown) == 0, range_value(opponent, line, stack_bb, amount, big_blind))
        .when(F.coalesce(c(cards), F.lit("")) == "", none("no_cards", "Hero cards ausentes"))
        .otherwise(none("insufficient_context", "Contexto insuficiente para EV esperado"))
    )


def participation_deviation(observed, baseline) -> Column:
    o, b = clamp(observed, 0, 1), clamp(baseline, 0, 1)
    return F.when(b <= 0, 0.0).otherwise(F.abs(o - b) / F.when(b > 0, b))


def network_of(hero_name, networks: dict[str, str]) -> Column:
    """Network by player name from a caller-given table; unlisted names are UNKNOWN."""
    return lookup(F.upper(F.coalesce(c(hero_name), F.lit("UNKNOWN"))), networks or {"": "UNKNOWN"}, "UNKNOWN")


def bet_for_equity(pot, equity_pct) -> Column:
    share = F.when(c(equity_pct) >= 70, 0.75).when(c(equity_pct) >= 55, 0.50).otherwise(0.33)
    return F.round(c(pot) * share, 1)


def pot_odds(pot, call) -> Column:
    return F.when(c(pot) + c(call) <= 0, 0.33).otherwise(F.try_divide(c(call), c(pot) + c(call)))


def value_to_factor(ev, big_blind) -> Column:
    return F.lit(1.0) + F.greatest(F.lit(-0.5), F.least(F.lit(0.5), c(ev) / (F.greatest(finite(big_blind), F.lit(1.0)) * 10)))


def adjustment_gate(factor: Column, win_prob: Column, confidence: Column, samples: Column) -> Column:
    """Neutral factor (abstain) on weak evidence or a neutral signal."""
    weak = (confidence == "low") | (samples < 120)
    neutral = (F.abs(win_prob - 0.5) <= 0.06) & factor.between(0.95, 1.05)
    return F.struct(
        F.when(weak | neutral, 1.0).otherwise(F.round(factor, 3)).alias("factor"),
        F.when(weak | neutral, "abstain").otherwise(confidence).alias("confidence"),
    )
