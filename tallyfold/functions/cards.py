"""Card labels, board textures and starting-hand dimensions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyfold.functions import fixed_values as fv
from tallyfold.functions.numeric import c

RANKS = "AKQJT98765432"  # high to low
_LOW_FIRST = RANKS[::-1]


def _at(s: Column, i: int) -> Column:
    return F.substring(s, i, 1)


def _strength(rank: Column, ranks: str = RANKS) -> Column:
    """1 for the ace down to 13 for the deuce; 0 where not a rank."""
    return F.when(F.length(rank) == 1, F.instr(F.lit(ranks), rank)).otherwise(0)


def _label(r1: Column, r2: Column, kind: Column) -> Column:
    hi = F.when(_strength(r1) > _strength(r2), r2).otherwise(r1)
    lo = F.when(_strength(r1) > _strength(r2), r1).otherwise(r2)
    return F.when(r1 == r2, F.concat(r1, r1)).otherwise(F.concat(hi, lo, kind))


def label_from_pair(cards) -> Column:
    """'Ad 6d' -> 'A6s'; anything but two readable cards gives ''."""
    parts = F.split(F.trim(c(cards)), r"\s+")
    a, b = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    r1, r2 = F.upper(_at(a, 1)), F.upper(_at(b, 1))
    ok = (F.size(parts) == 2) & (F.length(a) >= 2) & (F.length(b) >= 2) & (_strength(r1) > 0) & (_strength(r2) > 0)
    same = F.lower(_at(a, 2)) == F.lower(_at(b, 2))
    return F.when(ok, _label(r1, r2, F.when(same, "s").otherwise("o"))).otherwise("")


def label_from_any(hand) -> Column:
    """Canonical label from 2-, 3- or 4-character notation; unreadable text is returned as is."""
    h = F.trim(c(hand))
    n = F.length(h)
    r1, r2 = F.upper(_at(h, 1)), F.upper(_at(h, 2))
    ranks2 = (_strength(r1) > 0) & (_strength(r2) > 0)
    q = F.lower(_at(h, 3))
    three = F.when(ranks2 & ((r1 == r2) | q.isin("s", "o")), _label(r1, r2, q)).otherwise(h)
    r4 = F.upper(_at(h, 3))
    s1, s2 = F.lower(_at(h, 2)), F.lower(_at(h, 4))
    ok4 = (_strength(r1) > 0) & (_strength(r4) > 0) & s1.isin(*"hdcs") & s2.isin(*"hdcs")
    four = F.when(ok4, _label(r1, r4, F.when(s1 == s2, "s").otherwise("o"))).otherwise(h)
    two = F.when(ranks2, _label(r1, r2, F.lit("s"))).otherwise(h)
    return F.when(n == 3, three).when(n == 4, four).when(n == 2, two).otherwise(h)


def parse_board(board) -> Column:
    """Board text to an array of cards: spaced, packed or fixed-width."""
    t = F.trim(F.coalesce(c(board), F.lit("")))
    spaced = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    packed = F.regexp_extract_all(t, F.lit(r"([2-9TJQKA][hdcsHDCS])"), F.lit(1))
    pairs = F.regexp_extract_all(t, F.lit(r"(..)"), F.lit(1))
    none = F.array().cast("array<string>")
    return (
        F.when(t == "", none)
        .when(t.contains(" "), spaced)
        .when(F.size(packed) > 0, packed)
        .when(F.length(t).isin(6, 8, 10), pairs)
        .otherwise(none)
    )


def suits_of(cards: Column) -> Column:
    return F.transform(F.filter(cards, lambda x: F.length(x) >= 2), lambda x: F.lower(F.substring(x, 2, 1)))


def ranks_of(cards: Column) -> Column:
    return F.transform(F.filter(cards, lambda x: F.length(x) >= 2), lambda x: F.upper(F.substring(x, 1, 1)))


def board_texture(board) -> Column:
    """Eight-way texture from any board notation."""
    return texture_of(parse_board(board))


def texture_of(cards: Column) -> Column:
    """Eight-way texture of an array of cards."""
    return texture_from(F.size(cards), ranks_of(cards), suits_of(cards), rank_places(ranks_of(cards)))


def rank_places(ranks: Column) -> Column:
    return F.filter(F.transform(ranks, lambda r: F.instr(F.lit(_LOW_FIRST), r)), lambda i: i > 0)


def texture_from(n_cards: Column, ranks: Column, suits: Column, idx: Column) -> Column:
    """The texture ladder over prepared arrays (columns of their own when rows are many)."""
    paired = F.size(F.array_distinct(ranks)) < F.size(ranks)
    n_suits = F.size(F.array_distinct(suits))
    close = (F.size(idx) >= 3) & ((F.array_max(idx) - F.array_min(idx)) <= 4)
    return (
        F.when(n_cards < 3, "NO_BOARD")
        .when(n_suits == 1, "MONOTONE")
        .when(paired & close, "PAIRED_CONNECTED")
        .when(paired, "PAIRED")
        .when((n_suits == 2) & close, "WET_CONNECTED")
        .when(n_suits == 2, "WET")
        .when(close, "CONNECTED")
        .otherwise("DRY")
    )


def board_texture_code(flop) -> Column:
    """0 none, 1 dry, 2 two-suited, 3 paired, 4 one suit; reads spaced cards only."""
    t = F.trim(F.coalesce(c(flop), F.lit("")))
    cards = F.filter(F.split(t, r"\s+"), lambda x: F.length(x) >= 2)
    suits = F.transform(cards, lambda x: F.lower(F.right(x, F.lit(1))))
    ranks = F.transform(cards, lambda x: F.upper(F.substring(x, F.lit(1), F.length(x) - 1)))
    n_suits = F.size(F.array_distinct(suits))
    return (
        F.when(t == "", 0)
        .when(F.size(F.split(t, r"\s+")) < 3, 1)
        .when(n_suits == 1, 4)
        .when(F.size(F.array_distinct(ranks)) < F.size(ranks), 3)
        .when(n_suits == 2, 2)
        .otherwise(1)
    )


def board_texture_simple(board) -> Column:
    """monotone / paired / wet / dry over all cards on the table."""
    cards = parse_board(board)
    ranks, suits = ranks_of(cards), suits_of(cards)
    idx = F.array_sort(F.array_distinct(F.transform(ranks, lambda r: F.instr(F.lit(_LOW_FIRST), r))))
    n = F.size(idx)
    run = F.exists(
        F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: (F.element_at(idx, i + 2) - F.element_at(idx, i)) <= 3,
    )
    return (
        F.when(F.size(cards) == 0, "dry")
        .when(F.size(F.array_distinct(suits)) == 1, "monotone")
        .when(F.size(F.array_distinct(ranks)) < F.size(ranks), "paired")
        .when(F.size(F.array_distinct(suits)) < F.size(suits), "wet")
        .when(run, "wet")
        .otherwise("dry")
    )


def tier_of(label: Column) -> Column:
    """Tier 1-6 of a starting-hand label; 0 where the label is not a starting hand."""
    known = {h: t for t, hands in fv.TIERS.items() for h in hands.split()}
    found = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    ok = label.rlike("^([2-9TJQKA])\\1$") | (
        label.rlike("^[2-9TJQKA]{2}[so]$") & (_strength(_at(label, 1)) < _strength(_at(label, 2)))
    )
    return F.when(ok, F.coalesce(F.try_element_at(found, label), F.lit(6))).otherwise(0)


def all_labels() -> list[tuple[str, int, int, str]]:
    """The 169 starting hands as (label, high index, low index, kind), by rule."""
    out = []
    for i, hi in enumerate(RANKS):
        out.append((hi + hi, i, i, "p"))
        for j in range(i + 1, len(RANKS)):
            out += [(hi + RANKS[j] + k, i, j, k) for k in ("s", "o")]
    return out
