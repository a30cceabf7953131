"""Cards, ranges, decisions, text parsing and leak rules on small rows."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import cards, play, vectors as vx
from tallyfold.operators import ranges
from tallyfold.plans import decisions as dc, entities, leaks as lk
from tallyfold.sources import play_log as pl, readers, sinks


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("AAs", "AA"), ("AAo", "AA"), ("AKs", "AKs"), ("KAo", "AKo"), ("JsAs", "AJs"), ("Ac6d", "A6o"), ("4c4h", "44"), ("AK", "AKs"), ("KA", "AKs"), ("77", "77"), ("xyz", "xyz")])
def test_labels(spark, raw, want):
    assert one(spark, cards.label_from_any(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("Ad 6d", "A6s"), ("Kh 3c", "K3o"), ("9c 9d", "99"), ("Ad", ""), ("Ad 6d 2c", ""), ("1d 6d", "")])
def test_pair_labels(spark, raw, want):
    assert one(spark, cards.label_from_pair(F.lit(raw))) == want


@pytest.mark.parametrize("board,want", [("", "NO_BOARD"), ("2h7d", "NO_BOARD"), ("2h5h9h", "MONOTONE"), ("2h 2d 9c", "PAIRED"), ("2h 2d 4c", "PAIRED_CONNECTED"), ("5h6h7d", "WET_CONNECTED"), ("2h 9h Kd", "WET"), ("5h 6d 7c", "CONNECTED"), ("2h 9d Kc", "DRY")])
def test_textures(spark, board, want):
    assert one(spark, cards.board_texture(F.lit(board))) == want


def test_all_labels_and_tiers(spark):
    d = ranges.label_dimension(spark)
    assert d.count() == 169 and d.select("label").distinct().count() == 169
    t = {r["label"]: r["tier"] for r in d.collect()}
    assert [t[h] for h in ("AA", "JJ", "99", "66", "A8s", "72o", "T8o", "K2o")] == [1, 2, 3, 4, 5, 6, 5, 6]


def test_range_ladders(spark):
    def labels(note, strict=True):
        return {r["label"] for r in ranges.expand_notation(spark, [("X", note)], strict).collect()}

    assert labels("JJ+") == {"JJ", "QQ", "KK", "AA"}
    assert labels("AJs+") == {"AKs", "AQs"} and labels("AJs+", False) == {"AKs", "AQs", "AJs"}
    assert labels("98s+") == set() and labels("98s+", False) == {"98s"}
    assert labels("T9s") == {"T9s"}


def test_nearest_depth_takes_the_first_on_ties(spark):
    d = {"BTN": [10, 20, 40]}
    assert [one(spark, ranges.nearest_depth(F.lit("BTN"), F.lit(float(s)), d)) for s in (15, 31, 300)] == [10, 40, 40]
    assert one(spark, ranges.nearest_depth(F.lit("UTG"), F.lit(15.0), d)) is None


def test_response_to_reraise(spark):
    def act(label, seat, stack):
        return one(spark, dc.against_3bet(F.lit(label), cards.tier_of(F.lit(label)), F.lit(seat), F.lit(float(stack)), F.lit(9.0)))

    assert [act("AA", "BTN", 80), act("KK", "CO", 20), act("AKs", "BTN", 30), act("JJ", "HJ", 80), act("77", "BTN", 80), act("77", "HJ", 80), act("72o", "BTN", 80)] == ["4-BET", "ALL-IN", "ALL-IN", "CALL", "CALL", "FOLD", "FOLD"]


def test_push_rule(spark):
    def go(label, stack, seat):
        return one(spark, dc.push(cards.tier_of(F.lit(label)), F.lit(float(stack)), F.lit(seat)))

    assert [go("77", 12, "BTN"), go("AA", 8, "SB"), go("JJ", 18, "UTG"), go("JJ", 18, "BTN"), go("66", 8, "BTN")] == [True, True, False, True, False]


def test_expected_value_guards(spark):
    def ev(sd, cards_, opp="maniaco", line="AGGRESSIVE_POSTFLOP", stack=10.0):
        return one(spark, play.expected_value(F.lit(sd), F.lit(cards_), F.lit(opp), F.lit(line), F.lit(stack), F.lit(-200.0), F.lit(100.0)))

    r = ev(0, "Ad Kd")
    assert r["source"] == "range_bridge" and r["expected_ev"] == pytest.approx(-0.05) and r["real_ev"] == -2.0 and r["confidence"] == pytest.approx(0.55)
    assert ev(1, "")["source"] == "no_cards" and ev(1, "Ad Kd")["source"] == "insufficient_context"


SPOT = (
    "id", "current_timestamp() AS date_utc", "1 AS hero_vpip", "0 AS hero_pfr", "0 AS went_to_showdown", "1000L AS hero_stack_start", "100L AS big_blind", "-100L AS won_cents",
    "'Ad Kd' AS hero_cards", "'BTN' AS hero_position", "15D AS m_ratio", "'2h 9d Kc' AS board_flop", "'calls' AS hero_action_preflop", "'' AS hero_action_flop", "'' AS hero_action_turn", "'' AS hero_action_river",
)


@pytest.mark.parametrize("n,fires", [(15, True), (20, False)])
def test_sizing_rule_is_a_small_sample_artefact(spark, n, fires):
    d = spark.range(n).selectExpr(*SPOT, "CAST(id AS DOUBLE) AS bet_size")
    r = lk.sizing_detection(lk.prepare(d)).collect()  # 2 of 15 lie above the interpolated 90th percentile, 2 of 20 do not exceed a tenth
    assert bool(r) is fires
    if fires:
        assert r[0]["metric"] == pytest.approx(2 / 15) and r[0]["sample_size"] == 15


def test_group_rules_need_their_minimum_sample(spark):
    def found(n):
        return {r["leak_code"] for r in lk.detect(lk.prepare(spark.range(n).selectExpr(*SPOT))).collect()}

    assert found(14) == set() and {"VPIP_LOOSE", "PFR_LOW", "CALL_EXCESSIVE"} <= found(15)


LOG = """Game Hand #9001 - Tournament #77 - Holdem(No Limit) - Level 4 (50.00/100.00) - 2024/01/05 10:20:30 UTC
Table 'T 1' 6-max Seat #3 is the button
Seat 1: Ann (1000.00)
Seat 3: Hero (2000.00)
Seat 5: Bob (1500.00)
Hero posts ante 10.00
Ann posts ante 10.00
Bob posts the small blind 50.00
Ann posts the big blind 100.00
*** HOLE CARDS ***
Dealt to Hero [Ah Kd]
Hero raises 200.00 to 250.00
Bob folds
Ann calls 150.00
*** FLOP *** [2h 7d Jc]
Ann checks
Hero bets 300.00 and is all-in
Ann folds
Hero collected 570.00 from main pot
*** SUMMARY ***
Total pot 570.00
Hero bets 1"""


def test_record_parser(spark):
    two = LOG + "\n\n" + LOG.replace("#9001", "#9002").replace("Dealt to Hero [Ah Kd]\n", "")
    blocks = pl.split_blocks(spark.createDataFrame([(two,)], "value string"))
    assert blocks.count() == 2
    r = pl.parse_records(blocks, "Hero").collect()
    assert len(r) == 1
    r = r[0]
    assert (r["hand_id"], r["hero_position"], r["num_players"], r["hero_cards"], r["board_flop"]) == ("9001", "BTN", 3, "Ah Kd", "2h 7d Jc")
    assert (r["hero_action_preflop"], r["hero_action_flop"]) == ("raises 250.00", "bets 300.00 (all-in)")
    assert (r["hero_vpip"], r["hero_pfr"], r["hero_aggressor"], r["hero_went_allin"], r["hero_result"], r["hero_amount_won"]) == (1, 1, 1, 1, "win", 570.0)
    assert r["m_ratio"] == pytest.approx(round(2000 / 180, 2)) and r["hero_stack_end"] == 2570.0


def test_block_actions_and_running_pot(spark):
    b = pl.split_blocks(spark.createDataFrame([(LOG,)], "value string")).withColumn("hand_id", F.lit("h"))
    a = pl.block_actions(b, "hand_id").orderBy("action_order").collect()
    assert [(x["actor_id"], x["action_type"], x["street"]) for x in a] == [("Hero", "RAISE", "PREFLOP"), ("Bob", "FOLD", "PREFLOP"), ("Ann", "CALL", "PREFLOP"), ("Ann", "CHECK", "FLOP"), ("Hero", "BET", "FLOP"), ("Ann", "FOLD", "FLOP")]
    assert [x["pot_size_before"] for x in a] == [170.0, 420.0, 420.0, 570.0, 570.0, 870.0] and [x["is_all_in"] for x in a] == [False] * 4 + [True, False]


def test_second_dialect(spark):
    text = "Mão PokerStars #5: Torneio\nAna: coloca ante 10\nAna: paga o small blind 25\nRui: aumenta 1,50 para 3,50\nAna: iguala 2,00\n*** FLOP *** [2h 7d Jc]\nAna: passa\n*** RESUMO ***\nAna: aposta 9"
    b = pl.split_blocks(spark.createDataFrame([(text,)], "value string")).withColumn("hand_id", F.lit("h"))
    a = pl.block_actions(b, "hand_id").orderBy("action_order").collect()
    assert [(x["actor_id"], x["action_type"], x["amount"], x["pot_size_before"]) for x in a] == [("Rui", "RAISE", 3.5, 35.0), ("Ana", "CALL", 2.0, 38.5), ("Ana", "CHECK", 0.0, 40.5)]


def test_large_logs_split_at_the_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n\n".join(LOG.replace("#9001", f"#{i}") for i in range(50)))
    d = readers.record_blocks(spark, str(tmp_path))
    assert d.count() == 50 and pl.parse_records(pl.split_blocks(d), "Hero").select("hand_id").distinct().count() == 50


def _hash_vector(text, dims=384):
    v = [0.0] * dims
    for i, tok in enumerate(text.lower().split()):
        for j, b in enumerate(hashlib.sha256(f"{i}:{tok}".encode()).digest()):
            v[(i * 131 + j * 17 + b) % dims] += (b - 127.5) / 127.5
    n = math.sqrt(sum(x * x for x in v))
    return v if n == 0 else [x / n for x in v]


def test_hash_embedding_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("n_chars").select("text").limit(20).union(spark.createDataFrame([("",), ("  a  B ",)], "text string"))
    for r in docs.select("text", vx.hash_embedding(F.col("text")).alias("e")).collect():
        assert r["e"] == pytest.approx(_hash_vector(r["text"]), abs=1e-9)


def test_long_sessions_are_cut_into_bounded_rows(spark):
    d = spark.range(1000).where("id <> 7").select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    s = vx.messages_to_sessions(d, 64)
    assert s.count() == 16 and s.agg(F.max(F.size("messages"))).first()[0] <= 64
    back = vx.sessions_to_messages(s)
    assert back.exceptAll(d.select("conv_id", "turn", "role", "text")).count() == 0 and back.count() == 999


def test_hud_line(spark):
    rows = [("V", "preflop", "call"), ("V", "preflop", "fold"), ("V", "flop", "bet"), ("W", "flop", "check"), (" ", "flop", "bet")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "name string, street string, action string, at int")
    lines = {r["name"]: r["hud"] for r in entities.hud_line(entities.with_rates(entities.accumulate(d))).collect()}
    assert lines == {"V": "[V] VPIP:50% PFR:0% 3B:0% F3B:100% AGG:100% (2 mãos)", "W": "[W] Sem histórico — primeiro encontro"}


def test_entity_merge_equals_one_pass(spark):
    d = spark.range(1000).select(F.concat(F.lit("v"), F.col("id") % 3).alias("name"), F.when(F.col("id") % 2 == 0, "preflop").otherwise("flop").alias("street"), F.when(F.col("id") % 5 < 2, "raise").otherwise("fold").alias("action"), F.col("id").alias("at"))
    parts = entities.merge(entities.accumulate(d.where("id < 400")), entities.accumulate(d.where("id >= 400")))
    whole = entities.accumulate(d).select(parts.columns)
    assert parts.exceptAll(whole).count() == 0


def test_upsert_keeps_unlisted_columns(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, s string, v int")
    new = spark.createDataFrame([(2, "z", 99), (3, "c", 30)], "k int, s string, v int")
    got = {r["k"]: (r["s"], r["v"]) for r in sinks.upsert(old, new, ["k"], ["v"]).collect()}
    assert got == {1: ("a", 10), 2: ("b", 99), 3: ("c", 30)}
    assert {r["k"]: r["v"] for r in sinks.insert_missing(old, new, ["k"]).collect()} == {1: 10, 2: 20, 3: 30}


def test_align_fills_and_casts(spark):
    d = spark.createDataFrame([("x", None), ("3", 2.5)], "a string, b double")
    r = readers.align(d, {"a": ("int", 0), "b": ("double", 1.0), "c": ("string", "none")}).collect()
    assert [tuple(x) for x in r] == [(0, 1.0, "none"), (3, 2.5, "none")]


def test_records_never_mix(spark):
    """A record that comes twice, and two records of the second dialect, each keep their own order and pot."""
    ps = "Mão PokerStars #{n}: T\nAna: coloca ante 10\nAna: aposta 5"
    values = [(LOG,), (LOG,), (ps.format(n=1),), (ps.format(n=2),)]
    b = pl.split_blocks(spark.createDataFrame(values, "value string").repartition(1)).withColumn("record", pl.record_key())
    acts = pl.block_actions(b, "record")
    a = acts.collect()
    assert sorted((x["record"], x["action_order"]) for x in a) == sorted([("acr:9001", i) for i in range(1, 7)] * 2 + [("ps:1", 1), ("ps:2", 1)])
    assert {x["pot_size_before"] for x in a if x["record"].startswith("ps")} == {10.0}
    assert "Exchange" not in acts._jdf.queryExecution().optimizedPlan().toString() and "Window" not in acts._jdf.queryExecution().optimizedPlan().toString()


def test_fingerprints_tell_data_apart(spark):
    """Pairs of repeated rows do not cancel out, nulls and columns do not stand in for each other, order does not count."""
    from tallyfold.plans import models as md

    tables = [
        [(1, "a"), (1, "a"), (2, "b")], [(9, "z"), (9, "z"), (2, "b")], [(2, "b")], [(None, "a"), (1, "a"), (2, "b")], [(1, None), (1, "a"), (2, "b")], [(1, "null"), (1, "a"), (2, "b")], [],
    ]
    version = lambda rows: md.fingerprint(spark.createDataFrame(rows, "k int, v string")).first()["dataset_version"]
    assert len({version(t) for t in tables}) == len(tables) and version(tables[0]) == version(tables[0][::-1])


def test_recall_with_several_queries_in_a_partition(spark):
    from tallyfold.functions import vectors as vx

    memories = spark.createDataFrame([("p", i, [1.0, float(i)]) for i in range(10)], "key string, id int, v array<double>")
    got = vx.recall(memories, memories.where("id in (0, 9)"), "key", "v", "id", k=3)
    by = {q: [r["id"] for r in got.where(f"query_id = {q}").orderBy("rank").collect()] for q in (0, 9)}
    assert by == {0: [0, 1, 2], 9: [9, 8, 7]}
