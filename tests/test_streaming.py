"""Streams over several files: idempotence, state across batches, late rows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyfold.plans import requests as rq
from tallyfold.streaming import drains, play as sp


@pytest.fixture()
def landing(spark, tmp_path):
    """Three files of the same shape, landed in order; the last repeats earlier keys."""

    def land(rows, schema):
        seen = set()
        for i, part in enumerate(rows):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            for f in set((tmp_path / "in").glob("*.parquet")) - seen:
                os.utime(f, (1_700_000_000 + i * 60,) * 2)
                seen.add(f)
        return drains.files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, per_batch=1)

    return land


def test_ingest_is_idempotent(landing, tmp_path):
    s = landing([[("a", 1), ("b", 2)], [("b", 2), ("c", 3)], [("a", 1)]], "hand_id string, v int")
    base = str(tmp_path / "run")
    assert {r["hand_id"] for r in sp.ingest(s, "hand_id", base).collect()} == {"a", "b", "c"}
    assert sp.ingest(s, "hand_id", base).count() == 3  # nothing new on a second run


def test_settings_survive_batches(spark, landing, tmp_path):
    t = [dt.datetime(2024, 1, 1, 10, i) for i in range(6)]
    rows = [[(1, 0, t[0], "SET BB=100")], [(1, 1, t[1], "AKs BTN 2 40 N"), (2, 2, t[2], "AKs BTN 2 40 N")], [(1, 3, t[3], "SET ANTE=5"), (1, 4, t[4], "QQ CO 2 40 N")]]
    s = landing(rows, "session_id long, request_id long, received_at timestamp, line string")
    got = {r["request_id"]: (r["bb"], r["ante"]) for r in sp.session_settings(s, str(tmp_path / "run")).collect()}
    assert got == {0: (100.0, None), 1: (100.0, None), 2: (None, None), 3: (100.0, 5.0), 4: (100.0, 5.0)}


def test_counters_accumulate(landing, tmp_path):
    rows = [[(1, 1, dt.datetime(2024, 1, 1), 10, "AA BTN 2 40 N")], [(1, 2, dt.datetime(2024, 1, 1), 30, "72o BTN 2 40 N")]]
    s = landing(rows, "session_id long, request_id long, received_at timestamp, latency_us long, line string")
    r = sp.session_counters(sp.request_scores(s), str(tmp_path / "run")).first()
    assert (r["requests"], r["avg_latency_us"], r["green"], r["red"]) == (2, 20.0, 1, 1)


def test_late_rows_count(landing, tmp_path):
    day = lambda d, h=1: dt.datetime(2024, 1, d, h)
    rows = [[(1, "win", 1, 0, 5, day(1))], [(1, "win", 1, 0, 5, day(9))], [(1, "win", 1, 0, 5, day(9, 2))], [(1, "win", 1, 0, 5, day(1, 2))]]
    s = landing(rows, "hero_id long, hero_result string, hero_vpip int, hero_pfr int, won_cents long, at timestamp")
    got = {r["date"]: r["hands"] for r in drains.updates(sp.daily_trend(s, "at"), "x", ["date"], str(tmp_path / "run")).collect()}
    assert got == {"2024-01-01": 2, "2024-01-09": 2}


def test_repeats_inside_the_cool_down(landing, tmp_path):
    t = dt.datetime(2024, 1, 1, 10)
    later = [[("q", "x", t + dt.timedelta(seconds=n))] for n in (40, 50)]
    rows = [[("p", "s", t + dt.timedelta(seconds=60))], *later, [("p", "s", t), ("p", "s", t + dt.timedelta(seconds=2))], [("p", "other", t)]]
    s = landing(rows, "path string, sha string, at timestamp")
    got = sorted((r["sha"], r["copies"]) for r in sp.drop_repeats(s, "at", ["path", "sha"], base=str(tmp_path / "run")).where("path = 'p'").collect())
    assert got == [("other", 1), ("s", 1), ("s", 2)]


STREAMS = sorted(n for n in entry.queries() if "bounded" not in n and (n.startswith("r0") and "stream" in n or n.startswith(("r02", "r09"))))  # bounded ones: test_bounded.py


@pytest.mark.parametrize("name", STREAMS)
def test_one_file_and_four_give_the_same(spark, sf, four_files, name):
    """Four shuffled files of the same rows, one per batch, give what one file gives."""
    one, four = (sorted(map(str, entry.queries()[name](spark, d).collect())) for d in (sf, four_files))
    assert one == four and one


@pytest.fixture(scope="module")
def four_files(spark, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("four")
    for n in os.listdir(sf):
        if not n.startswith("events"):
            os.symlink(f"{sf}/{n}", d / n)
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(4):  # no order of time in or between the files
        events.where(F.pmod(F.hash("event_id"), F.lit(4)) == k).coalesce(1).orderBy(F.rand(k)).write.mode("append").parquet(f"{d}/events.parquet")
    return str(d)


def test_logs_that_come_again(spark, tmp_path):
    """New, repeated and modified records, and text before the first header, over several batches."""
    head = "Game Hand #{n} - Tournament #5 - Holdem (No Limit) - Level 2 (50.00/100.00) - 2024/01/02 10:20:30 UTC\nTable 't' 4-max Seat #1 is the button\nSeat 1: Ann (1000.00)\nSeat 2: Hero (2000.00)\n*** HOLE CARDS ***\nDealt to Hero [Ah Kd]\n"
    acts = {"a": "Ann folds\n", "b": "Ann folds\nHero calls 200\n"}
    files = [("1", "stray text\n" + head.format(n=1) + acts["a"] + "\n" + head.format(n=2) + acts["a"]), ("2", head.format(n=1) + acts["b"]), ("3", head.format(n=3) + acts["b"] + "\n" + head.format(n=3) + acts["b"])]
    for i, (n, text) in enumerate(files):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.txt").write_text(text)
        os.utime(tmp_path / "in" / f"{n}.txt", (1_700_000_000 + 60 * i,) * 2)
    facts, actions = sp.ingest_logs(spark, str(tmp_path / "in"), "Hero", str(tmp_path / "run"), per_batch=1)
    assert sorted(r["hand_id"] for r in facts.collect()) == ["1", "2", "3"]
    assert {r["record"]: r["count"] for r in actions.groupBy("record").count().collect()} == {"acr:1": 2, "acr:2": 1, "acr:3": 2}


def test_many_tokens_stay(spark):
    line = "REVIEW AKs BTN 2 40 N " + "Ah " * 60 + "3BET"
    r = rq.tokenise(spark.createDataFrame([(line,)], "line string")).first()
    assert r["is_3bet_spot"] and len(r["board"]) == 60 and r["error"] == "board_long"


@pytest.mark.parametrize("line,error", [
    ("AKs BTN 2.5", "tokens"), ("", "empty"), ("AKs BTN x 40 N", "numeric"), ("AKs BTN 2 0 N", "stack"), ("AKs BTN -1 40 N", "open"), ("AKs BTN 2 40 Q", "multiway"), ("AKs BTN 2 40 N Ah", "board_short"),
    ("AKs BTN 2 40 N Ah Kd 2c 3c 4c 5c", "board_long"), ("AKs BTN 2 40 N Ah Kd 1c", "board_card"), ("AKs BTN 2 40 N Ah Kd aH", "board_duplicate"), ("REVIEW AKs BTN 2 40 N Ah Kd 2c 3BET", None), ("SET BB=100", None),
])
def test_request_checks(spark, line, error):
    d = spark.createDataFrame([(line,)], "line string")
    assert rq.tokenise(d).first()["error"] == error


def test_unknown_settings_are_counted(spark):
    d = rq.tokenise(spark.createDataFrame([("SET BB=1 COLOR=9 ANTE=x",)], "line string"))
    assert d.select(rq.setting_errors(F.col("_raw")).alias("n")).first()["n"] == 2
