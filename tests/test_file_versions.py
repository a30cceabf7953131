"""Folders whose files change, with records of both dialects."""

import os

import pytest

from tallyfold.sources import file_versions as fv

HEAD = "Game Hand #{n} - Tournament #5 - Holdem (No Limit) - Level 2 (50.00/100.00) - 2024/01/02 10:20:30 UTC\nTable 't' 4-max Seat #1 is the button\nSeat 1: Ann (1000.00)\nSeat 2: Hero ({stack}.00)\n*** HOLE CARDS ***\nDealt to Hero [Ah Kd]\n{acts}\n"
PS = "Mão PokerStars #{n}: Torneio #7, $1 USD - 2024/01/02\nSeat 1: Ann (1000 em fichas)\n*** CARTAS DA MÃO ***\nAnn: iguala $200\nHero: aumenta $200 para $600\n{acts}*** RESUMO ***\nAnn: aposta $9\n\n"


def put(folder, name, text, at):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    os.utime(folder / name, (1_700_000_000 + at,) * 2)


def acr(n, acts, stack=2000):
    return HEAD.format(n=n, acts=acts, stack=stack)


def state(spark, base):
    got = fv.ingested(spark, base)
    facts = {r["hand_id"]: r["hero_stack_start"] for r in got.facts.collect()}
    actions = {}
    for r in got.actions.orderBy("record", "action_order").collect():
        actions.setdefault(r["record"], []).append((r["actor_id"], r["action_type"], r["amount"]))
    return facts, actions, {os.path.basename(r["file_path"]): r["batch"] for r in got.versions.collect()}


def test_changed_files_replace_their_records(spark, tmp_path):
    logs, base = tmp_path / "in", str(tmp_path / "run")
    put(logs, "a.txt", "stray text\n" + acr(1, "Ann folds") + acr(2, "Ann folds"), 0)
    put(logs, "b.txt", PS.format(n=9, acts="Ann: desiste\n") + PS.format(n=10, acts=""), 1)
    put(logs, "c.txt", "no record at all", 2)
    put(logs, "d.log", acr(77, "Ann folds"), 2)
    assert fv.poll(spark, str(logs), "Hero", base) == 1
    facts, actions, versions = state(spark, base)
    assert facts == {"1": 2000.0, "2": 2000.0} and actions["acr:1"] == [("Ann", "FOLD", 0.0)]
    assert actions["ps:9"] == [("Ann", "CALL", 200.0), ("Hero", "RAISE", 600.0), ("Ann", "FOLD", 0.0)] and len(actions["ps:10"]) == 2
    assert fv.poll(spark, str(logs), "Hero", base) == 0
    put(logs, "a.txt", acr(1, "Ann folds\nHero calls 200", 3000) + acr(3, "Ann checks"), 100)  # a changed and a new record; 2 is gone from the file
    put(logs, "b.txt", PS.format(n=9, acts="Ann: desiste\n") + PS.format(n=10, acts=""), 101)  # touched only
    assert fv.poll(spark, str(logs), "Hero", base) == 1
    facts, actions, after = state(spark, base)
    assert facts == {"1": 3000.0, "2": 2000.0, "3": 2000.0} and actions["acr:1"] == [("Ann", "FOLD", 0.0), ("Hero", "CALL", 200.0)]
    assert len(actions["ps:9"]) == 3 and after["a.txt"] == 2 and after["c.txt"] == versions["c.txt"]
    put(logs, "a.txt", acr(1, "", 3000), 200)  # its actions are gone
    fv.poll(spark, str(logs), "Hero", base)
    assert "acr:1" not in state(spark, base)[1]


def test_last_copy_counts(spark, tmp_path):
    """Copies in one file, and in two files of one poll: the later place, then the later file."""
    logs, base = tmp_path / "in", str(tmp_path / "run")
    put(logs, "z.txt", acr(1, "Ann folds", 100) + acr(1, "Ann checks", 200) + acr(2, "Ann folds", 500), 0)
    put(logs, "a.txt", acr(2, "Ann folds", 600), 10)
    put(logs, "m.txt", acr(4, "Ann folds") + PS.format(n=5, acts=""), 10)  # both dialects in one file
    assert fv.poll(spark, str(logs), "Hero", base, per_poll=2) == 2
    facts, actions, versions = state(spark, base)
    assert facts == {"1": 200.0, "2": 600.0, "4": 2000.0} and actions["acr:1"] == [("Ann", "CHECK", 0.0)] and len(actions["ps:5"]) == 2
    assert len(set(versions.values())) == 2


def test_failed_poll_is_done_again(spark, tmp_path):
    logs, base = tmp_path / "in", str(tmp_path / "run")
    put(logs, "a.txt", acr(1, "Ann folds"), 0)
    (tmp_path / "run" / "facts" / "batch=1").mkdir(parents=True)  # left behind by a poll that wrote no versions
    (tmp_path / "run" / "facts" / "batch=1" / "part-0.parquet").write_bytes(b"half a file")
    assert fv.poll(spark, str(logs), "Hero", base) == 1
    assert list(state(spark, base)[0]) == ["1"]


@pytest.mark.parametrize("text,rounds", [("", 0), ("nothing", 1)])
def test_no_records(spark, tmp_path, text, rounds):
    """An empty file is not listed; one without records is remembered."""
    put(tmp_path / "in", "a.txt", text, 0)
    assert fv.poll(spark, str(tmp_path / "in"), "Hero", str(tmp_path / "run")) == rounds
    assert state(spark, str(tmp_path / "run"))[:2] == ({}, {})
