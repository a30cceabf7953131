"""Logs are read record by record, whatever the size of their files."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyfold.sources import play_log, readers
from tallyfold.streaming import play


def test_text_scan_never_holds_a_file(spark, sf, monkeypatch):
    """A row of the scan is one record: whole files as rows took 490 MB tasks and ended in failure."""
    seen = []
    lineage = readers.with_lineage
    monkeypatch.setattr(readers, "with_lineage", lambda files, *a, **k: seen.append(files) or lineage(files, *a, **k))
    got = entry.queries()["s04_text_scan"](spark, sf)
    marks = F.size(F.regexp_extract_all("value", F.lit(r"(Game Hand #)"), F.lit(1)))
    r = seen[0].agg(F.count("*").alias("n"), F.max(marks).alias("most")).first()
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert (r["n"], r["most"]) == (events.count(), 1)
    assert got.agg(F.sum("records")).first()[0] == r["n"] and got.count() == events.select("user_id").distinct().count()


LINES = [
    "Game Hand #7 - x", "Seat 1: Ann (10.00)", "Ann posts ante 10.00", "Bob: POSTS the big blind $1,200", "Cid FOLDS", "Dee: Raises $3,5 to 9,25 and is ALL-IN", "x y: checks", "Eve calls ...", "",
    "*** ﬂop ***", "Total pot 5 x", "Ann posts ante 5 calls 3", "Fay posts ante 0 folds", "*** turn *** [Ah]", "folds", "*** SUMMARY ***", "Hero calls 999",
]


def test_lines_without_a_word_of_a_pattern_are_not_read(spark):
    """Odd lines give the same actions as every pattern tried on every line; amounts are read where there is one."""
    d = spark.createDataFrame([("acr", "\n".join(LINES)), ("ps", "Ana: PAGA O BIG BLIND $4\nAna: aposta 5\nRui: Desiste\n*** RESUMO ***\nAna: passa")], "site string, raw string")
    got = [tuple(r) for r in play_log.block_actions(d, "site").orderBy("site", "action_order").collect()]
    assert got == [
        ("acr", 1, "PREFLOP", "Cid", "FOLD", 0.0, 11.2, False), ("acr", 2, "PREFLOP", "Dee", "RAISE", 9.25, 11.2, True), ("acr", 3, "PREFLOP", "x y", "CHECK", 0.0, 20.45, False), ("acr", 4, "PREFLOP", "Eve", "CALL", 0.0, 20.45, False),
        ("acr", 5, "FLOP", "Fay posts ante 0", "FOLD", 0.0, 25.45, False), ("ps", 1, "PREFLOP", "Ana", "BET", 5.0, 4.0, False), ("ps", 2, "PREFLOP", "Rui", "FOLD", 0.0, 9.0, False),
    ]


def test_log_batches_are_cut_once(spark, tmp_path, monkeypatch):
    """A batch of logs is cut and deduplicated once for facts and actions, and its pieces are what both read."""
    logs = str(tmp_path / "logs")
    spark.createDataFrame([("Game Hand #1 - Tournament #2 - x\nCid folds\n\n",)], "value string").write.text(logs)
    plans = []
    actions = play_log.block_actions
    monkeypatch.setattr(play_log, "block_actions", lambda d, *a: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or actions(d, *a))
    _, found = play.ingest_logs(spark, logs, "Hero", str(tmp_path / "run"))
    assert found.count() == 1 and len(plans) == 1 and "Aggregate" not in plans[0] and "parquet" in plans[0]
