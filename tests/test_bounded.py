"""Bounded stream state: what a watermark would drop comes back, and state shrinks."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.streaming import bounded, drains

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def four_shares(spark, tmp_path):
    """Forty days of rows in four files by time, every eighth row in a file that comes later."""
    rng, rows = random.Random(6), []
    for i in range(800):
        share = min(3, i // 200 + (rng.randint(1, 3) if i % 8 == 0 else 0))
        rows.append((i % 37 if i % 50 else i % 7, f"k{i % 640}", rng.randint(1, 9), T0 + dt.timedelta(minutes=72 * i), share))
    schema = "user long, key string, v int, at timestamp"
    for k in range(4):
        mine = [r[:4] for r in rows if r[4] == k]
        rng.shuffle(mine)
        seen = set((tmp_path / "in").glob("*.parquet"))
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in set((tmp_path / "in").glob("*.parquet")) - seen:
            os.utime(f, (1_700_000_000 + k * 60,) * 2)
    return lambda: drains.files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, per_batch=1), rows


def test_windows(four_shares, tmp_path):
    stream, rows = four_shares
    b = bounded.windowed(stream(), "at", "1 day", {"n": F.lit(1), "v": F.col("v")}, "2 days", "1 day", base=str(tmp_path / "w"), per_batch=1)
    want = {}
    for r in rows:
        for k in (0, 1):
            day = (r[3] - dt.timedelta(days=k)).date()
            n, v = want.get(day, (0, 0))
            want[day] = n + 1, v + r[2]
    assert {r["start"].date(): (r["n"], r["v"]) for r in b.rows.collect()} == want
    assert b.late.count() > 20 and max(b.state_rows) < len(want) and b.state_rows[-1] < max(b.state_rows)


def test_sessions(four_shares, tmp_path):
    """Late rows bridge sessions that the stream had closed."""
    stream, rows = four_shares
    b = bounded.sessions(stream(), "at", "1 day", "45 hours", ["user"], {"n": F.lit(1)}, base=str(tmp_path / "s"), per_batch=1)
    want = []
    for user in {r[0] for r in rows}:
        times, run = sorted(r[3] for r in rows if r[0] == user), []
        for t in times:
            if run and t - run[-1] >= dt.timedelta(hours=45):
                want.append((user, run[0], len(run)))
                run = []
            run.append(t)
        want.append((user, run[0], len(run)))
    got = sorted((r["user"], r["start"].replace(tzinfo=None), r["n"]) for r in b.rows.collect())
    assert got == sorted(want) and b.late.count() > 20 and b.state_rows[-1] < max(b.state_rows)


def test_first_per_key(four_shares, tmp_path):
    """A key that comes again long after its state has gone, or too late, is still stored once."""
    stream, rows = four_shares
    b = bounded.first_per_key(stream(), "at", ["key"], "1 day", base=str(tmp_path / "f"), per_batch=1)
    want = {}
    for r in sorted(rows, key=lambda r: r[3]):
        want.setdefault(r[1], r[3])
    assert {r["key"]: r["at"].replace(tzinfo=None) for r in b.rows.collect()} == want and b.rows.count() == 640
    assert b.state_rows[-1] < 200 < len(want)


def test_second_run_adds_what_is_new(spark, four_shares, tmp_path):
    stream, rows = four_shares
    base = str(tmp_path / "again")
    first = bounded.windowed(stream(), "at", "1 day", {"n": F.lit(1)}, "1 day", base=base, per_batch=1)
    assert first.rows.agg(F.sum("n")).first()[0] == len(rows)
    spark.createDataFrame([(1, "new", 1, T0 + dt.timedelta(days=60)), (1, "old", 1, T0)], "user long, key string, v int, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    more = bounded.windowed(stream(), "at", "1 day", {"n": F.lit(1)}, "1 day", base=base, per_batch=1)
    assert more.rows.agg(F.sum("n")).first()[0] == len(rows) + 2 and more.late.where("key = 'old'").count() == 1
