"""Settings applied inside the stream, against the batch scan."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from tallyfold.plans import requests as rq
from tallyfold.streaming import bounded, drains, settings

T0 = dt.datetime(2024, 1, 1)


def test_stream_equals_the_batch_scan(spark, tmp_path):
    rng, rows = random.Random(9), []
    for i in range(400):
        session = i % 23 if i % 3 else 1  # one hot session
        line = rng.choice(["SET BB=%d" % rng.randint(1, 9), "SET ANTE=%d OPEN=2.5" % rng.randint(1, 9), "AKs BTN 2 40 N", "QQ CO 2 40 N", "SET BB=x"])
        share = min(3, i // 100 + (1 if session in (1, 2) and i % 20 == 0 else 0))
        rows.append((session, i, T0 + dt.timedelta(minutes=i), line, share))
    schema = "session_id long, request_id long, received_at timestamp, line string"
    for k in range(4):
        mine = [r[:4] for r in rows if r[4] == k]
        rng.shuffle(mine)
        seen = set((tmp_path / "in").glob("*.parquet"))
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in set((tmp_path / "in").glob("*.parquet")) - seen:
            os.utime(f, (1_700_000_000 + k * 60,) * 2)
    every = spark.createDataFrame([r[:4] for r in rows], schema)
    want = {(r["session_id"], r["request_id"]): tuple(r[n] for n in settings.NAMES) for r in rq.with_session_settings(rq.tokenise(every)).collect()}
    stream = drains.files(spark, str(tmp_path / "in"), every.schema, per_batch=1)
    b = settings.with_settings(stream, "10 minutes", str(tmp_path / "run"), per_batch=1)
    got = b.rows.collect()
    assert {(r["session_id"], r["request_id"]): tuple(r[n] for n in settings.NAMES) for r in got} == want and len(got) == len(rows)
    final = spark.read.schema(settings.OUT).parquet(f"{tmp_path}/run/final")
    untouched = final.join(b.late.select("session_id").distinct(), "session_id", "left_anti").collect()  # the stream's own output, as it is
    assert len(untouched) > 100 and all(want[r["session_id"], r["request_id"]] == tuple(r[n] for n in settings.NAMES) for r in untouched)
    assert 0 < b.late.count() < 40 and final.count() > 300
    assert [r for r in bounded.side(spark, f"{tmp_path}/run", final.schema, False).select(F.max("received_at")).collect()]
