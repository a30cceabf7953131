"""Session settings inside the stream: SET values reach the later rows of their session by event time.

A session keeps its current settings and the rows that the watermark has not passed. Its one timer stands at its earliest such row; when the
watermark passes it, the rows up to the watermark are final, as no on-time row can come before them: they are put out in order with the settings that hold at each, and
leave the state. State is kept in RocksDB, so sessions need not fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from tallyfold.operators.scan import carry_forward
from tallyfold.plans import requests as rq
from tallyfold.session import scratch_path
from tallyfold.streaming import bounded

NAMES = list(rq.SETTINGS)
OUT = "session_id long, request_id long, received_at timestamp, " + ", ".join(f"{n} double" for n in NAMES)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Settings(StatefulProcessor):
    """State of one session: ``now`` holds its settings, ``waiting`` its rows by (microseconds, request), ``timer`` its pending timer."""

    def init(self, handle) -> None:
        values = ", ".join(f"{n} double" for n in NAMES)
        self.handle = handle
        self.now = handle.getValueState("now", values)
        self.timer = handle.getValueState("timer", "at long")
        self.waiting = handle.getMapState("waiting", "at long, request_id long", values)

    def _set_timer(self, micros: int) -> None:
        at = -(-micros // 1000)
        if self.timer.exists():
            old = self.timer.get()[0]
            if old <= at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            for r in part[["at", "request_id", *NAMES]].itertuples(index=False):
                self.waiting.updateValue((int(r[0]), int(r[1])), tuple(None if pd.isna(v) else float(v) for v in r[2:]))
                first = int(r[0]) if first is None else min(first, int(r[0]))
        if first is not None:
            self._set_timer(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(((tuple(k), tuple(v)) for k, v in self.waiting.iterator()), key=lambda x: x[0])
        now = list(self.now.get()) if self.now.exists() else [None] * len(NAMES)
        out = []
        for (at, request), values in rows:
            if at > passed:
                break
            now = [old if new is None else new for old, new in zip(now, values)]
            out.append((key[0], request, pd.Timestamp(at, unit="us"), *now))
            self.waiting.removeKey((at, request))
        self.now.update(tuple(now))
        self.timer.clear()
        if len(rows) > len(out):
            self._set_timer(rows[len(out)][0][0])
        if out:
            yield pd.DataFrame(out, columns=["session_id", "request_id", "received_at", *NAMES]).astype({n: "float64" for n in NAMES})

    def close(self) -> None:
        pass


def parsed(requests: DataFrame) -> DataFrame:
    """(session_id, request_id, received_at, settings that the row sets)."""
    d = rq.tokenise(requests)
    return d.select("session_id", "request_id", F.col("received_at").cast("timestamp").alias("received_at"), *[F.when(F.col("is_set"), rq.setting(F.col("_raw"), names)).alias(k) for k, names in rq.SETTINGS.items()])


def in_stream(rows: DataFrame) -> DataFrame:
    """The watermarked rows of ``parsed`` -> those that are final, with the settings that hold at each."""
    given = rows.withColumn("at", F.unix_micros("received_at"))
    return given.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Settings(), outputStructType=T.StructType.fromDDL(OUT), outputMode="Append", timeMode="EventTime")


def _scan(rows: DataFrame) -> DataFrame:
    return carry_forward(rows, ["session_id"], ["received_at", "request_id"], NAMES, F.unix_micros("received_at"), tie=F.col("request_id")).select("session_id", "request_id", "received_at", *NAMES)


def with_settings(requests: DataFrame, lateness: str, base: str | None = None, per_batch: int = 64) -> bounded.Bounded:
    """Settings at every request: from the stream where rows are final, and from a scan of the open tail that starts at each session's last
    final row. Sessions with late rows are scanned again as a whole. Request ids must be unique inside a session."""
    spark: SparkSession = requests.sparkSession
    base = base or scratch_path(spark, "bounded-settings")
    rows = parsed(requests)
    bounded.route(rows, "received_at", lateness, base)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        final, sizes = bounded.drain(in_stream(bounded.on_time(spark, base, rows.schema, "received_at", lateness, per_batch)), base, "final")
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    late, kept = (bounded.side(spark, base, rows.schema, x) for x in (True, False))
    redo = late.select("session_id").distinct()
    top = F.coalesce(final.agg(F.max("received_at")).scalar(), F.timestamp_micros(F.lit(-(1 << 55))))  # all rows up to here are final
    tail = kept.where(F.col("received_at") > top)
    whole = kept.join(redo, "session_id", "left_semi").unionByName(late)
    last = final.groupBy("session_id").agg(F.max_by(F.struct(*[F.col(c) for c in final.columns]), F.struct("received_at", "request_id")).alias("r")).select("r.*")
    seeds = last.join(tail.select("session_id").distinct(), "session_id", "left_semi")
    went_on = _scan(seeds.unionByName(tail)).join(seeds.select("session_id", "request_id"), ["session_id", "request_id"], "left_anti")
    own = final.unionByName(went_on).join(redo, "session_id", "left_anti")
    return bounded.Bounded(own.unionByName(_scan(whole)), late, sizes)
