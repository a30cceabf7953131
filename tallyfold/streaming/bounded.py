"""Streams whose state is bounded by a lateness and that still lose no row.

``route`` splits a stream: rows at most ``lateness`` behind the newest event of all earlier batches are on time, the others are
late. On-time rows go through Spark's watermarked operators in append mode, which free the state of what is closed. What a
watermark would drop never reaches them: it lies in the late table and is merged with what is still open by one batch pass over the late
rows, the open tail and the closed results they touch. A replayed batch gets the same mark, so it splits its rows alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tallyfold.operators.dedupe import top_per_key
from tallyfold.session import scratch_path
from tallyfold.streaming import drains

LATE = "_late"


@dataclass
class Bounded:
    """A drained stream: the merged result, the late rows, and how many rows were in state after each batch."""

    rows: DataFrame
    late: DataFrame
    state_rows: list[int]


def micros(interval: str) -> Column:
    return F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {interval})")


def route(stream: DataFrame, at: str, lateness: str, base: str) -> None:
    """Write every row below ``base/rows/batch=<i>/_late=<false|true>``; rows without a time are on time."""
    spark = stream.sparkSession
    for late in ("false", "true"):  # so that either side can be read before it has rows
        spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{base}/rows/batch=-1/{LATE}={late}")

    def step(df: DataFrame, i: int, b: str) -> None:
        mark = None
        if i:
            marks = spark.read.schema("newest long, batch int").parquet(f"{b}/marks")
            mark = marks.where(F.col("batch") < i).agg(F.max("newest") - micros(lateness)).first()[0]
        late = F.coalesce(F.unix_micros(F.col(at)) <= F.lit(mark), F.lit(False)) if mark is not None else F.lit(False)
        df.withColumn(LATE, late).write.mode("overwrite").partitionBy(LATE).parquet(f"{b}/rows/batch={i}")
        done = spark.read.schema(T.StructType([T.StructField(at, T.TimestampType()), T.StructField(LATE, T.BooleanType())])).parquet(f"{b}/rows/batch={i}")
        done.agg(F.max(F.unix_micros(F.col(at))).alias("newest")).write.mode("overwrite").parquet(f"{b}/marks/batch={i}")

    drains.batches(stream, "route", step, base=base)


def side(spark: SparkSession, base: str, schema: T.StructType, late: bool) -> DataFrame:
    """The routed rows of one side."""
    return spark.read.schema(schema).parquet(f"{base}/rows/batch=*/{LATE}={str(late).lower()}")


def on_time(spark: SparkSession, base: str, schema: T.StructType, at: str, lateness: str, per_batch: int) -> DataFrame:
    """The on-time rows as a watermarked stream, in the order in which they were routed."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    return reader.parquet(f"{base}/rows/batch=*/{LATE}=false").withWatermark(at, lateness)


def drain(stream: DataFrame, base: str, name: str) -> tuple[DataFrame, list[int]]:
    """Append what a stateful stream closes to ``base/name``; also the rows in state after each batch."""
    q = (
        stream.writeStream.format("parquet").option("path", f"{base}/{name}").option("checkpointLocation", f"{base}/{name}-checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    sizes = [int(s["numRowsTotal"]) for p in q.recentProgress for s in p["stateOperators"][:1]]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/{name}"), sizes


def first_per_key(stream: DataFrame, at: str, keys: Sequence[str], lateness: str, base: str | None = None, per_batch: int = 64) -> Bounded:
    """Insert-or-ignore ingestion: the earliest row of every key; a key is kept in state for ``lateness`` only."""
    spark = stream.sparkSession
    base = base or scratch_path(spark, "bounded-ingest")
    route(stream, at, lateness, base)
    stored, sizes = drain(on_time(spark, base, stream.schema, at, lateness, per_batch).dropDuplicatesWithinWatermark(list(keys)), base, "stored")
    late = side(spark, base, stream.schema, True)
    order = [F.col(at).asc_nulls_last(), *[F.col(c) for c in stream.columns if c != at and c not in keys]]
    return Bounded(top_per_key(stored.unionByName(late), list(keys), order), late, sizes)


def windowed(
    stream: DataFrame, at: str, lateness: str, sums: dict[str, Column], duration: str, slide: str | None = None, keys: Sequence[str] = (), base: str | None = None, per_batch: int = 64
) -> Bounded:
    """(start, end, keys, sums) per time window; ``sums`` are added up, so closed, open and late parts can be added too."""
    spark, keys = stream.sparkSession, list(keys)
    base = base or scratch_path(spark, "bounded-windows")
    route(stream, at, lateness, base)

    def summed(d: DataFrame) -> DataFrame:
        w = d.groupBy(F.window(at, duration, slide), *keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *sums)

    closed, sizes = drain(summed(on_time(spark, base, stream.schema, at, lateness, per_batch)), base, "closed")
    late = side(spark, base, stream.schema, True)
    top = F.coalesce(closed.agg(F.max("end")).scalar(), F.timestamp_micros(F.lit(-(1 << 55))))  # all windows up to here are closed
    rest = side(spark, base, stream.schema, False).where(F.unix_micros(F.col(at)) >= F.unix_micros(top) - micros(duration))
    parts = closed.unionByName(summed(rest).where(F.col("end") > top)).unionByName(summed(late))
    return Bounded(parts.groupBy("start", "end", *keys).agg(*[F.sum(n).alias(n) for n in sums]), late, sizes)


def sessions(stream: DataFrame, at: str, lateness: str, gap: str, keys: Sequence[str], sums: dict[str, Column], base: str | None = None, per_batch: int = 64) -> Bounded:
    """(keys, start, end, sums) of every session closed by ``gap``; keys whose rows are all closed and on time are not merged again."""
    spark, keys = stream.sparkSession, list(keys)
    base = base or scratch_path(spark, "bounded-sessions")
    route(stream, at, lateness, base)
    w = on_time(spark, base, stream.schema, at, lateness, per_batch).groupBy(*keys, F.session_window(at, gap)).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    closed, sizes = drain(w.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *sums), base, "closed")
    late = side(spark, base, stream.schema, True)

    def same(a: DataFrame, b: DataFrame) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & a[k].eqNullSafe(b[k])
        return out

    last = closed.groupBy(*keys).agg(F.max("end").alias("_closed"))
    rows = side(spark, base, stream.schema, False).where(F.col(at).isNotNull())
    met = rows.join(last, same(rows, last), "left").where(F.col("_closed").isNull() | (F.col(at) >= F.col("_closed")))
    still = met.select(*[rows[c] for c in rows.columns])
    one = still.unionByName(late).groupBy(*keys, F.col(at).alias("start")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    one = one.select(*keys, "start", F.timestamp_micros(F.unix_micros("start") + micros(gap)).alias("end"), *sums)
    touched = one.select(*keys).distinct()
    apart = closed.join(touched, same(closed, touched), "left_anti")
    meet = closed.join(touched, same(closed, touched), "left_semi").unionByName(one)
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = meet.withColumn("_new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)).withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*keys, "_n").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.sum(n).alias(n) for n in sums]).drop("_n")
    return Bounded(apart.unionByName(merged), late, sizes)
