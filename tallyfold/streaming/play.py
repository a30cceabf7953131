"""Streaming forms of ingestion, accumulators, request scoring and windowed trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyfold.functions.numeric import count_where, ratio
from tallyfold.plans import audit_log, entities, requests as rq
from tallyfold.session import written
from tallyfold.sources import play_log, readers
from tallyfold.streaming import drains


def ingest(stream: DataFrame, key: str, base: str | None = None) -> DataFrame:
    """Idempotent ingestion: the first row of every key is stored, later ones are ignored.

    The keys seen are kept in partitioned state, so a batch does not read what earlier ones stored.
    """
    return drains.append(stream.dropDuplicates([key]), "ingest", base)


def ingest_logs(spark: SparkSession, path: str, hero: str, base: str | None = None, per_batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Text logs of a growing folder -> (facts, actions).

    Facts are inserted or ignored by record; the actions of a record that comes again replace its earlier ones. Each
    batch writes its own folders; which batch counts for a record is settled by one aggregation when they are read.
    """
    reader = spark.readStream.option("lineSep", readers.ACR_HEADER).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt")
    text = (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).text(path)
    blocks = play_log.split_blocks(readers.with_header(text, readers.ACR_HEADER))

    def step(df: DataFrame, i: int, b: str) -> None:
        one = written(df.withColumn("record", play_log.record_key()).dropDuplicates(["record"]), "log-batch")  # read for facts and for actions
        facts = play_log.parse_records(one, hero)
        facts.drop("raw").write.mode("overwrite").parquet(f"{b}/facts/batch={i}")
        play_log.block_actions(one, "record").write.mode("overwrite").parquet(f"{b}/actions/batch={i}")

    base = drains.batches(blocks, "logs", step, base=base)
    facts, actions = spark.read.parquet(f"{base}/facts"), spark.read.parquet(f"{base}/actions")
    first = facts.groupBy("record").agg(F.min("batch").alias("batch"))
    last = actions.groupBy("record").agg(F.max("batch").alias("batch"))
    return facts.join(first, ["record", "batch"], "left_semi").drop("batch"), actions.join(last, ["record", "batch"], "left_semi").drop("batch")


def drop_repeats(stream: DataFrame, at: str, keys: list[str], cool_down: str = "5 seconds", base: str | None = None) -> DataFrame:
    """One row for each run of equal keys (such as a content hash) whose gaps stay within the cool-down.

    Runs are made by time, not by arrival, so files in any order give the same rows and none is lost.
    """
    runs = stream.groupBy(*keys, F.session_window(at, cool_down)).agg(F.min(at).alias(at), F.count("*").alias("copies"))
    return drains.final(runs.select(*keys, at, "copies"), "repeats", base)


def entity_totals(actions: DataFrame, base: str | None = None) -> DataFrame:
    """Running accumulators per opponent; state holds one small row per opponent."""
    return drains.updates(entities.accumulate(actions), "entities", ["name"], base)


def request_scores(requests: DataFrame) -> DataFrame:
    """Stateless scoring of a request stream: the batch plan, unchanged."""
    return rq.score(rq.tokenise(requests))


def session_counters(scored: DataFrame, base: str | None = None) -> DataFrame:
    return drains.updates(audit_log.session_counters(scored), "counters", ["session_id"], base)


def session_settings(requests: DataFrame, base: str | None = None) -> DataFrame:
    """Latest SET values per session on every later row, by the time of the request.

    The stream parses and stores lines; what holds at a row is settled by the ordered scan over what is stored, so a line that
    arrives late still reaches the rows after it, and a session of any size is scanned in slices.
    """
    return rq.with_session_settings(drains.append(rq.tokenise(requests), "settings", base))


def _late(stream: DataFrame, at: str, lateness: str | None) -> DataFrame:
    """With ``lateness``, state is freed and rows that come later than that are dropped; without it none is."""
    return stream.withWatermark(at, lateness) if lateness else stream


def daily_trend(hands: DataFrame, at: str, lateness: str | None = None) -> DataFrame:
    """Tumbling one-day rates."""
    w = _late(hands, at, lateness).groupBy(F.window(at, "1 day"))
    return w.agg(F.count("*").alias("hands"), F.sum("hero_vpip").alias("vpip_n"), F.sum("hero_pfr").alias("pfr_n")).select(
        F.date_format("window.start", "yyyy-MM-dd").alias("date"), "hands", ratio(F.col("vpip_n"), F.col("hands")).alias("vpip"), ratio(F.col("pfr_n"), F.col("hands")).alias("pfr")
    )


def sliding_week(hands: DataFrame, at: str, lateness: str | None = None) -> DataFrame:
    """Seven-day sums that slide by a day."""
    w = _late(hands, at, lateness).groupBy(F.window(at, "7 days", "1 day"))
    return w.agg(F.count("*").alias("hands"), F.sum("won_cents").alias("net_cents")).select(F.date_format("window.start", "yyyy-MM-dd").alias("from_date"), "hands", "net_cents")


def play_sessions(hands: DataFrame, at: str, gap: str = "6 hours", lateness: str | None = None) -> DataFrame:
    """Activity sessions per player, closed by a gap."""
    w = _late(hands, at, lateness).groupBy("hero_id", F.session_window(at, gap))
    return w.agg(F.count("*").alias("hands"), count_where(F.col("hero_result") == "win").alias("wins")).select(
        "hero_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "hands", "wins"
    )
