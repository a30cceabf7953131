"""Folder ingestion that reads changed files again, for logs of either dialect.

A version table remembers path, length, modification time and content hash of every file that was read. A poll lists the folder,
reads the files that are new or differ, and skips those whose content is the same after all. Files are cut into records by the text source
itself, so a file of any size is read in splits. A poll writes its own folders and its version rows last, so a poll that failed is
done again as a whole.

What counts for a record is the newest poll that had it, and inside a poll its last copy: by modification time, path and place in the
file. A record that a new version no longer has stays, as in the log database this follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfold.operators.dedupe import top_per_key
from tallyfold.session import written
from tallyfold.sources import play_log

# fixed values: the record headers of the dialects, by which files are cut
HEADERS = {"acr": "Game Hand #", "ps": "PokerStars Hand #", "ps_pt": "Mão PokerStars #", "ps_pt_plain": "Mao PokerStars #"}
VERSION = "file_path string, length long, modified timestamp, content_hash string, batch int"
RECORD = "record string, batch int"
PER_POLL = 10_000  # files read in one round; more are read in further rounds


@dataclass
class Ingested:
    """Facts and actions that count now, and the file versions read so far."""

    facts: DataFrame
    actions: DataFrame
    versions: DataFrame


def listing(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(file_path, length, modified) of a folder's files; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return d.select(F.col("path").alias("file_path"), "length", F.col("modificationTime").alias("modified"))


def _table(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    kind = spark.createDataFrame([], schema).schema
    kept = kind.fields[:-1]  # the batch is in the folder's name
    spark.createDataFrame([], type(kind)(kept)).write.mode("ignore").parquet(f"{base}/{name}/batch=-1")
    return spark.read.schema(kind).parquet(f"{base}/{name}")


def newest(versions: DataFrame) -> DataFrame:
    return top_per_key(versions, ["file_path"], [F.col("batch").desc()])


def changed(files: DataFrame, versions: DataFrame, most: int) -> DataFrame:
    """Files that are new, or whose length or time differs from the version read last; the oldest first."""
    old = newest(versions).select("file_path", F.col("length").alias("_length"), F.col("modified").alias("_modified"))
    met = files.join(old, "file_path", "left").where("_length IS NULL OR _length <> length OR _modified <> modified")
    return met.drop("_length", "_modified").orderBy("modified", "file_path").limit(most)


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_path, modified, place, site, raw) of all records in the files; ``place`` orders those of a file."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file_path"), "value")
    marks = [F.max(F.col("value").contains(h)).alias(k) for k, h in HEADERS.items()]
    kinds = lines.groupBy("file_path").agg(*marks).collect()  # a row for each of at most PER_POLL files
    out = None
    for kind, header in HEADERS.items():
        mine = [r["file_path"] for r in kinds if r[kind] and not any(r[k] for k in list(HEADERS)[: list(HEADERS).index(kind)])]
        if not mine:
            continue
        meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_modification_time", "file_block_start")]
        d = spark.read.text(mine, lineSep=header).select("value", *meta).withColumn("row", F.monotonically_increasing_id())
        d = d.where(F.trim("value").rlike(r"^\d")).withColumn("value", F.concat(F.lit(header), F.trim("value")))  # text before the first header is no record
        cut = play_log.split_blocks(d)  # a file may hold other dialects' records too
        cut = cut.select("file_path", F.col("file_modification_time").alias("modified"), F.struct("file_block_start", "row", "block_no").alias("place"), play_log.site_of(F.col("raw")).alias("site"), "raw")
        out = cut if out is None else out.unionByName(cut)
    return out


def poll(spark: SparkSession, path: str, hero: str, base: str, per_poll: int = PER_POLL, pattern: str = "*.txt") -> int:
    """Read what is new or changed in the folder; returns how many rounds that took."""
    rounds = 0
    while True:
        versions = _table(spark, base, "versions", VERSION)
        batch = (versions.agg(F.max("batch")).first()[0] or 0) + 1
        todo = changed(listing(spark, path, pattern), versions, per_poll).collect()
        if not todo:
            return rounds
        rounds += 1
        files = spark.createDataFrame(todo, "file_path string, length long, modified timestamp")
        found = records(spark, [r["file_path"] for r in todo])
        if found is None:  # no file has a header
            hashes = files.select("file_path", F.lit("").alias("content_hash"))
        else:
            found = written(found, "log-records")
            hashes = found.groupBy("file_path").agg(F.concat_ws(":", F.count("*"), F.sum(F.xxhash64("raw").cast("decimal(38,0)")), F.sum(F.xxhash64("raw", F.lit(1)).cast("decimal(38,0)"))).alias("content_hash"))
        seen = written(files.join(hashes, "file_path", "left").select("file_path", "length", "modified", F.coalesce("content_hash", F.lit("")).alias("content_hash")), "log-versions")
        if found is not None:
            same = newest(versions).select("file_path", "content_hash")
            fresh = found.join(seen.join(same, ["file_path", "content_hash"], "left_anti").select("file_path"), "file_path", "left_semi").withColumn("record", play_log.record_key())
            last = written(top_per_key(fresh, ["record"], [F.col(c).desc() for c in ("modified", "file_path", "place")]), "log-last")
            play_log.parse_records(last, hero).drop("raw", "place", "batch").write.mode("overwrite").parquet(f"{base}/facts/batch={batch}")
            play_log.block_actions(last, "record").write.mode("overwrite").parquet(f"{base}/actions/batch={batch}")
            _table(spark, base, "records", RECORD)
            last.select("record").write.mode("overwrite").parquet(f"{base}/records/batch={batch}")
        seen.write.mode("overwrite").parquet(f"{base}/versions/batch={batch}")


def ingested(spark: SparkSession, base: str) -> Ingested:
    """What counts after all polls so far; none may have found a record yet."""
    versions = _table(spark, base, "versions", VERSION)
    last = _table(spark, base, "records", RECORD).groupBy("record").agg(F.max("batch").alias("batch"))
    empty = spark.createDataFrame([], "site string, raw string, record string")
    tables = {}
    for name, plan in (("facts", play_log.parse_records(empty, "nobody").drop("raw")), ("actions", play_log.block_actions(empty, "record"))):
        plan.write.mode("ignore").parquet(f"{base}/{name}/batch=-1")
        d = spark.read.option("mergeSchema", True).parquet(f"{base}/{name}")
        tables[name] = d.join(last, ["record", "batch"], "left_semi").drop("batch")
    return Ingested(tables["facts"], tables["actions"], newest(versions))


def watch(spark: SparkSession, path: str, hero: str, base: str, every: str = "30 seconds") -> StreamingQuery:
    """Poll the folder again and again; the first poll takes what is there."""
    ticks = spark.readStream.format("rate").load()
    return ticks.writeStream.foreachBatch(lambda df, i: poll(spark, path, hero, base) and None).trigger(processingTime=every).start()
