"""Readers: explicit schemas, tolerant alignment, lineage columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyfold.session import written

PLAY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("hand_id", T.StringType()), T.StructField("session_id", T.LongType()),
    T.StructField("date_utc", T.TimestampType()), T.StructField("hero_position", T.StringType()), T.StructField("hero_stack_start", T.LongType()),
    T.StructField("big_blind", T.LongType()), T.StructField("m_ratio", T.DoubleType()), T.StructField("hero_vpip", T.IntegerType()),
    T.StructField("hero_pfr", T.IntegerType()), T.StructField("hero_result", T.StringType()), T.StructField("won_cents", T.LongType()),
])


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; the schema is given, so nothing is scanned twice to infer it."""
    return spark.read.schema(schema).option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


CORRUPT = "_corrupt_record"


def json_documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Indented JSON, one document or one array of documents a file -> (documents, quarantined files).

    Documents have the columns of ``schema`` and file_path. A file that is no valid JSON, or whose documents do not fit, is
    quarantined as (file_path, text); the others are read all the same. A file is parsed as a whole, so it must fit in a task's memory.
    """
    d = spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    d = written(d.select("*", F.col("_metadata.file_path").alias("file_path")), "json-documents")  # parsed once for both sides
    return d.where(F.col(CORRUPT).isNull()).drop(CORRUPT), d.where(F.col(CORRUPT).isNotNull()).select("file_path", F.col(CORRUPT).alias("text"))


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Whole text files found recursively, with their path and name. A file is one row, so it must fit in a task's memory; logs go through ``record_blocks``."""
    r = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return r.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"))


ACR_HEADER = "Game Hand #"


def with_header(pieces: DataFrame, header: str, *more: str) -> DataFrame:
    """Put back the header that the text source cut records at; what stands before a file's first header is no record."""
    d = pieces.select(F.trim("value").alias("v"), *more)
    return d.where(F.col("v").rlike(r"^\d")).select(F.concat(F.lit(header), "v").alias("value"), *more)


def record_blocks(spark: SparkSession, path: str, header: str = ACR_HEADER, pattern: str = "*.txt") -> DataFrame:
    """Log records cut at their header by the text source itself.

    The header is the record separator, so a large log file is read in parallel splits and
    never becomes one row. The dialect without its own header needs a second call.
    """
    r = spark.read.text(path, lineSep=header, recursiveFileLookup=True, pathGlobFilter=pattern)
    d = r.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"))
    return with_header(d, header, "file_path", "file_name")


def play_rows(spark: SparkSession, source: str) -> DataFrame:
    """Play from a CSV file or a Parquet table, in time order per file split."""
    d = csv(spark, source, PLAY_SCHEMA) if source.endswith(".csv") else spark.read.parquet(source)
    return d.where("date_utc IS NOT NULL")


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A database table read in parallel over ranges of a numeric key."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", key)
    return r.option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).options(**options).load()


def align(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Project to (name -> (type, default)); columns the input lacks become their default."""

    def one(name: str, kind: str, default) -> Column:
        if name not in df.columns:
            return F.lit(default).cast(kind).alias(name)
        return F.coalesce(F.col(name).try_cast(kind), F.lit(default).cast(kind)).alias(name)

    return df.select(*[one(n, k, d) for n, (k, d) in columns.items()])


def with_lineage(files: DataFrame, version: str, text: str = "value") -> DataFrame:
    """Source path, hash of the row's own text (a record's, where files are cut into records) and schema version on every ingested row."""
    return files.select("*", F.col("file_path").alias("source_path"), F.sha2(text, 256).alias("content_sha256"), F.lit(version).alias("schema_version"))


def recent(df: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    return df.where(F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days))


def with_profiles(df: DataFrame, profiles: DataFrame | None) -> DataFrame:
    """Left-join the optional account profile side file when it is there and needed."""
    if profiles is None or "profile" in df.columns:
        return df
    return df.join(profiles.select("account_id", "profile"), "account_id", "left")
