"""Bucketed upserts: right rows, and files of untouched buckets stay."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyfold.sources import bucketed


def files(path):
    return {f: f.stat().st_mtime_ns for f in Path(path, "data").rglob("*.parquet")}


@pytest.fixture()
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    bucketed.create(spark.range(1000).select(F.col("id").alias("key"), F.lit("old").alias("v"), F.lit(1).alias("w")), path, ["key"], 16)
    return path


def test_upsert_touches_its_buckets_only(spark, table):
    before = files(table)
    hit = bucketed.upsert(spark, table, spark.createDataFrame([(5, "new", 2), (5000, "new", 2)], "key long, v string, w int"), ["v"])
    after = files(table)
    assert 1 <= len(hit) <= 2
    gone, kept = set(before) - set(after), set(before) & set(after)
    assert {f.parent.name for f in gone} == {f"bucket={b}" for b in hit} and all(before[f] == after[f] for f in kept) and len(kept) > 10
    rows = {r["key"]: (r["v"], r["w"]) for r in bucketed.read(spark, table).collect()}
    assert len(rows) == 1001 and rows[5] == ("new", 1) and rows[5000] == ("new", 2) and rows[6] == ("old", 1)


def test_insert_or_ignore_and_nothing(spark, table):
    before = files(table)
    assert bucketed.upsert(spark, table, spark.createDataFrame([], "key long, v string, w int"), []) == [] and files(table) == before
    bucketed.upsert(spark, table, spark.createDataFrame([(7, "x", 9), (None, "null", 9)], "key long, v string, w int"), [])
    assert {r["v"] for r in bucketed.read(spark, table).where("key = 7 OR key IS NULL").collect()} == {"old", "null"}


def test_children_are_replaced(spark, tmp_path):
    path = str(tmp_path / "c")
    bucketed.create(spark.range(300).selectExpr("CAST(id DIV 3 AS string) AS parent", "id % 3 AS child"), path, ["parent"], 8)
    before = files(path)
    hit = bucketed.replace_children(spark, path, spark.createDataFrame([("7", 70), ("new", 1)], "parent string, child long"), spark.createDataFrame([("8",)], "parent string"))
    after = files(path)
    assert all(before[f] == after[f] for f in set(before) & set(after)) and {int(f.parent.name[7:]) for f in set(before) - set(after)} <= set(hit)
    rows = bucketed.read(spark, path).groupBy("parent").agg(F.collect_list("child").alias("c")).collect()
    got = {r["parent"]: sorted(r["c"]) for r in rows}
    assert got["7"] == [70] and got["new"] == [1] and "8" not in got and got["9"] == [0, 1, 2] and len(got) == 100


def test_last_row_of_a_bucket_goes(spark, tmp_path):
    path = str(tmp_path / "e")
    bucketed.create(spark.createDataFrame([("a", 1), ("b", 2)], "parent string, child long"), path, ["parent"], 64)
    bucketed.replace_children(spark, path, spark.createDataFrame([], "parent string, child long"), spark.createDataFrame([("a",)], "parent string"))
    assert [tuple(r) for r in bucketed.read(spark, path).collect()] == [("b", 2)]
    bucketed.rebucket(spark, path, str(tmp_path / "f"), 4)
    assert bucketed.layout(spark, str(tmp_path / "f")) == (["parent"], 4) and bucketed.read(spark, str(tmp_path / "f")).count() == 1


@pytest.mark.parametrize("change", ["upsert", "children"])
def test_new_rows_are_computed_once(spark, tmp_path, change):
    """What comes in may be dear to compute (parsed logs), so it is not computed again for each use."""
    path, seen = str(tmp_path / "o"), spark.sparkContext.accumulator(0)
    bucketed.create(spark.range(50).selectExpr("id AS key", "'old' AS v"), path, ["key"], 4)

    def count(rows):
        for r in rows:
            seen.add(1)
            yield r

    new = spark.createDataFrame(spark.range(20).rdd.mapPartitions(count).map(lambda r: (r[0], "new")), "key long, v string")
    if change == "upsert":
        bucketed.upsert(spark, path, new, ["v"])
    else:
        bucketed.replace_children(spark, path, new)
    assert seen.value == 20 and bucketed.read(spark, path).where("v = 'new'").count() == 20
