"""Query registry: name -> plan, inputs it covers, and an optional SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyfold.sources.bindings import table, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


class Tables:
    """Attribute access to the tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        known = {"hands", "spots", "sessions", "accounts", "interactions", "features", "predictions", "audit", "feedback", "requests", "blocks"}
        return table(self.spark, self.sf_dir, f"b_{name}" if name in known else name)


def query(name: str, covers: str, sql: str | None = None, uses: str = "", ctes: str = ""):
    """Register a plan. ``uses`` names derived tables for the oracle, ``ctes`` further ones in SQL."""

    def deco(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        COVERS[name] = covers.split()
        if sql is not None:
            head = with_clause(*[f"b_{u}" for u in uses.split()])
            if ctes:
                head = f"{head},\n{ctes}" if head else f"WITH {ctes}"
            ORACLES[name] = f"{head}\n{sql}".strip()
        return fn

    return deco
