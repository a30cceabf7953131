"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyfold.llm.common import staged


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node next to it."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between long node ids -> (node, root): the least node of each node's component.

    Roots are not listed for themselves, nor are nodes without links. Null ends and self links are ignored,
    repeated links count once, no links give no rows. Every round is written below the shared folder, so the
    lineage stays short and a lost executor repeats one round at most; hubs are reduced by aggregation before
    they are joined. The rounds grow with the logarithm of the longest chain.
    """
    now = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        print_ = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if print_ == seen or print_["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = print_
        now = staged(_small_star(_large_star(now).distinct()).distinct(), "links")


def contracted(links: DataFrame) -> DataFrame:
    """As ``components``, for tables with many links a node: first every node keeps its least neighbour alone, then the
    links between the components so found are contracted. The rounds so work on one link a node."""
    every = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    first = staged(components(every.groupBy("a").agg(F.min("b").alias("b"))), "links")
    of_a, of_b = first.select(F.col("node").alias("a"), F.col("root").alias("ra")), first.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    ends = every.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    then = components(ends.where("a <> b").distinct())
    moved = then.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return first.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionAll(then)
