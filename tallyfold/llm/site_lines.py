"""Line dedup by site-relative frequency: a line that stands on more than a share of a host's pages is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyfold.llm.common import staged

RATIO = 0.3  # of a host's pages
LEAST_PAGES = 5  # pages that must hold a line before it can go
BROADCAST_BYTES = 32 << 20


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, least_words: int = 0) -> DataFrame:
    """(host, lines): the boilerplate lines of every host that has any, from (host, text).

    A page counts once for each different line on it, blank lines and those under ``least_words`` words never; the counts of a host or a line are added
    up in each task before the shuffle, so a hot host or line costs a row for each task. A host has no more such
    lines than its mean number of lines on a page divided by ``ratio``, which bounds the arrays.
    """
    own = F.array_distinct(F.filter(lines_of(F.col("text")), lambda x: F.trim(x) != ""))
    if least_words:
        own = F.filter(own, lambda x: F.size(F.split(F.trim(x), r"\s+")) >= least_words)
    n = pages.select("host", F.explode(own).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    total = pages.groupBy("host").agg(F.count("*").alias("total"))
    common = n.where(F.col("n") >= least_pages).join(total, "host").where(F.col("n") > ratio * F.col("total"))
    return common.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def without_boilerplate(
    docs: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, counts: bool = False, least_words: int = 0
) -> DataFrame:
    """Every row of ``docs`` with the boilerplate lines of its host cut out of the text; columns and order stay.

    With ``counts`` the columns host, n_lines and n_dropped are added behind. A null text stays null, an empty one
    empty, a null host is a host of its own (the empty name), repeated rows are pages of their own, an empty table gives no
    rows. Hosts with fewer pages than ``least_pages`` lose nothing. Whether the line lists are broadcast depends on
    their measured bytes; beyond ``BROADCAST_BYTES`` hosts are salted so that no task gets all pages of one.
    """
    names = docs.columns
    site, salt, drop = "_site_host", "_site_salt", "_site_lines"
    given = docs.withColumn(site, F.coalesce(host.cast("string"), F.lit("")))
    lists = staged(boilerplate(given.select(F.col(site).alias("host"), F.col(text_col).alias("text")), ratio, least_pages, least_words), "site-lines")
    lists = lists.select(F.col("host").alias(site), F.col("lines").alias(drop))
    size = lists.agg(F.sum(F.length(F.array_join(drop, "\n")) * 4 + F.size(drop) * 16 + F.length(site) * 4)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        met = given.join(F.broadcast(lists), site, "left")
    else:
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = lists.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        met = given.withColumn(salt, F.pmod(F.xxhash64(text_col), F.lit(n)).cast("int")).join(spread, [site, salt], "left")
    old = lines_of(F.col(text_col))
    new = F.filter(old, lambda x: ~F.coalesce(F.array_contains(drop, x), F.lit(False)))
    out = {c: F.col(c) for c in names} | {text_col: F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(F.array_join(new, "\n"))}
    more = []
    if counts:
        had = F.coalesce(F.size(old), F.lit(0)).cast("long")
        more = [F.col(site).alias("host"), F.when(F.col(text_col).isNull(), 0).otherwise(had).alias("n_lines"),
                F.when(F.col(text_col).isNull() | F.col(drop).isNull(), 0).otherwise(had - F.size(new)).alias("n_dropped")]
    return met.select(*[out[c].alias(c) for c in names], *more)


PAGE_HOST, TAG = r"^[a-zA-Z]+://([^/?#]+)", "<[^>]*>"


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of raw pages: every tag ends a line."""
    return pages.select("page_id", "url", F.regexp_replace("html", TAG, "\n").alias("text"))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '{PAGE_HOST}', 1), '') AS host, string_split(regexp_replace(html, '{TAG}', chr(10), 'g'), chr(10)) AS lines FROM pages),
l AS (SELECT DISTINCT page_id, host, unnest(lines) AS line FROM p),
c AS (SELECT host, line, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY host, line),
t AS (SELECT host, count(*) AS total FROM p GROUP BY host),
b AS (SELECT host, list(line) AS drops FROM c JOIN t USING (host) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * total GROUP BY host),
k AS (SELECT page_id, p.host, len(lines) AS n_lines, CASE WHEN drops IS NULL THEN lines ELSE [x FOR x IN lines IF NOT list_contains(drops, x)] END AS rest FROM p LEFT JOIN b ON p.host = b.host)
SELECT page_id, host, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_lines - len(rest), 0) AS BIGINT) AS n_dropped, sha256(array_to_string(rest, chr(10))) AS text_sha256 FROM k
"""
