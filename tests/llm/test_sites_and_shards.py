import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import catalog, histogram_sort, revisits, site_lines

from .conftest import prose

# --- line dedup ---


def brute_lines(rows, ratio, least, words=0):
    """(host, text) -> texts without boilerplate; lines under ``words`` words stay."""
    pages, holds = Counter(h or "" for h, _ in rows), Counter()
    for h, t in rows:
        holds.update({(h or "", x) for x in (t or "").split("\n") if x.strip(" ") and len(x.split()) >= words})
    bad = {k for k, n in holds.items() if n >= least and n > ratio * pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h or "", x) not in bad) for h, t in rows]


@pytest.mark.parametrize("limit", [site_lines.BROADCAST_BYTES, 0])
def test_lines_match_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(site_lines, "BROADCAST_BYTES", limit - (limit == 0))
    rows = [("a", f"menu\n{prose(i, 5)}\nfoot {i % 3}\n\nmenu") for i in range(30)] + [("b", f"menu\n{i}") for i in range(3)]
    rows += [(None, "x\ny"), (None, "x"), (None, None), ("", "x"), ("", "x\n x"), ("a", ""), ("a", None), ("c", "only\nonly")] + [("d", "all the same")] * 9
    docs = spark.createDataFrame([(i, h, t, "q", [1]) for i, (h, t) in enumerate(rows)], "n long, host string, text string, lines string, total array<int>")
    got = {r["n"]: r for r in site_lines.without_boilerplate(docs, F.col("host")).collect()}
    assert [got[i]["text"] for i in range(len(rows))] == brute_lines(rows, site_lines.RATIO, site_lines.LEAST_PAGES)
    assert got[0]["text"].count("menu") == 0 and got[30]["text"] == "menu\n0" and got[len(rows) - 1]["text"] == ""
    assert site_lines.without_boilerplate(docs.limit(0), F.col("host")).count() == 0


def test_columns_and_rows_stay(odd_docs):
    got = site_lines.without_boilerplate(odd_docs, F.col("source"))
    assert got.columns == odd_docs.columns and sorted(map(str, got.collect())) == sorted(map(str, odd_docs.collect()))


# --- revisits ---


def capture(i, url, at, kind, headers, digest=None, status=None):
    return (i, url, at, kind, status or (200 if kind == "response" else 304), headers, digest, f"body of {i}" if digest else None, "x", 1)


ROWS = [
    capture("r1", "http://www.Site.org/p/?utm_a=1#x", 100, "response", {"etag": '"1"', "content-length": "9", "server": "s"}, "d1"),
    capture("r2", "https://site.org:443/p", 200, "response", {"etag": '"2"', "last-modified": "m2", "server": "s"}, "d2"),
    capture("r3", "https://site.org/p", 200, "response", {"etag": '"3"'}, "d3"),
    capture("r4", "https://site.org/p", 300, "response", {"etag": '"4"'}, None),
    capture("r5", "https://site.org/p", 310, "response", {"etag": '"5"'}, "d5", status=404),
    capture("r6", "https://site.org/q?a=1&ref=z", 1, "response", {"last-modified": "m"}, "d6"),
    capture("v1", "site.org/p", 150, "revisit", {"etag": 'W/"1"', "content-length": "0", "server": "t", "date": "now"}),
    capture("v2", "site.org/p", 100, "revisit", {"etag": '"1"'}),
    capture("v3", "site.org/p", 400, "revisit", {"etag": '"3"'}),
    capture("v3", "site.org/p", 400, "revisit", {"etag": '"3"'}),
    capture("v4", "site.org/p", 400, "revisit", {"etag": '"2"'}),
    capture("v5", "site.org/p", 400, "revisit", {"last-modified": "m2"}),
    capture("v6", "site.org/q?ref=y&a=1", 2, "revisit", {"last-modified": "m"}),
    capture("v7", "site.org/q?a=1", 2, "revisit", {"last-modified": "other"}),
    capture("v8", "site.org/Q?a=1", 2, "revisit", {"last-modified": "m"}),
    capture("v9", None, 2, "revisit", {"etag": "1"}),
    capture("v10", "site.org/p", None, "revisit", {"etag": "1"}),
    capture("v11", "site.org/p", 500, "revisit", None),
    capture(None, "site.org/q?a=1", 9, "revisit", {"last-modified": "m"}),
]
SCHEMA = "record_id string, url string, captured long, kind string, status int, headers map<string,string>, payload_digest string, payload string, stored string, turn int"


def test_revisits(spark):
    captures = spark.createDataFrame(ROWS, SCHEMA)
    found = revisits.resolved(captures)
    got = [(r["record_id"], r["outcome"], r["response_id"], r["payload_digest"]) for r in found.collect()]
    want = [("v1", "resolved", "r1", "d1"), ("v2", "no_response", None, None), *[("v3", "resolved", "r3", "d3")] * 2, ("v4", "mismatch", None, None), ("v5", "no_validator", None, None)]
    want += [("v6", "resolved", "r6", "d6"), ("v7", "mismatch", None, None), *[(v, "no_response", None, None) for v in ("v8", "v9", "v10")], ("v11", "no_validator", None, None), (None, "resolved", "r6", "d6")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert found.where("record_id = 'v1'").first()["headers"] == {"etag": 'W/"1"', "content-length": "9", "server": "t", "date": "now"}
    assert {r["payload"] for r in revisits.with_payload(found, captures).where("record_id = 'v3'").collect()} == {"body of r3"}
    assert revisits.resolved(captures.limit(0)).count() == 0


def test_a_hot_url(spark):
    """One URL with nearly all captures: every revisit gets the response just before it."""
    n = 3000
    rows = [capture(f"r{i}", "hot.org/", 10 * i, "response", {"etag": str(i)}, f"d{i}") for i in range(0, n, 3)] + [capture(f"v{i}", "hot.org", 10 * i + 5, "revisit", {"etag": str(i // 3 * 3)}) for i in range(n)]
    got = revisits.resolved(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == n and got.where("outcome <> 'resolved' or response_id <> concat('r', headers['etag'])").count() == 0


# --- shards ---


def test_shards_are_even_and_gapless(spark):
    rows = [(i * i % 100_003, (i * 37) % 5000 + 8, "t") for i in range(5000)]
    out = histogram_sort.sharded(spark.createDataFrame(rows, "doc_id long, size long, piece string"), 24).toPandas().sort_values(["shard", "slot"])
    assert len(out) == len(rows) and (out["doc_id"].diff().dropna() >= 0).all()
    size = out.groupby("shard")["size"].sum()
    assert len(size) == 24 and size.max() - size.min() < 2 * 5008 and all((g["slot"] == range(len(g))).all() for _, g in out.groupby("shard"))


def test_a_hot_key_is_cut(spark):
    """One id holds most rows, others are null; every shard still gets its part, in several pieces each."""
    rows = [(7 if i % 4 else i if i % 8 else None, 100) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, size long")
    for pieces in (1 << 40, 2000):
        old, histogram_sort.PIECE_BYTES = histogram_sort.PIECE_BYTES, pieces
        try:
            out = histogram_sort.sharded(docs, 5).toPandas().sort_values(["shard", "slot"])
        finally:
            histogram_sort.PIECE_BYTES = old
        assert out.groupby("shard").size().tolist() == [800] * 5 and all((g["slot"] == range(len(g))).all() for _, g in out.groupby("shard"))
        assert (out["doc_id"].fillna(-1).diff().dropna() >= 0).all()


def test_odd_shards(odd_docs):
    out = histogram_sort.sharded(odd_docs.withColumn("shard", F.lit("old")).withColumn("size", F.when(F.col("doc_id") == 1, None).otherwise(5)), 24)
    assert out.count() == odd_docs.count() and out.columns == [*odd_docs.columns, "shard", "slot"]
    assert histogram_sort.sharded(odd_docs.limit(0), 24).count() == 0
    assert histogram_sort.sharded(odd_docs.limit(1), 24).select("slot").first()[0] == 0


def test_shard_query(spark, sf):
    got = catalog.QUERIES["op9_histogram_sort_shards"](spark, sf).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    raw = [t.encode() for t in docs["text"]]
    assert got["size"].tolist() == [len(r) + 8 for r in raw] and got["text_crc32"].tolist() == [zlib.crc32(r) for r in raw]
    assert set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all() and set(got["shard"]) <= set(range(24))
    size = got.groupby("shard")["size"].sum()
    assert size.max() - size.min() <= 2 * max(got["size"])


def test_shard_query_digests_the_rows_that_come_out(spark, sf, monkeypatch):
    """Whole documents are sharded, and a text that the exchange changed shows in size and checksum."""
    real, given = histogram_sort.sharded, []

    def harmed(docs, shards):
        given.append(docs.columns)
        return real(docs, shards).withColumn("text", F.concat("text", F.lit("!")))

    monkeypatch.setattr(histogram_sort, "sharded", harmed)
    got = catalog.QUERIES["op9_histogram_sort_shards"](spark, sf).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert set(docs.columns) <= set(given[0])
    raw = [f"{t}!".encode() for t in docs.toPandas().sort_values("doc_id")["text"]]
    assert got["size"].tolist() == [len(r) + 8 for r in raw] and got["text_crc32"].tolist() == [zlib.crc32(r) for r in raw]
