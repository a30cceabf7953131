import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyfold.llm import block_max as bm
from tallyfold.llm.catalog import QUERIES

from .conftest import prose


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=50):
    """Every document scored for every item by the definition."""
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item in dict.fromkeys(i for i, _ in items):
        terms = {t for i, text in items if i == item for t in words(text)} & df.keys()
        scored = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


def same(rows, want):
    """Equal results, whatever the order of rows that tie in score and id."""
    order = lambda x: (str(x[0]), x[1])
    assert sorted((tuple(r) for r in rows), key=order) == sorted(want, key=order)


def test_terms():
    text = "AbC-1é É x_y\x00z漢字 'ß'"
    assert [t.decode() for t in bm.terms_of(text)] == words(text) and bm.terms_of(None) == []


def test_postings_survive_packing():
    rng = np.random.default_rng(3)
    rows = []
    for term, n in enumerate([1, 2, 127, 128, 129, 1000, 5000]):
        at = np.sort(rng.choice(200_000 if term % 2 else 6000, n, replace=False))
        rows.append(np.stack([np.full(n, term), at, rng.choice([1, 2, 300, 70_000] if term > 3 else [1], n)]))
    term, doc, tf = np.concatenate(rows, axis=1)
    lengths = rng.integers(1, 5000, 200_000)
    payload, ends, blocks, block_ends = bm.packed(term, doc, tf, lengths)
    for t, r in enumerate(rows):
        a, b = (ends[t - 1], block_ends[t - 1]) if t else (0, 0)
        data, own = payload[a : ends[t]].tobytes(), blocks[b : block_ends[t]]
        got = [bm.unpacked(x, min(bm.BLOCK, r.shape[1] - i * bm.BLOCK), int(own["last"][i - 1]) if i else -1, data) for i, x in enumerate(own)]
        assert (np.concatenate([g[0] for g in got]) == r[1]).all() and (np.concatenate([g[1] for g in got]) == r[2]).all()
        assert all(x["tf"] == g[1].max() and x["n"] == lengths[g[0]].min() for x, g in zip(own, got))


def test_search_matches_brute_force_over_shards(spark, monkeypatch):
    """Skewed terms, ties, several shards, items in several blocks, thresholds from the first shard."""
    rng = random.Random(1)
    vocabulary = [f"t{i}" for i in range(400)]
    text = lambda n: " ".join(vocabulary[min(399, int(rng.paretovariate(0.6)) - 1)] for _ in range(n))
    docs = [(i, text(rng.choice([3, 20, 100]))) for i in range(3000)] + [(i, "t0 t1 same") for i in range(3000, 3100)] + [(None, "t1 t2 rare"), (5, "t5 rare"), (9, None), (10, "")]
    items = [(i, text(rng.choice([1, 4, 30]))) for i in range(30)] + [(1, "t7 unknown"), (None, "rare same"), (77, None), (78, "nowhere")]
    monkeypatch.setattr(bm, "MOST_PAIRS", 100)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = bm.ranked(d, spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    same(found.collect(), want)
    assert len(want) > 1000


def test_blocks_are_rejected_before_they_are_unpacked():
    rng = np.random.default_rng(5)
    n = 20_000
    lengths = rng.integers(50, 500, n)
    often, rare = np.arange(n), np.sort(rng.choice(n, 300, replace=False))
    term = np.repeat([0, 1], [len(often), len(rare)])
    payload, ends, blocks, block_ends = bm.packed(term, np.concatenate((often, rare)), np.concatenate((rng.integers(1, 4, n), rng.integers(1, 9, 300))), lengths)
    lists = {"often": (n, blocks[: block_ends[0]].tobytes(), payload[: ends[0]].tobytes()), "rare": (300, blocks[block_ends[0] :].tobytes(), payload[ends[0] :].tobytes())}
    at = bm.ShardSearch(lists, lengths, {"often": 3, "rare": 4000}, n, int(lengths.sum()))
    docs, scores = at.best(["often", "rare"], 20)
    everything = bm.ShardSearch(lists, lengths, {"often": 3, "rare": 4000}, n, int(lengths.sum()))
    total = np.zeros(n, np.int64)
    for x in everything.lists.values():
        d, s = everything.blocks(x, range(len(x.blocks)))
        total[d] += s
    want = np.lexsort((np.arange(n), -total))[:20]
    assert docs.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert at.unpacked < 0.7 * everything.unpacked


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_matches_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    same(QUERIES["op11_block_max_maxscore"](spark, sf).collect(), brute(docs, items))


def test_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, prose(1)), (2, "quick 漢字 the"), (3, "")], "item_id int, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = bm.ranked(odd_docs, items)
    assert dict(got.dtypes)["item_id"] == "int"
    same(got.collect(), brute(rows, [(1, prose(1)), (2, "quick 漢字 the"), (3, "")]))
    assert bm.ranked(odd_docs.limit(0), items).count() == 0 and bm.ranked(odd_docs, items.limit(0)).count() == 0
