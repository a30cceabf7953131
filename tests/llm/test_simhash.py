import random

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

from tallyfold.llm import simhash
from tallyfold.llm.catalog import QUERIES

from .conftest import prose


def reference(text):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(ids, fps):
    """component_id of each row by comparing all pairs."""
    u, inv = np.unique(np.array(fps, np.uint64), return_inverse=True)
    root = list(range(len(u)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    comp = [find(i) for i in inv]
    return pd.Series(ids, dtype="float").groupby(comp).transform("min")


def test_fingerprint_matches_definition():
    texts = [None, "", " \n", "A", "a b", "a b c", "a b c d", "A B c d e", "é É x y z w", prose(1), prose(2, 400)]
    assert [simhash.fingerprint(t) for t in texts] == [reference(t) for t in texts]


def test_words_at_most_four_bits_apart_share_a_key():
    golay, rng = simhash.GolayKeys(), np.random.default_rng(1)
    assert sorted(set(golay.count.tolist())) == [1, 6]
    fps = rng.integers(0, 2**64, 500, dtype=np.uint64)
    for d in range(5):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, d, replace=False)) for _ in fps], np.uint64)
        a, b = (set(zip(*(x.tolist() for x in golay.keys(f)))) for f in (fps, fps ^ flips))
        assert len({r for r, _ in a & b}) == len(fps)


def test_links_of_hot_keys_in_blocks(monkeypatch):
    """A key over many batches and blocks keeps all that is connected together."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = np.unique(np.array([base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)], np.uint64).view(np.int64))
    batch = lambda a, e: pa.RecordBatch.from_arrays([pa.array(np.full(len(fps[a:e]), 7)), pa.array(fps[a:e])], names=["key", "fp"])
    out = list(simhash._link_runs(batch(i, i + 23) for i in range(0, len(fps), 23)))
    links = {(int(a), int(b)) for o in out for a, b, k in zip(o["a"], o["b"], o["block"]) if k < 0}
    blocks = {}
    for o in out:
        for fp, k in zip(o["b"], o["block"]):
            if k >= 0:
                blocks.setdefault(int(k), []).append(int(fp))
    assert sorted(x for b in blocks.values() for x in b) == sorted(fps.tolist()) and max(map(len, blocks.values())) <= 16
    for i in blocks:
        for j in blocks:
            if i < j:
                links |= {tuple(r) for r in simhash._cross_block(pd.DataFrame({"fp": blocks[i] + blocks[j]})).itertuples(index=False)}
    assert len(links) < len(fps) * 20 and all(simhash.bits_apart(np.array([a]), np.array([b]))[0] <= 4 for a, b in links)
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = brute(list(range(len(fps))), fps.view(np.uint64))
    got = pd.Series([find(int(f)) for f in fps])
    assert (got.groupby(got).ngroup().to_numpy() == want.map({v: i for i, v in enumerate(dict.fromkeys(want.groupby(got).first()))}).to_numpy()).all() or want.groupby(got).nunique().max() == 1 and got.groupby(want).nunique().max() == 1


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    texts = [prose(i, 300) for i in range(40)]
    for i in range(60):  # near copies, and copies of those
        words = rng.choice(texts).split()
        words[rng.randrange(len(words))] = f"new{i}"
        texts.append(" ".join(words))
    texts += texts[:7] + [None, ""]
    ids = rng.sample(range(10_000), len(texts))
    got = simhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).toPandas()
    assert (got["component_id"] == brute(got["doc_id"], [int(x, 16) for x in got["fingerprint"]])).all()
    assert {i: f"{reference(t):016x}" for i, t in zip(ids, texts)} == dict(zip(got["doc_id"], got["fingerprint"]))
    assert got["component_id"].nunique() < len(texts) - 10


def test_odd_rows(odd_docs):
    got = simhash.near_duplicates(odd_docs)
    rows = got.collect()
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and len(rows) == odd_docs.count()
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
    assert {by[i, "0" * 16] for i in (4, 5, 6, None)} == {4}
    assert by[2, f"{reference(prose(1)):016x}"] == 1 and by[None, f"{reference(prose(4)):016x}"] is None
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    """op1 as it is registered, over a whole table."""
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op1_simhash_near_dedup"](spark, sf).collect()}
    fps = [reference(t) for _, t in docs]
    want = brute([i for i, _ in docs], fps)
    assert got == {i: (f"{f:016x}", int(c)) for (i, _), f, c in zip(docs, fps, want)}
