import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyfold.llm import prefix_trie as pt
from tallyfold.llm.catalog import QUERIES


def brute(rows):
    """Every node by plain Python dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - int(c - 5 * int(c / 5)), [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_conversation_prefix_trie"](spark, sf)) == brute(rows)


@pytest.mark.parametrize("most", [4, 60, pt.SHARD_TURNS])
def test_hot_prefixes_and_copies(spark, most):
    """A third of all conversations are copies, another third begin alike for six turns; small shards cut both apart."""
    rng, rows = random.Random(most), []
    for c in range(240):
        if c % 3 == 0:
            turns = [f"copy {k}" for k in range(7)]
        elif c % 3 == 1:
            turns = [f"alike {k}" for k in range(6)] + [f"own {rng.randrange(4)}" for _ in range(rng.randint(0, 4))]
        else:
            turns = [f"é{rng.randrange(3)}" for _ in range(rng.randint(1, 12))]
        rows += [(c, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(turns)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert found(pt.prefix_nodes(d, most)) == brute(rows)


def test_double_array_holds_every_sequence():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, w, rng.integers(0, 9)) for w in [2] * 30 + [300] * 200 for _ in (0, 1)]
    trie = pt.DoubleArray(np.concatenate(seqs), np.cumsum([len(s) for s in seqs]))
    at = {}
    for d, on, states in trie.walk():
        for i, s in zip(on, states):
            assert at.setdefault(int(s), tuple(seqs[i][:d])) == tuple(seqs[i][:d])
    assert len(set(at.values())) == len(at) == len({tuple(s[:d]) for s in seqs for d in range(len(s) + 1)})


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, "user", ""), (2, 3, None, "é" * 5000), (None, 0, "user", "lost"), (0, 0, "a", "b"),
        (-7, 0, "a", "b"), (-5, 0, "c", "d"), (7, 5, "a", "b"), (12, None, "a", "b"), (5, 1, "z", "z"), (10**12 + 3, 1, "z", "z"),
    ]
    more = [(*r, 1, "key", 2, ["path"]) for r in rows]
    d = spark.createDataFrame(more, "conv_id long, turn long, role string, text string, depth int, key string, n int, path array<string>")
    assert found(pt.prefix_nodes(d)) == brute(rows)
    assert pt.prefix_nodes(d.limit(0)).count() == 0
