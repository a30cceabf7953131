import random

import corpus_pipeline
from tallyfold.llm import components, near_copies

from .conftest import prose


def runs(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The least id of each component of texts whose five-word shingles have similarity 0.8 or more."""
    sets, root = [runs(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    return sorted({find(i): min(r[0] for j, r in enumerate(rows) if find(j) == find(i)) for i in range(len(rows))}.values())


def test_stage_keeps_one_of_each_component(spark):
    """Short texts with edits, a chain, a large group with stragglers: bits apart do not matter, similarity does."""
    rng = random.Random(8)
    texts = [prose(i, rng.choice([40, 90, 200])) for i in range(30)]
    for i in range(150):
        words = rng.choice(texts[:30] if i % 3 else texts).split()
        for k in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = f"new{i}x{k}"
        texts.append(" ".join(words))
    hot = prose(99, 120).split()
    texts += [" ".join(hot[:a] + [f"w{a}"] + hot[a + 1 :]).upper() for a in range(0, 120, 2)] + [None, "", " \n", "one two", "One  two", "one three"]
    rows = list(zip(rng.sample(range(9999), len(texts)), texts))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == brute(rows) and len(got) < len(rows) - 60


def test_odd_rows(odd_docs):
    kept = near_copies.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id in (2, 5, 6)").count() == 0
    assert kept.where("doc_id = 4").count() == 1 and kept.where("doc_id is null").count() == 1
    assert near_copies.deduplicated(odd_docs.limit(0)).count() == 0


def test_contracted_components(spark):
    """Chains, stars, repeated and self links, against union-find; every node but the roots once."""
    rng = random.Random(12)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(60)] + [(7, 7), (2001, 2000)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components.contracted(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in root if find(x) != x} and len(got) == sum(find(x) != x for x in root)
    assert components.contracted(spark.createDataFrame([], "a long, b long")).count() == 0
