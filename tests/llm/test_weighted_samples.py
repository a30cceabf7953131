import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import weighted_samples as ws
from tallyfold.llm.catalog import QUERIES

from .conftest import LONG, prose


def weighted_jaccard(a, b):
    a, b = Counter((a or "").lower().split()), Counter((b or "").lower().split())
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def edited(text, behind):
    n = len(text) // 2
    return text[: len(text) - n] + behind[:n]


def test_quantiles_are_those_of_gamma(spark):
    q = ws.gamma_quantiles(spark, 8).first()["q"]
    assert len(q) == 256 and q == sorted(q)
    assert all(abs(1 - (1 + x) * math.exp(-x) - (i + 0.5) / 256) < 1e-9 for i, x in enumerate(q))


def test_collisions_follow_weighted_jaccard(spark):
    """Over many pairs with weights from 1 to 40 the share of equal samples is unbiased and as exact as 64 draws allow."""
    rng, rows, want = random.Random(4), [], []
    for i in range(300):
        words = [f"w{i}x{j}" for j in range(30)]
        a = [w for w in words for _ in range(rng.choice([0, 1, 1, 2, 5, 40]))]
        b = [w for w in words for _ in range(rng.choice([0, 1, 1, 2, 5, 40]))] if i % 3 else a[: rng.randint(1, len(a))]
        rows.append((i, " ".join(a), " ".join(b)))
        want.append(weighted_jaccard(rows[-1][1], rows[-1][2]))
    f = ws.fingerprints(spark.createDataFrame(rows, "k long, a string, b string"), ["k"], ["a", "b"])
    got = {r["k"]: r["s"] for r in f.select("k", ws.likeness(F.col("fingerprint_a"), F.col("fingerprint_b")).alias("s")).collect()}
    error = np.array([got[i] - w for i, w in enumerate(want)])
    bound = np.sqrt(np.maximum(np.array(want) * (1 - np.array(want)), 0.01) / ws.SAMPLES)
    assert abs(error.mean()) < 4 * bound.mean() / math.sqrt(len(error)) and error.std() < 1.2 * bound.mean() and (np.abs(error) < 5 * bound).all()


def test_query_matches_definition(spark):
    """op13 over a whole table: lengths and edited texts exactly, likeness against the true similarity."""
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in QUERIES["op13_consistent_weighted_sampling"](spark, sf).collect()}
    assert len(got) == len(docs)
    errors, by_text = [], {}
    for (i, t), (j, behind) in zip(docs, docs[1:] + docs[:1]):
        e, r = edited(t, behind), got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"] and len(r["fingerprint"]) == ws.SAMPLES * ws.DIGITS
        same = sum(r["fingerprint"][k : k + 4] == got[j]["fingerprint"][k : k + 4] for k in range(0, 256, 4)) / 64
        assert r["near_next"] == same
        errors += [r["near_edited"] - weighted_jaccard(t, e), r["near_next"] - weighted_jaccard(t, behind)]
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.35


def test_odd_rows(spark, odd_docs):
    rows = ws.neighbours(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    blank = [r for r in rows if r["doc_id"] in (4, 5, 6)]
    assert {r["fingerprint"] for r in blank} == {"0" * 256} and {r["n_chars"] for r in blank} == {0, 4}
    twice = [r for r in rows if r["doc_id"] == 1]
    assert len(twice) == 2 and len({r["fingerprint"] for r in twice}) == 1 and sorted(r["near_next"] for r in twice)[1] == 1.0
    assert [r for r in rows if r["doc_id"] == 2][0]["fingerprint"] == twice[0]["fingerprint"]  # case doesn't count
    assert [r["n_chars"] for r in rows if r["doc_id"] == 7] == [len(LONG)]
    assert ws.neighbours(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [["only one"], ["a b c d", "x y z"], [prose(i) for i in range(40)] + [prose(7)] * 25])
def test_every_row_has_its_next_one(spark, texts):
    """Few rows, and many rows with one id, which are cut by the tie."""
    ids = list(range(len(texts))) if len(texts) < 5 else [*range(40), *[99] * 25]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["edited_sha256"]) for r in ws.neighbours(docs).collect())
    order = sorted(zip(ids, texts), key=lambda x: x[0])
    want = sorted((i, hashlib.sha256(edited(t, n).encode()).hexdigest()) for (i, t), (_, n) in zip(order, order[1:] + order[:1]))
    assert got == want
