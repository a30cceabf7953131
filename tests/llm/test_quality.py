import re

import numpy as np
import pytest

from tallyfold.llm import catalog, pu_quality, quality_rules

from .conftest import LONG, prose


def base(text):
    """The contract's five measures by plain counting."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measures():
    texts = [None, "", " ", "a", " ".join("abcdefgh"), " ".join("abcdefgh" * 2), "x " * 9, "a b c d e f g h i a b c d e f g h", "a\n\na\n \na \n", "é漢 #*$%&|<>", LONG[:4000], prose(3, 300), "a b\x1cc d\x0be"]
    for t in texts:
        assert quality_rules.measured(t)[:5] == base(t), t


def test_upper_bound_is_exact():
    """At the bound, the binomial tail has exactly the error; known values of the rule of three and of k = 1."""
    assert quality_rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), rel=1e-9)
    assert quality_rules.upper_bound(1, 10, 0.05) == pytest.approx(0.3941633, rel=1e-6)
    assert quality_rules.upper_bound(10, 10, 0.05) == 1.0
    from math import comb

    for k, n, e in ((3, 50, 0.01), (40, 60, 0.1), (7, 500, 0.0125)):
        p = quality_rules.upper_bound(k, n, e)
        assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(e, rel=1e-6)


def test_sequence_ends_at_the_first_level_that_is_not_proven():
    n = len(quality_rules.LEVELS)
    good, bad = np.zeros(n), np.linspace(1, 100, n)
    assert quality_rules.chosen(good, bad, 1000, 100, 0.05, 0.01) == quality_rules.LEVELS[-1]
    assert quality_rules.chosen(good, bad, 10, 100, 0.05, 0.01) == quality_rules.NEVER
    good[20:] = 60
    assert quality_rules.chosen(good, bad, 1000, 100, 0.05, 0.01) == quality_rules.LEVELS[19]
    assert quality_rules.chosen(good, np.zeros(n), 1000, 0, 0.05, 0.01) == quality_rules.NEVER


def test_guarantee_holds_over_draws():
    """In no more than the allowed share of draws is the true false-rejection rate above the limit."""
    rng = np.random.default_rng(2)
    levels = np.array(quality_rules.LEVELS)
    over = 0
    for _ in range(300):
        good, bad = rng.exponential(0.25, 400), rng.exponential(1.5, 100)
        above = lambda x: (x[:, None] > levels).sum(0)
        level = quality_rules.chosen(above(good), above(bad), 400, 100, 0.05, 0.05, price=0.0)
        over += np.exp(-min(level, 1e3) / 0.25) > 0.05
    assert over <= 0.05 * 300 + 12


def test_rules_on_labelled_strata(spark, odd_docs):
    rows = [(i, prose(i, 80), "en") for i in range(400)] + [(1000 + i, " ".join(w + "***" for w in prose(i, 80).split()), "en") for i in range(60)]
    rows += [(2000, prose(5000, 80), None), (2001, " ".join(w + "***" for w in prose(1, 80).split()), "xx"), (2002, "short", "en"), (2002, "short", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, *_ in rows if i < 2000] + [(0, None, 0), (7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.judged(docs, labels).collect()}
    assert all(got[i]["kept"] for i in range(400)) and not any(got[1000 + i]["kept"] for i in range(60))
    assert got[1000]["rejected_by"] == ["symbols"] and got[2000]["kept"] and got[2001]["kept"] and got[2002]["base_failed"]
    kept = quality_rules.kept(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    odd = quality_rules.judged(odd_docs, labels)
    assert odd.count() == odd_docs.count() and quality_rules.kept(odd_docs, labels).count() == odd.where("kept").count()
    assert quality_rules.judged(odd_docs.limit(0), labels).count() == 0 and quality_rules.judged(odd_docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_rules_query(spark, sf):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op7_risk_controlled_rules"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        r, m = got[d["doc_id"]], base(d["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        assert r["base_failed"] == (m[0] < 20 or 100 * m[4] > 30 * m[0]) and not (r["base_failed"] and r["kept"])


# --- the classifier ---


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1.5, 1, (3000, 5)), rng.normal(-1.5, 1, (900, 5))
    unl = np.concatenate([pos[1500:], neg])
    prior = pu_quality.estimated_prior(pos[:1500], unl)
    assert abs(prior - 1500 / 2400) < 0.1
    net = pu_quality.fitted(pos[:1500], unl, prior)
    assert (net.score(rng.normal(1.5, 1, (500, 5))) >= 0.3).mean() > 0.95 and (net.score(rng.normal(-1.5, 1, (500, 5))) < 0.3).mean() > 0.9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.QUERIES["op4_pu_quality_classifier"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().drop_duplicates("doc_id")
    assert len(got) == 1000 and got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    from zlib import crc32

    assert (got["held_out"] == [crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    assert (held["predicted"][held["quality"] == 0] == 0).mean() > 0.8


def test_scores_do_not_read_held_out_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = (sorted((r["doc_id"], r["score"]) for r in pu_quality.scored(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_classifier_on_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = pu_quality.scored(odd_docs, labels)
    assert got.count() == odd_docs.count() and got.where("score is null or score < 0 or score > 1 or isnan(score)").count() == 0
    assert pu_quality.scored(odd_docs.limit(0), labels).count() == 0
    assert {r["score"] for r in pu_quality.scored(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert len({len(pu_quality.features(t)) for t in (None, "", " ", "a", LONG, "\n\n")}) == 1
