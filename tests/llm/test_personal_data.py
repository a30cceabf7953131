import hashlib
import random
import re

import numpy as np

from tallyfold.llm import catalog, personal_data

from .conftest import LONG, prose


def reference(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], personal_data.KINDS.index(s[0])))


def joined(spans):
    return ",".join(f"{k}:{a}:{e}" for k, a, e in spans)


def test_base_spans_match_the_patterns():
    rng = random.Random(3)
    bits = ["a", "b.", "@", "@x.co", "1", "23", ".", "255.", "1.2.3.4", "+1", " ", "-", "(", ")", "4532015112830366", "5 5", "0", "é", "٣", "x", "%", "+49 ", "555", "\n"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert personal_data.base_spans(t) == reference(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 100_000, "a" * 100_000 + "@", "@" * 50_000, "1." * 50_000, "+1" + " " * 100_000, "+1(" * 30_000, "(at)" * 20_000, "12-" * 30_000, LONG):
        personal_data.candidates(t, personal_data.base_spans(t))


def test_em_finds_who_is_right():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.85, 0.85, 0.75, 0.55])
    said = np.where(rng.random((4000, 5)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    patterns, n = np.unique(said, axis=0, return_counts=True)
    p, table = personal_data.em(patterns, n)
    assert table[0, 1, 2] > table[1, 1, 2] > table[3, 1, 2] > table[4, 1, 2] and abs(table[0, 1, 2] - 0.95) < 0.05
    at = {tuple(x): y for x, y in zip(patterns, p)}
    assert (np.array([at[tuple(s)] > 0.5 for s in said]) == truth).mean() > 0.93


def test_more_spans_are_found_and_noise_is_not(spark):
    rng = random.Random(4)
    rows = [(i, f"{prose(i, 20)} mail {rng.choice('abc')}{i}@x.com or call +1 (2{rng.randint(10, 99)}) 555-{rng.randint(1000, 9999)} now {prose(i, 5)}") for i in range(80)]
    rows += [(900, "call +1 (269) 555-3296 4532015112830366 today"), (901, "write to bob (at) mail (dot) com"), (902, "build 1234567890123 and order 555"), (903, prose(7, 90)), (904, "host 1.2.3.4 and 1.2.3.999")]
    rows += [(910 + i, f"{prose(i, 9)} 4532015112830366 {prose(i, 3)}") for i in range(20)]
    got = {r["doc_id"]: r for r in personal_data.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    found = lambda i: [text[i][int(a) : int(e)] for _, a, e in (s.split(":") for s in got[i]["spans"].split(",") if s)]
    assert got[900]["n_phone"] == 0 and "+1 (269) 555-3296" in found(900) and "4532015112830366" in found(900)
    assert found(902) == [] == found(903) and found(904) == ["1.2.3.4"]
    for i, t in rows:
        base = reference(t)
        assert got[i]["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest() and set(filter(None, joined(base).split(","))) <= set(got[i]["spans"].split(","))


def test_odd_rows(odd_docs):
    got = personal_data.summary(odd_docs)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert got.count() == odd_docs.count() and got.where("doc_id in (4, 5, 6) and spans <> ''").count() == 0
    assert personal_data.summary(odd_docs.limit(0)).count() == 0


def test_query(spark, sf):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op10_weak_supervision_pii"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base, r = reference(d["text"] or ""), got[d["doc_id"]]
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(s[0] == k for s in base) for k in personal_data.KINDS]
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest() and set(filter(None, joined(base).split(","))) <= set(r["spans"].split(","))
