import hashlib
import re

import pytest

from tallyfold.llm import catalog, decontaminate

from .conftest import LONG, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit.update(range(k, k + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def key(rows):
    return sorted(rows, key=str)


ITEMS = [(1, prose(70, 30)), (2, prose(71, 12)), (10, prose(72, 4)), (3, "éa 漢字 ok"), (4, None), (5, ""), (6, "!!"), (7, prose(70, 30)), (None, prose(73, 15)), (8, "quick")]


@pytest.fixture(scope="module")
def tables(spark, odd_docs):
    planted = [(20, prose(80) + "\n" + prose(70, 30).upper() + " " + prose(81)), (21, prose(72, 4)), (22, "x " + prose(71, 12).replace(" ", "--") + " y"), (23, "Éa éa 漢字 OK")]
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + planted
    return docs, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, win string")


def test_report_matches_brute_force(tables, spark):
    docs, df, items = tables
    named = [("None" if i is None else i, t) for i, t in ITEMS]
    got = [tuple(r) for r in decontaminate.report(df, items).collect()]
    want = brute(docs, [(i, t) for i, t in named if i != "None"])
    assert key(got) == key(want)


def test_many_windows_are_scanned_in_parts(tables, monkeypatch):
    docs, df, items = tables
    whole = key(tuple(r) for r in decontaminate.report(df, items).collect())
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", 9)
    assert key(tuple(r) for r in decontaminate.report(df, items).collect()) == whole


def test_cutting_leaves_no_window(tables, odd_docs):
    docs, df, items = tables
    for most in (0.0, 0.5, 1.0):
        kept = decontaminate.without_spans(df, items.where("item_id <> 8"), most_hit=most)
        assert decontaminate.report(kept, items.where("item_id <> 8")).where("contaminated").count() == 0
        assert kept.where("doc_id = 21").count() == (most == 1.0) and kept.where("doc_id is null").count() == 2
    assert kept.where("doc_id = 20").first()["text"].split("\n")[0] == prose(80)
    clean = items.where("item_id = 3")
    assert key(map(tuple, decontaminate.without_spans(odd_docs, clean).collect())) == key(map(tuple, odd_docs.collect()))


def test_empty_tables(tables):
    docs, df, items = tables
    assert decontaminate.report(df.limit(0), items).count() == 0
    assert decontaminate.report(df, items.limit(0)).where("contaminated or n_items > 0").count() == 0
    assert decontaminate.without_spans(df, items.limit(0)).count() == len(docs)


def test_long_text_is_whole():
    at = decontaminate.WindowSet({b" ".join([b"the", b"end"]): ["1"]})
    assert at.scan(decontaminate.words_of(LONG + "the END"))[0] == [(80_000, 80_002)]


def test_query_against_brute_force(spark, sf):
    rows = lambda n, i: [(r[i], r["text"]) for r in spark.read.parquet(f"{sf}/{n}.parquet").collect()]
    got = [tuple(r) for r in catalog.QUERIES["op5_benchmark_decontamination"](spark, sf).collect()]
    assert key(got) == key(brute(rows("documents", "doc_id"), rows("benchmark", "item_id"))) and any(r[5] for r in got)
