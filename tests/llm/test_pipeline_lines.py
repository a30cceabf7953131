import corpus_pipeline

from .conftest import prose

MENU, SHORT, RARE = "a menu line that every site repeats", "read more here", "a sentence that only a few pages share"


def test_stage_cuts_planted_lines_only(spark):
    """On 300 documents of a source: a line on 4 % goes; three words, or 1.3 %, or 4 documents of a small source, stay."""
    rows = [(i, "\n".join([prose(i, 12), *([MENU, SHORT] if i % 25 == 0 else []), *([RARE] if i % 75 == 1 else []), "end"]), "big") for i in range(300)]
    rows += [(1000 + i, f"{prose(1000 + i, 12)}\n{RARE if i < 4 else MENU if i < 9 else ''}", "small") for i in range(20)]
    rows += [(2000, None, "big"), (2001, MENU, None)]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert len(got) == len(rows) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values())
    for i, text, source in rows:
        gone = {MENU} if source else set()
        assert got[i]["text"] == (None if text is None else "\n".join(x for x in text.split("\n") if x not in gone))
