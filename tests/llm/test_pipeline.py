import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tallyfold.llm import quality_rules
from tallyfold.llm.common import staged

from .conftest import prose
from .test_decontaminate import brute as hits
from .test_near_copies import brute as first_of_near
from .test_sites_and_shards import brute_lines


def brute(docs, labels, items):
    """All stages by plain Python; only the proven level of each stratum comes from its own function, tested elsewhere."""
    truth = {d: q for d, q, _ in labels}
    share = lambda m: max(min(1.0, a / max(1, b)) / quality_rules.SCALES[r] for r, a, b in (("symbols", m[2], m[1]), ("dup_lines", m[3], m[5]), ("repeats", m[4], m[0]), ("capitals", m[6], m[1]), ("runs", m[7], m[0])))
    measured = [(d, quality_rules.measured(d["text"])) for d in docs]
    passed = [(d, share(m)) for d, m in measured if m[0] >= 20 and 100 * m[4] <= 30 * m[0]]
    strata = {d["lang"] or "" for d, _ in passed if d["doc_id"] in truth}
    level = {}
    for s in strata:
        mine = [(x, truth[d["doc_id"]]) for d, x in passed if (d["lang"] or "") == s and d["doc_id"] in truth]
        n = [sum(1 for _, q in mine if q == v) for v in (0, 1)]
        above = [[sum(1 for x, q in mine if q == v and x > t) for t in quality_rules.LEVELS] for v in (0, 1)]
        level[s] = quality_rules.chosen(above[1], above[0], n[1], n[0], quality_rules.MOST_REJECTED, quality_rules.ERROR / len(strata))
    left = [d for d, x in passed if x <= level.get(d["lang"] or "", quality_rules.NEVER)]
    texts = brute_lines([(d["source"], d["text"]) for d in left], 0.02, 5, 4)
    rows = sorted(((d["doc_id"], t) for d, t in zip(left, texts)))
    stay = set(first_of_near(rows))
    rows = [r for r in rows if r[0] in stay]
    rows = [r for r, h in zip(rows, hits(rows, items)) if not h[5]]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return sorted((i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for i, t in rows for ids in [sp.encode(t)])


def test_run_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = lambda n, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select(*c).collect()]
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == brute(docs, rows("labels", "doc_id", "quality", "toxic"), rows("benchmark", "item_id", "text"))
    assert 0 < len(got) < len(docs)


def test_stages_take_odd_rows_and_decide(spark, odd_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    leak = prose(3)
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd_docs, odd_docs.limit(0)):
            out = staged(stage(spark, table, str(tmp_path)), f"odd-{name}")
            if name != "sentencepiece":
                assert out.columns == odd_docs.columns
            assert out.count() <= table.count()
    kept = corpus_pipeline.decontamination(spark, odd_docs, str(tmp_path))
    assert kept.where(kept["text"] == leak).count() == 0 and kept.count() == odd_docs.count() - 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
