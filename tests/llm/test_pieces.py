import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tallyfold.llm import catalog, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PATH)


def test_fuzz_against_the_library(library, model):
    rng = random.Random(1)
    bits = [*"abcdefghij  \n\t.,'’()éß▁<0x>$#%&\\/:;ﬁ漢字かな한글😀́\x00​�", "the", "ing", " ", "  ", "   ", "tion", "▁▁", "https://", "\r\n", "ация", "日本", "<s>"]
    for _ in range(8000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        ids = library.encode(text)
        assert model.encode(text) == ids
        assert model.decode(ids) == library.decode(ids)
        assert model.digests(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_runs_of_spaces_and_long_words(library, model):
    for n in [*range(1, 70), 1000, 5000]:
        for text in (" " * n, " " * n + "the", "a" + " " * n, "a" * n, "ab" * n, "th" * n, "9" * n, "==" * n):
            assert model.encode(text) == library.encode(text), (n, text[:9])


def test_decoding_of_any_ids(library, model):
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.choice((rng.randrange(3, 400), rng.randrange(3, 32_000))) for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_one_sequence_is_compatible(model):
    """Backtracking and merging agree on words that need steps back."""
    rng = random.Random(8)
    for _ in range(3000):
        text = "▁" + "".join(rng.choice(["th", "e", "r", "in", "g", "an", "d", "s", "t", "h", "on", "ti"]) for _ in range(rng.randint(1, 14)))
        assert model.backtracked(text) == model.merged(text) == model._merged_long(text)


def test_odd_rows(spark, odd_docs, library):
    got = pieces.digests(odd_docs, PATH).toPandas()
    texts = [r["text"] or "" for r in odd_docs.collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((len(i), sha(",".join(map(str, i))), sha(library.decode(i))) for i in map(library.encode, texts))
    assert sorted(zip(got["n_tokens"], got["ids_sha256"], got["decoded_sha256"])) == want
    back = pieces.decoded(pieces.encoded(odd_docs, PATH), PATH).collect()
    assert sorted(r["text"] for r in back) == sorted(texts)
    assert pieces.digests(odd_docs.limit(0), PATH).count() == 0


def test_query_against_the_library(spark, sf, library):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op6_sentencepiece_backtracking"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(d["text"])
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
