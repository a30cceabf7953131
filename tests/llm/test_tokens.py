import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tallyfold.llm import catalog, rans
from tallyfold.session import scratch_path

from .conftest import prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return rans.WordEncoder(PATH)


def test_words_give_the_ids_of_whole_texts(encoder):
    rng = random.Random(2)
    bits = [*"abcDEFghij  \n\t.,'’()éßÀİΣςſ<0x>$#%&\\/:;ﬁ漢字한😀́\x00\x1c​½²ªº", "'s", "'LL", "I'm", "the", " ", "<|endoftext|>", "|>", "\x85", "\xa0", "Ⅷ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(4000)] + [prose(9, 500)]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == want
    assert encoder.encode([None, ""]) == [b"", b""]


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, (1 << 17) - 1, 1 << 17, (1 << 17) + 5, 400_001])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n), 49_407).astype(np.uint16)
    counts = np.bincount(ids, minlength=rans.MOST_IDS)
    coder = rans.Coder(rans.quantised(counts))
    payload = coder.encode(ids)
    assert (coder.decode(payload) == ids).all()
    for k in range(-(-n // rans.SEGMENT)):
        assert (coder.decode(payload, segment=k) == ids[k * rans.SEGMENT : (k + 1) * rans.SEGMENT]).all()


def test_size_is_near_the_entropy_and_damage_is_seen():
    ids = np.random.default_rng(1).integers(0, 300, 1 << 19).astype(np.uint16) ** 2 % 977
    counts = np.bincount(ids, minlength=rans.MOST_IDS)
    coder = rans.Coder(rans.quantised(counts))
    payload = coder.encode(ids)
    p = counts[counts > 0] / len(ids)
    assert len(payload) < 1.15 * -(p * np.log2(p)).sum() * len(ids) / 8
    for at in (3, 40, len(payload) // 2, len(payload) - 2):
        with pytest.raises(ValueError):
            coder.decode(payload[:at] + bytes([payload[at] ^ 1]) + payload[at + 1 :])


def test_frequencies_add_up():
    for counts in ([1], [5, 0, 1], [10**15, 1, 1, 1], [1] * 60_000, [3] * 5 + [0] * 7):
        f = rans.quantised(np.array(counts))
        assert f.sum() == 1 << rans.BITS and ((f > 0) == (np.array(counts) > 0)).all()


def test_store_of_odd_rows(spark, odd_docs, encoder):
    path = scratch_path(spark, "test-store")
    got = rans.round_trip(odd_docs, PATH, 1, path).collect()
    assert len(got) == odd_docs.count()
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, encoder.encode([r["text"]])[0] + b"\1\0") for r in odd_docs.collect()), key=lambda r: r[:2])
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] or 0 for r in got] == [w[1] for w in want]
    assert sorted(np.frombuffer(r["ids"], "<u4").astype("<u2").tobytes() for r in got) == sorted(w[2] for w in want)
    assert [r["start"] for r in got] == np.cumsum([0, *(len(r["ids"]) // 4 for r in got)])[:-1].tolist()
    assert spark.read.parquet(f"{path}/blocks").count() >= 1
    assert rans.round_trip(odd_docs.limit(0), PATH, 1).count() == 0


def test_query_against_the_library(spark, sf, encoder):
    got = catalog.QUERIES["op2_rans_token_store"](spark, sf).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    ids = [e.ids + [1] for e in encoder.tokenizer.encode_batch(docs["text"].tolist(), add_special_tokens=False)]
    n = np.array([len(x) for x in ids])
    assert (got["n_tokens"] == n).all() and (got["start"] == np.cumsum(n) - n).all()
    assert (got["ids_crc32"] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]).all()
