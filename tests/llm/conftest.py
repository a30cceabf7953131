import pytest

LONG = "the quick brown fox " * 20_000
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int = 60) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing", str(r.randint(0, 99))]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and very long texts, ties, repeated rows, and columns with names used inside the operators."""
    rows = [
        (1, prose(1), "en", "a"), (1, prose(1), "en", "a"), (2, prose(1).upper(), "en", "a"), (3, prose(2), None, None), (3, prose(3), "de", "b"),
        (None, prose(4), "en", "a"), (None, None, None, None), (4, None, "en", "b"), (5, "", "en", "b"), (6, " \n\t ", "en", ""), (7, LONG, "en", "a"),
        (8, "x", "en", "b"), (9, "\n".join(["same line of words"] * 40), "en", "b"), (10, "é漢字 😀 ́\x00", "fr", "c"), (1000000007, prose(5), "es", "c"),
    ]
    more = [(*r, None if r[1] is None else len(r[1]), 1, "key", 2, "spans", 3.0, "x", True, 5, "h") for r in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, fp int, key string, row int, spans string, score double, x string, kept boolean, size int, host string"
    return spark.createDataFrame(more, names)
