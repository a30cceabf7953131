"""Quality rules whose cutoffs are chosen under a proven limit on falsely rejected documents.

Every rule rejects a document whose statistic lies above a cutoff. The cutoffs of a stratum are the rules' ``SCALES``
times one level, and the candidate levels are fixed in advance, so all labelled documents serve as the holdout.
Levels are tested from the highest (which rejects least) downwards: one passes if the exact binomial
(Clopper-Pearson) upper bound of the share of good documents that the rules reject together stays within
``most_rejected``, and the sequence ends at the first that does not. A fixed sequence needs no correction of its own; the
strata share ``error`` equally (Bonferroni). So with probability 1 - error, in every stratum at once, no more than
``most_rejected`` of the good documents are rejected. Among the levels that passed, the one is used that rejects the
most bad documents beyond ``price`` times the share of good ones, the highest on ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyfold.llm.common import map_batches, staged

WINDOW = 8
SCALES = {"symbols": 0.1, "dup_lines": 0.5, "repeats": 0.5, "capitals": 0.5, "runs": 0.3}
LEVELS = tuple(k / 10 for k in range(40, 1, -1))  # candidates, the highest first
NEVER = 1e9  # a level that rejects nothing
MOST_REJECTED, ERROR, PRICE = 0.05, 0.05, 5.0
MOST_STRATA = 10_000
STATS = (
    "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_same long"
)


def repeated_words(ids: np.ndarray, size: int = WINDOW) -> int:
    """Words inside windows of ``size`` (a power of two) words that occur twice or more; windows are told apart exactly."""
    if len(ids) <= size:
        return 0
    rank, step = ids, 1
    while step < size:  # ranks of windows twice as long from pairs of ranks
        pairs = rank[:-step] * np.int64(len(ids) + 1) + rank[step:]
        rank, step = np.unique(pairs, return_inverse=True)[1].astype(np.int64), step * 2
        if rank.max() == len(rank) - 1:
            return 0  # no window is repeated any more
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measured(text: str | None) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_same) of a whole text."""
    if not text:
        return (0,) * 8
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # on bytes: ASCII white space
    lines = [x for x in raw.split(b"\n") if x.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    solid = raw.translate(None, b" \t\n\v\f\r")
    return (
        len(words),
        len(text) - (len(raw) - len(solid)),
        len(raw) - len(raw.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        len(solid) - len(solid.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        int((ids[1:] == ids[:-1]).sum()),
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row of measures for every document row; a null or empty text has zeros, a null stratum is the empty one."""

    def run(b: pa.RecordBatch) -> dict:
        rows = [measured(t) for t in b["text"].to_pylist()]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_same")
        return {"doc_id": b["doc_id"], "stratum": b["stratum"]} | {n: [r[k] for r in rows] for k, n in enumerate(names)}

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text"))
    return map_batches(given, run, STATS)


def _shares() -> dict:
    """The rules' statistics from the measures, each from 0 to 1."""
    share = lambda a, b: F.least(F.lit(1.0), F.col(a) / F.greatest(F.lit(1), F.col(b)))
    return {
        "symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_upper", "word_chars"), "runs": share("n_same", "n_words"),
    }


def severity() -> Column:
    """The level up to which a document is rejected: its largest statistic in units of the rule's scale."""
    return F.greatest(*[x / SCALES[r] for r, x in _shares().items()])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


# --- exact bounds ---


def upper_bound(k: int, n: int, error: float) -> float:
    """The Clopper-Pearson upper bound: the p at which k or fewer of n have probability ``error``."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if _at_most(k, n, p) > error:
            low = p
        else:
            high = p
    return high


def _at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial, summed downwards from the term at k until terms vanish."""
    if p <= 0 or p >= 1:
        return float(p <= 0)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = 0.0, k
    while i >= 0 and term > 1e-18 * max(total, 1e-300):
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p)
        i -= 1
    return min(1.0, total)


def chosen(good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int, most: float, error: float, price: float = PRICE) -> float:
    """The level of one stratum from the numbers of good and bad documents above each candidate."""
    best, worth = NEVER, 0.0
    for k, level in enumerate(LEVELS):
        if n_good == 0 or upper_bound(int(good[k]), n_good, error) > most:
            break
        gain = bad[k] / max(1, n_bad) - price * good[k] / n_good
        if gain > worth + 1e-12:
            best, worth = level, gain
    return best


def levels(stats: DataFrame, labels: DataFrame, most_rejected: float = MOST_REJECTED, error: float = ERROR) -> dict[str, float]:
    """The level of every stratum with labelled documents.

    What passes through the driver is one count for each stratum, candidate and label; the number of strata is checked.
    A document labelled twice counts as bad if any label says so; null labels are not read. Documents that fail the
    base rules are decided already and take no part.
    """
    truth = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    above = F.array(*[F.lit(x) for x in LEVELS])
    first = F.size(F.filter(above, lambda x: F.col("severity") <= x))  # candidates that the document passes come first
    seen = stats.where(~base_failed()).withColumn("severity", severity()).join(truth, "doc_id")
    counted = seen.groupBy("stratum", (F.col("quality") == 1).alias("good"), first.alias("first")).count()
    by: dict[str, np.ndarray] = {}
    for r in counted.toLocalIterator():
        by.setdefault(r["stratum"], np.zeros((2, len(LEVELS) + 1), np.int64))[int(r["good"]), r["first"]] += r["count"]
        if len(by) > MOST_STRATA:
            raise ValueError("too many strata")
    return {
        stratum: chosen(n[1].cumsum(), n[0].cumsum(), int(n[1].sum()), int(n[0].sum()), most_rejected, error / len(by)) for stratum, n in sorted(by.items())
    }


# --- the operator ---


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by) of every row.

    A document goes if it fails the base rules (under 20 words, or over 30 % of them in repeated windows of 8 words) or
    if a rule's statistic exceeds its stratum's cutoff. Strata without labels, or with too few to prove anything, have
    no cutoffs. Null and empty texts fail the base rules; rows with a null id are judged; repeated rows stay; empty
    tables give no rows or no cutoffs; other columns are not read.
    """
    spark = docs.sparkSession
    stats = staged(statistics(docs, id_col, text_col, stratum_col), "quality")
    table = F.broadcast(spark.createDataFrame(list(levels(stats, labels).items()), "stratum string, level double"))  # no more than MOST_STRATA rows
    j = stats.join(table, "stratum", "left")
    broken = F.array_compact(F.array(*[F.when(x / SCALES[r] > F.col("level"), r) for r, x in _shares().items()]))
    return j.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & (F.size(broken) == 0)).alias("kept"), broken.alias("rejected_by")
    )


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The documents that ``judged`` keeps, with all their columns; rows are decided one by one, not by their id."""
    spark = docs.sparkSession
    limits = levels(staged(statistics(docs, id_col, text_col, stratum_col), "quality"), labels)
    held = spark.sparkContext.broadcast(limits)

    @F.pandas_udf("boolean")
    def passes(texts, strata):
        import pandas as pd

        return pd.Series([_passes(measured(t), held.value.get(s or "", NEVER)) for t, s in zip(texts, strata)], dtype=bool)

    return docs.where(passes(F.col(text_col), F.col(stratum_col).cast("string")))


def _passes(m: tuple[int, ...], level: float) -> bool:
    n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines, n_upper, n_same = m
    if n_words < 20 or 100 * n_repeat > 30 * n_words:
        return False
    share = {"symbols": n_symbols / max(1, word_chars), "dup_lines": n_dup / max(1, n_lines), "repeats": n_repeat / n_words, "capitals": n_upper / max(1, word_chars), "runs": n_same / n_words}
    return all(min(1.0, x) / SCALES[r] <= level for r, x in share.items())
