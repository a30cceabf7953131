"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all the training sees. The class prior (the share of good text in the
unlabelled) is estimated first: a scorer that tells positives from unlabelled is fitted on one half, and on the other
half the prior is bounded by P_unlabelled(S) / P_positive(S) over the sets S of rows that score above a cutoff and hold
half the positives or more; the least ratio is the estimate. The classifier then minimises the
non-negative unbiased risk

    prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])

with the logistic loss, so that g estimates the log odds of being good. g is one hidden layer over measures of
the text's form.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyfold.llm.common import map_batches, staged
from tallyfold.llm.quality_rules import repeated_words

MOST_POSITIVE, MOST_UNLABELLED = 20_000, 40_000  # rows of the fit, those with the least hashes
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 16, 30, 1024, 0.01, 1e-4, 7
THRESHOLD = 0.3
LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def features(text: str | None) -> list[float]:
    """Measures of a whole text's form; a null text is empty."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, w, li = max(1, len(raw)), max(1, len(words)), max(1, len(lines))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    top = int(np.bincount(ids).max()) if words else 0
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    packed = 0
    squeeze = zlib.compressobj(1)
    for i in range(0, len(raw), 1 << 20):
        packed += len(squeeze.compress(raw[i : i + (1 << 20)]))
    packed += len(squeeze.flush())
    letters = share(LETTERS)
    return [
        np.log1p(len(words)), np.log1p(len(raw)), sizes.mean(), np.log1p(sizes.max()), np.log1p(len(lines)), np.log1p(len(raw) / li),
        share(b"#*$%&|<>"), np.sqrt(share(b"#*$%&|<>")), share(b"!"), np.sqrt(share(b"!")), share(b"|"), share(b".,;:?"), share(b"0123456789"), share(LETTERS[26:]), np.sqrt(share(LETTERS[26:])),
        letters, share(bytes(range(128, 256))), len(number) / w, np.log1p(len(number)), top / w, float((ids[1:] == ids[:-1]).sum()) / w, repeated_words(ids) / w,
        (len(lines) - len(set(lines))) / li, packed / n, float(words[-1][-1:] in (b".", b"!", b"?")) if words else 0.0, float((sizes == 1).mean()),
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, x): held_out is every fifth row by the checksum of its id, a null id counting as empty."""

    def run(b: pa.RecordBatch) -> dict:
        return {"doc_id": b["doc_id"], "held_out": b["held_out"], "x": [features(t) for t in b["text"].to_pylist()]}

    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.crc32(key) % 5 == 0).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(given, run, "doc_id long, held_out boolean, x array<float>")


# --- the model ---


@dataclass
class Net:
    """One hidden layer over standardised inputs."""

    mean: np.ndarray
    scale: np.ndarray
    params: list[np.ndarray]

    @staticmethod
    def new(x: np.ndarray, rng: np.random.Generator) -> Net:
        d = x.shape[1]
        params = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        return Net(x.mean(0), x.std(0) + 1e-6, params)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.params[0] + self.params[1])
        return z, h, h @ self.params[2] + self.params[3][0]

    def backward(self, z: np.ndarray, h: np.ndarray, dg: np.ndarray) -> list[np.ndarray]:
        dh = dg[:, None] * self.params[2] * (1 - h * h)
        return [z.T @ dh, dh.sum(0), h.T @ dg, np.array([dg.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[2], -30, 30)))


def fitted(pos: np.ndarray, unl: np.ndarray, prior: float | None, epochs: int = EPOCHS) -> Net:
    """A net by the non-negative risk under ``prior``, or by telling positives from unlabelled where that is None."""
    rng = np.random.default_rng(SEED)
    net = Net.new(np.concatenate([pos, unl]), rng)
    first, second = [np.zeros_like(p) for p in net.params], [np.zeros_like(p) for p in net.params]
    steps = max(1, -(-len(unl) // BATCH))
    sigma = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    loss = lambda g: np.logaddexp(0, -g).mean()  # noqa: E731  of calling a row positive
    t = 0
    for _ in range(epochs):
        p_at, u_at = rng.permutation(len(pos)), rng.permutation(len(unl))
        for k in range(steps):
            xp, xu = pos[p_at[k * len(pos) // steps : max(k * len(pos) // steps + 1, (k + 1) * len(pos) // steps)]], unl[u_at[k * BATCH : (k + 1) * BATCH]]
            zp, hp, gp = net.forward(xp)
            zu, hu, gu = net.forward(xu)
            n, m = len(gp), len(gu)
            if prior is None:
                dp, du = (sigma(gp) - 1) / n, sigma(gu) / m
            elif loss(-gu) - prior * loss(-gp) >= 0:
                dp, du = (prior * (sigma(gp) - 1) - prior * sigma(gp)) / n, sigma(gu) / m
            else:  # the estimated risk on negatives fell below zero: step back up
                dp, du = prior * sigma(gp) / n, -sigma(gu) / m
            t += 1
            for i, (a, b) in enumerate(zip(net.backward(zp, hp, dp), net.backward(zu, hu, du))):
                g = a + b + DECAY * net.params[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                net.params[i] = net.params[i] - RATE * (1 - (t - 1) / (epochs * steps)) * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return net


def estimated_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The least P_unlabelled(S) / P_positive(S) over cutoffs, on halves that the scorer was not fitted on."""
    net = fitted(pos[::2], unl[::2], None, epochs=10)
    p, u = np.sort(net.score(pos[1::2])), np.sort(net.score(unl[1::2]))
    if not len(p) or not len(u):
        return 0.5
    cuts = np.unique(np.quantile(p, np.linspace(0, 0.9, 91)))
    of_p = 1 - np.searchsorted(p, cuts, "left") / len(p)
    of_u = 1 - np.searchsorted(u, cuts, "left") / len(u)
    return float(np.clip((of_u / of_p)[of_p >= 0.5].min(), 0.05, 0.99))


# --- the operator ---


def picked(rows: DataFrame, most: int) -> np.ndarray:
    """The measures of up to ``most`` rows, those with the least hashes; hardly more than that many leave the tasks."""
    n = rows.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = 1.0 if n <= most else min(1.0, 1.2 * most / n)
    few = rows.select("x", place.alias("place")).where(F.col("place") < int(share * (1 << 40)))
    return np.array([r["x"] for r in few.orderBy("place", "x").limit(most).toLocalIterator()], np.float64)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Positives are rows labelled good in the four folds that are not held out, unlabelled are all rows of those folds;
    labels of bad text are not read, nor are other columns. Up to ``MOST_POSITIVE`` and ``MOST_UNLABELLED`` rows, those
    with the least hashes of their ids, are fitted on; everything is scored. A null or empty text is scored like any
    other, repeated rows stay, repeated or null labels count once or not at all; without positives or unlabelled rows
    every score is 0.5. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = staged(measured(docs, id_col, text_col), "pu-features")
    train = rows.where(~F.col("held_out"))
    good = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    pos, unl = picked(train.join(good, "doc_id"), MOST_POSITIVE), picked(train, MOST_UNLABELLED)
    net = fitted(pos, unl, estimated_prior(pos, unl)) if len(pos) > 3 and len(unl) > 3 else None
    held = spark.sparkContext.broadcast(net)

    def run(b: pa.RecordBatch) -> dict:
        x = np.array(b["x"].to_pylist(), np.float64)
        s = np.full(len(x), 0.5) if held.value is None or not len(x) else held.value.score(x)
        return {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")
