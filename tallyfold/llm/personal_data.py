"""Personal data by weak supervision: labelers vote on candidate spans, EM learns whom to trust, a classifier decides.

Candidates are the base patterns' matches and those of looser patterns: numbers that a greedy base match swallowed
together, phone numbers without a country code, addresses spelled out. Each labeler (pattern, validity,
gazetteer, context, boundary) says yes, no or nothing about each candidate. Expectation-maximisation over all
candidates of the corpus estimates the labelers' reliabilities and each candidate's probability, and a logistic span
classifier over the candidates' features learns from those. It adds spans to the base ones, which always stay.

Votes and features are few and discrete, so what leaves the executors is one count for each combination that occurs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyfold.llm.common import map_batches, map_stream, staged

KINDS = ("email", "ip", "card", "phone")
ROUNDS, FIT_ROUNDS, RIDGE, SMOOTH = 100, 50, 1.0, 1.0
ACCEPT = 0.5

# fixed values: the base patterns (the e-mail's local part is found by walking back from its @)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # no match can start inside a run of digits
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# looser candidates
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]{2,63}){1,4}")
DEFANGED = re.compile(r"(?<![0-9.\]])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])")
PLAIN_CARD = re.compile(r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[ ./-]{1,2}[0-9]{4}){3})(?![0-9])")
PLAIN_PHONE = re.compile(r"(?<![0-9+A-Za-z])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")

ENDINGS = frozenset("com net org edu gov mil int info biz io co de fr es it nl uk eu us ca ch at be pl pt se no dk fi ru cn jp in br mx au".split())
NEAR = {
    "email": frozenset("mail email e-mail contact write adresse correo courriel kontakt an to".split()),
    "ip": frozenset("ip host server address adresse dirección client from login".split()),
    "card": frozenset("card visa mastercard amex credit pay payment karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon téléphone teléfono whatsapp".split()),
}
AGAINST = frozenset("version v isbn issn order invoice id no nr sku section token key hash build ref".split())
LABELERS = 5


# --- spans ---


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns: leftmost and apart within a kind, failing matches dropped without another try."""
    out = [("email", a, e) for a, e in _emails(text)]
    if any(c in text for c in "0123456789"):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15] if "+" in text else []
    return in_order(out)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, bool]]:
    """The base spans and those looser ones that overlap no base span."""
    loose = [("email", *m.span()) for m in SPELLED.finditer(text)] if "at)" in text or "at]" in text or "at}" in text else []
    if any(c in text for c in "0123456789"):
        loose += [("ip", *m.span()) for m in DEFANGED.finditer(text)]
        loose += [("card", *m.span()) for m in PLAIN_CARD.finditer(text)]
        loose += [("phone", *m.span()) for m in PLAIN_PHONE.finditer(text)]
    out, end, k = [], 0, 0
    taken = sorted((a, e) for _, a, e in base)
    for s in sorted(loose, key=lambda s: (s[1], -s[2])):
        while k < len(taken) and taken[k][1] <= s[1]:
            k += 1
        if s[1] >= end and not any(a < s[2] and e > s[1] for a, e in taken[k : k + 4]):
            out.append((*s, False))
            end = s[2]
    return [(*s, True) for s in base] + out


# --- votes and features ---


def votes(text: str, kind: str, a: int, e: int, base: bool) -> tuple[list[int], list[int]]:
    """What the labelers say (1 yes, 0 nothing, -1 no) and the features (0 or 1) of a candidate."""
    s, digits = text[a:e], digits_of(text[a:e])
    before = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", text[max(0, a - 40) : a].lower())[-3:]
    whole = (a == 0 or not text[a - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
    if kind == "email":
        parts = re.split(r"\.|\(dot\)|\[dot\]|\{dot\}", s.lower())
        valid, known = ".." not in s and "." not in (s[0], s[-1]), parts[-1].strip() in ENDINGS
        against = not parts[-1].strip().isalpha()
    elif kind == "ip":
        parts = [int(p) for p in re.findall("[0-9]+", s)]
        valid = len(parts) == 4 and max(parts) <= 255
        known, against = 0 < parts[0] < 224 and parts[0] != 127, parts[0] == 0 or max(parts) < 20
    elif kind == "card":
        valid = 12 <= len(digits) <= 19 and luhn(digits)
        known, against = digits[:1] in "3456" and len(digits) in (13, 14, 15, 16, 19), len(set(digits)) < 3
    else:
        area = digits[-10:-7]
        valid = 9 <= len(digits) <= 15
        known, against = len(digits) in (10, 11, 12) and area[:1] not in ("0", "1", ""), len(set(digits)) < 3
    said = [
        1 if base else -1 if kind == "card" and not valid else 0,
        1 if valid else -1,
        1 if known else -1 if against else 0,
        1 if any(w in NEAR[kind] for w in before) else -1 if before and before[-1] in AGAINST else 0,
        1 if whole else -1,
    ]
    shape = [base, valid, known, against, whole, "+" in s[:1], "(" in s, "-" in s, " " in s, len(digits) >= 14]
    return said, [int(x) for x in shape]


FEATURES, VALID = 10, 1


def _code(said: list[int], shape: list[int]) -> int:
    """A candidate's votes and features as one number."""
    n = 0
    for v in said:
        n = n * 3 + v + 1
    for f in shape:
        n = n * 2 + f
    return n


def _decoded(code: int) -> tuple[list[int], list[int]]:
    shape, said = [], []
    for _ in range(FEATURES):
        code, f = divmod(code, 2)
        shape.append(f)
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        said.append(v - 1)
    return said[::-1], shape[::-1]


# --- learning ---


def em(said: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each vote pattern, reliabilities [labeler, class, vote]) for patterns that occur n times.

    Votes are independent given the class; the start is the mean vote, and every vote has been seen ``SMOOTH`` times.
    """
    p = np.clip(0.5 + said.mean(1) / 2, 0.05, 0.95)
    onehot = (said[:, :, None] == np.array([-1, 0, 1])).astype(float)
    table = np.zeros((said.shape[1], 2, 3))
    for _ in range(rounds):
        prior = (SMOOTH + (n * p).sum()) / (2 * SMOOTH + n.sum())
        log = np.zeros((2, len(p)))
        for c, w in enumerate((1 - p, p)):
            seen = np.einsum("r,rlv->lv", n * w, onehot) + SMOOTH
            table[:, c] = seen / seen.sum(1, keepdims=True)
            log[c] = math.log(prior if c else 1 - prior) + np.einsum("rlv,lv->r", onehot, np.log(table[:, c]))
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return p, table


def classifier(x: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights (the bias last) of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(FIT_ROUNDS):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - q)) - RIDGE * w
        step = np.linalg.solve((x * (n * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + RIDGE * np.eye(len(w)), slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learned(found: DataFrame) -> dict[str, dict[int, float]]:
    """The probability of every combination of votes and features that occurs, by kind, from (kind, code) rows.

    Numbers that fail their kind's check (Luhn, octets, length) teach, but are never accepted.
    """
    counts = found.groupBy("kind", "code").count().collect()  # at most 3 ** 5 * 2 ** 10 combinations for each kind
    out: dict[str, dict[int, float]] = {}
    for kind in KINDS:
        mine = [(r["code"], r["count"]) for r in counts if r["kind"] == kind]
        if not mine:
            continue
        mine.sort()
        both = [_decoded(c) for c, _ in mine]
        said, shape, n = np.array([b[0] for b in both]), np.array([b[1] for b in both], float), np.array([m[1] for m in mine], float)
        w = classifier(shape, em(said, n)[0], n)
        q = 1 / (1 + np.exp(-np.clip(np.hstack([shape, np.ones((len(shape), 1))]) @ w, -30, 30)))
        out[kind] = {c: float(x) if valid else 0.0 for (c, _), x, valid in zip(mine, q, shape[:, VALID])}
    return out


# --- the operator ---

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,code:long>>"


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row, spans as arrays of (kind, start, end) in code points, in order.

    Base spans always stay; the classifier adds candidates that it accepts. Null and empty texts have none, repeated
    rows stay and count in the learning, an empty table gives no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = []
            for t in b["text"].to_pylist():
                t = t or ""
                rows.append([{"kind": k, "start": a, "end": e, "base": is_base, "code": _code(*votes(t, k, a, e, is_base))} for k, a, e, is_base in candidates(t, base_spans(t))])
            yield {"doc_id": b["doc_id"], "found": rows}

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = staged(map_stream(given, run, f"doc_id long, found {SPANS}"), "personal-data")
    model = learned(found.select(F.explode("found").alias("f")).select("f.kind", "f.code"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def decide(b: pa.RecordBatch) -> dict:
        base, every = [], []
        for found in b["found"].to_pylist():
            own = in_order([(f["kind"], f["start"], f["end"]) for f in found if f["base"]])
            more = [(f["kind"], f["start"], f["end"]) for f in found if not f["base"] and held.value[f["kind"]][f["code"]] >= ACCEPT]
            base.append([dict(zip(("kind", "start", "end"), s)) for s in own])
            every.append([dict(zip(("kind", "start", "end"), s)) for s in in_order(own + more)])
        return {"doc_id": b["doc_id"], "base": base, "spans": every}

    span = "array<struct<kind:string,start:int,end:int>>"
    return map_batches(found, decide, f"doc_id long, base {span}, spans {span}")


def _of_kind(kind: str) -> Column:
    return F.filter("base", lambda s: s["kind"] == kind)


def summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): the numbers and the hash are of the base spans."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return detected(docs).select("doc_id", *counts, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))
