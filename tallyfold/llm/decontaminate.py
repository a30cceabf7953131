"""Benchmark decontamination: word windows of the test items as a broadcast hash set, scanned over every document.

The benchmark side is held on every executor only while it is proven small: its windows are counted first, and
beyond ``MOST_WINDOWS`` it is cut into parts of that size which are scanned one after another, so memory stays
bounded at any number of items and the documents never have to be shuffled by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyfold.llm.common import map_stream, staged

WINDOW = 10
MOST_WINDOWS = 200_000  # windows of one broadcast set
_KEPT = bytes(b if b >= 0x80 or chr(b).isalnum() else ord(" ") for b in range(128)).lower() + bytes(range(128, 256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are runs of a-z, 0-9 and anything outside ASCII, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_KEPT).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """Windows of consecutive words; fewer words, but not none, are one window."""
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def item_windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id string, window string) without repeats; an item without words or without an id has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = [(i, w.decode()) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in set(windows_of(words_of(t), size))]
            yield {"item_id": [r[0] for r in rows], "win": [r[1] for r in rows]}

    return map_stream(items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null"), run, "item_id string, win string").distinct()


@dataclass
class WindowSet:
    """Windows by length with the items that have them, made to be scanned quickly."""

    windows: dict[bytes, list[str]]

    def __post_init__(self) -> None:
        split = [w.split(b" ") for w in self.windows]
        self.number = {w: i + 1 for i, w in enumerate(dict.fromkeys(x for ws in split for x in ws))}
        by: dict[int, list[np.ndarray]] = {}
        for ws in split:
            by.setdefault(len(ws), []).append(np.array([self.number[w] for w in ws], np.uint64))
        self.hashes = {n: np.unique(_rolled(np.stack(ws), n)) for n, ws in by.items()}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(first word, end) of every occurrence, and the items that occur."""
        number = self.number
        ids = np.fromiter((number.get(w, 0) for w in words), np.uint64, len(words))
        known = np.concatenate(([0], np.cumsum(ids > 0)))  # a window with a word that no item has cannot be one
        spans, items = [], set()
        for n, hashes in self.hashes.items():
            if len(words) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            h = _rolled(ids[at[:, None] + np.arange(n)], n)
            for i in at[np.isin(h, hashes)].tolist():
                found = self.windows.get(b" ".join(words[i : i + n]))  # the hit is verified by its words
                if found:
                    spans.append((i, i + n))
                    items.update(found)
        return spans, items


def _rolled(ids: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(ids), np.uint64)
    for k in range(n):
        h = (h ^ ids[:, k]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def scanned(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, spans, items) of every document row against all items.

    ``spans`` holds the first word and the end of every stretch that windows cover, ``items`` the ids of the items that
    occur, sorted as strings. ``row`` numbers the rows apart within this call.
    """
    spark = docs.sparkSession
    windows = staged(item_windows(items, size).groupBy("win").agg(F.collect_set("item_id").alias("items")), "windows")
    parts = max(1, -(-windows.count() // MOST_WINDOWS))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_words long, spans array<array<int>>, items array<string>"
    if parts > 1:  # the same row comes from every part and is put together again
        given = staged(given.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
        schema = f"row long, {schema}"

    def scan(part: int) -> DataFrame:
        mine = windows.where(F.pmod(F.xxhash64("win"), F.lit(parts)) == part)
        held = spark.sparkContext.broadcast({r["win"].encode(): r["items"] for r in mine.toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            at = WindowSet(held.value)
            for b in batches:
                out = {"doc_id": b["doc_id"], "n_words": [], "spans": [], "items": []}
                if parts > 1:
                    out["row"] = b["row"]
                for t in b["text"]:
                    words = words_of(t.as_py())
                    spans, items = at.scan(words)
                    out["n_words"].append(len(words))
                    out["spans"].append(joined(spans))
                    out["items"].append(sorted(items))
                yield out

        return map_stream(given, run, schema)

    if parts == 1:
        return scan(0)
    every = scan(0)
    for k in range(1, parts):
        every = every.unionAll(scan(k))
    flat = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    return _rejoined(flat).drop("row")


def joined(spans: list) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one, in order."""
    out: list[list[int]] = []
    for a, e in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return out


def _rejoined(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out = {n: b[n] for n in ("row", "doc_id", "n_words", "items")}
            yield out | {"spans": [joined(x) for x in b["spans"].to_pylist()]}

    return map_stream(rows, run, "row long, doc_id long, n_words long, spans array<array<int>>, items array<string>")


def report(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document row.

    n_hit counts the words inside any occurrence of a window of ``size`` words (of a shorter item: all its words).
    Null and empty texts have no words; items without words never hit; repeated rows and repeated items keep their
    rows and count once as items; empty tables give no rows or no hits; other columns are not read.
    """
    s = scanned(docs, items, size)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    return s.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def without_spans(docs: DataFrame, items: DataFrame, size: int = WINDOW, most_hit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents with the words of benchmark passages cut out; one with more than ``most_hit`` of its words hit goes.

    All columns and their order are kept; clean rows are unchanged. A cut reaches from the first hit word's first
    byte to the last one's end. Null and empty texts stay.
    """
    spark = docs.sparkSession
    windows = staged(item_windows(items, size).groupBy("win").agg(F.collect_set("item_id").alias("items")), "windows")
    out, parts, mark = docs, max(1, -(-windows.count() // MOST_WINDOWS)), "_decontaminate_cut"
    for part in range(parts):
        mine = windows.where(F.pmod(F.xxhash64("win"), F.lit(parts)) == part)
        held = spark.sparkContext.broadcast({r["win"].encode(): r["items"] for r in mine.toLocalIterator()})

        @F.pandas_udf("struct<kept:boolean,text:string>")
        def cut(texts):
            import pandas as pd

            at, rows = WindowSet(held.value), []
            for t in texts:
                rows.append(_cut(t, at, most_hit))
            return pd.DataFrame(rows, columns=["kept", "text"])

        out = out.withColumn(mark, cut.asNondeterministic()(F.col(text_col)))  # so that it is not computed again for the filter
        out = out.where(F.col(mark)["kept"]).withColumn(text_col, F.col(mark)["text"]).select(*docs.columns)
    return out


def _cut(text: str | None, at: WindowSet, most_hit: float) -> tuple[bool, str | None]:
    words = words_of(text)
    spans = joined(at.scan(words)[0])
    hit = sum(e - a for a, e in spans)
    if not spans:
        return True, text
    if hit > most_hit * len(words):
        return False, None
    raw = text.encode("utf-8", "replace")
    clean, where, pos = raw.translate(_KEPT), [], 0
    for w in words:
        pos = clean.index(w, pos)
        where.append((pos, pos + len(w)))
        pos += len(w)
    out, done = [], 0
    for a, e in spans:
        out.append(raw[done : where[a][0]])
        done = where[e - 1][1]
    return True, b"".join([*out, raw[done:]]).decode("utf-8", "replace")
