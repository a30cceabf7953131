"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore.

An index is one Parquet table. Each shard (a stretch of the input of about ``SHARD_BYTES`` of text) has a row for every
term in it and one, with a null term, for its documents with at least one term, in ascending id order. A term's postings are cut into blocks of
``BLOCK``: gaps between documents and occurrences less one, each packed into 0, 1, 2 or 4 bytes. Beside them stands for each block its
last document, its most occurrences and its shortest document, which bound every score in it without unpacking.

A search reads the lists of its terms only, shard by shard. Lists are ordered by their greatest score. Those at the lower end whose bounds
together do not exceed the score of the k-th best document so far are non-essential: no document can enter by them
alone. Candidates come from the other, essential lists, a window of documents at a time; on each non-essential list a
candidate is dropped by the list bounds, then by the bound of its block, and only blocks that still have candidates are unpacked.
A few documents of one shard give the first thresholds to all. The heaps of the shards are merged by one top-k.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.pandas.types import to_arrow_schema

from tallyfold.llm.common import map_stream, staged
from tallyfold.session import scratch_path

BLOCK = 128  # postings
SHARD_BYTES = 48 << 20  # text of a shard
MOST_PAIRS = 1_000_000  # (item, term) pairs that are searched at once; more items are searched in blocks
WINDOWS = (256, 1024, 4096)  # documents looked at together: the first ones, the next, then always the last
HELD = 1 << 22  # unpacked postings that a task keeps
PERCENT, HALF = 100, 50  # fixed values of the score: a document's length counts half
_KEPT = bytes(b if b >= 0x80 or chr(b).isalnum() else ord(" ") for b in range(128)).lower() + bytes(range(128, 256))
_BLOCKS = np.dtype([("last", "<u4"), ("tf", "<u4"), ("n", "<u4"), ("at", "<u4"), ("gap", "u1"), ("more", "u1")])
INDEX = "shard long, term string, n int, total long, blocks binary, payload binary"


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and anything outside ASCII in UTF-8, A-Z lower-cased; a null text has none."""
    return (text or "").encode("utf-8", "replace").translate(_KEPT).split()


# --- scores ---


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return PERCENT - HALF + (HALF * np.asarray(n, np.int64) * n_docs) // n_terms


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What an occurrence count is worth in a document; it rises with the count and falls with the length."""
    tf = np.asarray(tf, np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * norm)


# --- index ---


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most == 0, 0, np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))).astype(np.int64)


def _scatter(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    """Put little-endian values of their widths at their byte positions."""
    for k in range(4):
        some = width > k
        out[at[some] + k] = values[some] >> (8 * k) & 255


def packed(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings sorted by (term, doc) -> (payload bytes, its end for each term, blocks, their end for each term)."""
    first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    df = np.diff(np.concatenate((first, [len(term)])))
    gap = doc - np.concatenate(([-1], doc[:-1])) - 1
    gap[first] = doc[first]
    n_blocks = -(-df // BLOCK)
    ends = np.cumsum(n_blocks)
    of_term = np.repeat(np.arange(len(df)), n_blocks)
    start = first[of_term] + BLOCK * (np.arange(ends[-1]) - (ends - n_blocks)[of_term])
    size = np.diff(np.concatenate((start, [len(term)])))
    blocks = np.zeros(len(start), _BLOCKS)
    blocks["last"] = doc[start + size - 1]
    blocks["tf"] = np.maximum.reduceat(tf, start)
    blocks["n"] = np.minimum.reduceat(lengths[doc], start)
    wide, more = _width(np.maximum.reduceat(gap, start)), _width(blocks["tf"].astype(np.int64) - 1)
    blocks["gap"], blocks["more"] = wide, more
    stop = np.cumsum(size * (wide + more))
    begin = stop - size * (wide + more)
    blocks["at"] = begin - begin[(ends - n_blocks)[of_term]]
    payload = np.zeros(stop[-1], np.uint8)
    of_block = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(term)) - start[of_block]
    _scatter(payload, begin[of_block] + place * wide[of_block], gap, wide[of_block])
    _scatter(payload, (begin + size * wide)[of_block] + place * more[of_block], tf - 1, more[of_block])
    return payload, stop[ends - 1], blocks, ends


def unpacked(block: np.void, size: int, before: int, payload: memoryview | bytes) -> tuple[np.ndarray, np.ndarray]:
    """(documents, occurrences) of one block; ``before`` is the last document of the block before it, or -1."""
    wide, more, at = int(block["gap"]), int(block["more"]), int(block["at"])
    gap = np.frombuffer(payload, f"<u{wide}", size, at).astype(np.int64) if wide else np.zeros(size, np.int64)
    tf = np.frombuffer(payload, f"<u{more}", size, at + size * wide).astype(np.int64) + 1 if more else np.ones(size, np.int64)
    return np.cumsum(gap + 1) + before, tf


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], ends)).astype("<i4")
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


class _Shard:
    """Documents gathered until a shard is full."""

    def __init__(self) -> None:
        self.numbers, self.ids, self.docs, self.size = defaultdict(count().__next__), [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        self.ids.append(doc_id)
        self.docs.append(np.fromiter(map(self.numbers.__getitem__, terms_of(text)), np.int32))
        self.size += len(text or "") + 64

    def rows(self, shard: int) -> Iterator[dict]:
        order = sorted((i for i in range(len(self.ids)) if len(self.docs[i])), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        docs = [self.docs[i] for i in order]
        lengths = np.array([len(d) for d in docs], np.int64)
        known = np.array([self.ids[i] is not None for i in order], np.uint8)
        ids = np.array([self.ids[i] or 0 for i in order], "<i8")
        yield {"shard": [shard], "term": [None], "n": [len(ids)], "total": [int(lengths.sum())], "blocks": [lengths.astype("<i4").tobytes() + known.tobytes()], "payload": [ids.tobytes()]}
        if not order:
            return
        pair = np.sort(np.concatenate(docs).astype(np.int64) << 32 | np.repeat(np.arange(len(docs)), lengths))
        at = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        tf = np.diff(np.concatenate((at, [len(pair)])))
        term, doc = pair[at] >> 32, pair[at] & 0xFFFFFFFF
        payload, ends, blocks, block_ends = packed(term, doc, tf, lengths)
        df, names = np.bincount(term), [t.decode() for t in self.numbers]  # numbered as they came
        first = np.cumsum(df) - df
        step = 1 << 15
        for a in range(0, len(df), step):
            e = min(len(df), a + step)
            p0, b0 = (ends[a - 1], block_ends[a - 1]) if a else (0, 0)
            yield {
                "shard": np.full(e - a, shard), "term": names[a:e], "n": df[a:e].astype(np.int32), "total": np.add.reduceat(tf, first[a:e]) if e == len(df) else np.add.reduceat(tf[: first[e]], first[a:e]),
                "blocks": _binary(blocks[b0 : block_ends[e - 1]], (block_ends[a:e] - b0) * _BLOCKS.itemsize), "payload": _binary(payload[p0 : ends[e - 1]], ends[a:e] - p0),
            }


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of every row of ``docs`` below ``path``; nothing is shuffled, and a task holds one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        base, n, shard = TaskContext.get().partitionId() << 24, 0, _Shard()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                shard.add(doc_id, text.as_py())
                if shard.size >= SHARD_BYTES:
                    yield from shard.rows(base + n)
                    n, shard = n + 1, _Shard()
        if shard.ids:
            yield from shard.rows(base + n)

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    map_stream(given, run, INDEX).write.parquet(path)


# --- search ---


class _List:
    """One term's postings in a shard, with the bounds of its scores."""

    def __init__(self, n: int, blocks: bytes, payload: bytes, weight: int, norm_of) -> None:
        self.blocks, self.payload, self.n, self.weight = np.frombuffer(blocks, _BLOCKS), payload, n, weight
        self.last = self.blocks["last"].astype(np.int64)
        self.bound = weight * impact(self.blocks["tf"], norm_of(self.blocks["n"].astype(np.int64)))
        self.most = int(self.bound.max())
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class ShardSearch:
    """The lists of one shard, for one query after the other."""

    def __init__(self, lists: dict[str, tuple[int, bytes, bytes]], lengths: np.ndarray, weights: dict[str, int], n_docs: int, n_terms: int) -> None:
        self.norm = length_norm(lengths, n_docs, n_terms)
        norm_of = lambda n: length_norm(n, n_docs, n_terms)
        self.lists = {t: _List(*x, weights[t], norm_of) for t, x in lists.items()}
        self.unpacked, self.in_use = 0, 0

    def block(self, x: _List, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of a list's block."""
        got = x.held.get(i)
        if got is None:
            if self.in_use > HELD:
                for y in self.lists.values():
                    y.held.clear()
                self.in_use = 0
            size = min(BLOCK, x.n - i * BLOCK)
            docs, tf = unpacked(x.blocks[i], size, int(x.last[i - 1]) if i else -1, x.payload)
            got = x.held[i] = docs, x.weight * impact(tf, self.norm[docs])
            self.in_use += size
            self.unpacked += 1
        return got

    def blocks(self, x: _List, numbers: range | list[int]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.block(x, i) for i in numbers]
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(p) for p in zip(*parts))

    def best(self, terms: list[str], k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best with a score above ``floor``, best first, the earlier document on ties."""
        lists = sorted((self.lists[t] for t in terms if t in self.lists), key=lambda x: x.most)
        sums = np.cumsum([x.most for x in lists])
        docs, scores, threshold, lo, turn = np.zeros(0, np.int64), np.zeros(0, np.int64), floor, 0, 0
        while lo < len(self.norm):
            essential = int(np.searchsorted(sums, threshold, "right"))  # lists from here on
            if essential == len(lists):
                break
            hi = min(len(self.norm), lo + WINDOWS[min(turn, len(WINDOWS) - 1)])
            got = self._window(lists, sums, essential, lo, hi, threshold)
            if len(got[0]):
                docs, scores = np.concatenate((docs, got[0])), np.concatenate((scores, got[1]))
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
                if len(docs) == k:
                    threshold = max(floor, int(scores[-1]))  # a later document must exceed it
            lo, turn = hi, turn + 1
        return docs, scores

    def _window(self, lists: list[_List], sums: np.ndarray, essential: int, lo: int, hi: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros(hi - lo, np.int64)
        for x in lists[essential:]:
            a = int(np.searchsorted(x.last, lo))
            if a == len(x.last):
                continue
            e = min(len(x.last), int(np.searchsorted(x.last, hi - 1)) + 1)
            docs, scores = self.blocks(x, range(a, e))
            i, j = np.searchsorted(docs, (lo, hi))
            total[docs[i:j] - lo] += scores[i:j]
        found = np.flatnonzero(total)
        score = total[found]
        found = found + lo
        for i in range(essential - 1, -1, -1):
            x, rest = lists[i], int(sums[i - 1]) if i else 0
            alive = score + int(sums[i]) > threshold
            found, score = found[alive], score[alive]
            if not len(found):
                break
            at = np.searchsorted(x.last, found)
            inside = at < len(x.last)
            bound = np.where(inside, x.bound[np.minimum(at, len(x.last) - 1)], 0)
            alive = score + bound + rest > threshold  # rejected by the block's bound, before it is unpacked
            found, score, at = found[alive], score[alive], at[alive][inside[alive]]
            if len(at):
                docs, scores = self.blocks(x, np.unique(at).tolist())
                place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                score = score + np.where(docs[place] == found, scores[place], 0)
        alive = score > threshold
        return found[alive], score[alive]


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term) without repeats."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = [(i, t.decode()) for i, text in enumerate(b.column(1).to_pylist()) for t in set(terms_of(text))]
            yield {"item": b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), "term": [r[1] for r in rows]}

    return map_stream(items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")), run, f"item {kind}, term string").distinct()


def search(spark: SparkSession, path: str, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of an index for every item, scores above 0 only.

    Ranks begin at 1; equal scores are ordered by ascending doc_id, null ids last. Items with one id (null is one too) are one item; items without
    terms, or none that occur, have no rows; repeated documents are ranked each. Items are searched in blocks of
    ``MOST_PAIRS`` pairs of an item and a term, so what is sent to the tasks is bounded.
    """
    kind = items.schema[id_col].dataType
    index = spark.read.schema(INDEX).parquet(path)
    pairs = staged(_item_terms(items, id_col, text_col), "search-terms")
    parts = max(1, -(-pairs.count() // MOST_PAIRS))
    t = index.where("term is null").agg(F.sum("n").alias("docs"), F.sum("total").alias("terms")).first()
    n_docs, n_terms = int(t["docs"] or 0), int(t["terms"] or 0)
    schema = StructType([StructField("item_id", kind), *StructType.fromDDL("doc_id long, score long")])
    if not n_terms:
        return spark.createDataFrame([], schema).select("item_id", F.lit(0).alias("rank"), "doc_id", "score")
    found = None
    for part in range(parts):
        mine = pairs.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        out = _searched(index, mine, n_docs, n_terms, k, schema)
        found = out if found is None else found.unionAll(out)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searched(index: DataFrame, pairs: DataFrame, n_docs: int, n_terms: int, k: int, schema: StructType) -> DataFrame:
    """The heaps of every shard for one block of items, not merged."""
    spark = index.sparkSession
    lists = staged(index.join(F.broadcast(pairs.select("term").distinct()), "term", "left_semi").select("shard", "term", "n", "blocks", "payload"), "search-lists")
    weights = {r["term"]: term_weight(n_docs, r["df"]) for r in lists.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    by_item: dict = defaultdict(list)
    for r in pairs.collect():
        if r["term"] in weights:
            by_item[r["item"]].append(r["term"])
    known = spark.sparkContext.broadcast((weights, [(i, sorted(ts)) for i, ts in by_item.items()]))
    target = to_arrow_schema(schema)
    every = lists.unionByName(index.where("term is null").select(*lists.columns))

    def heaps(rows: DataFrame, floors) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            weights_, items_ = known.value
            lists_, ids, known_ids, lengths = {}, None, None, None
            for term, n, blocks, payload in zip(*(table[c].to_pylist() for c in ("term", "n", "blocks", "payload"))):
                if term is None:
                    ids, lengths, known_ids = np.frombuffer(payload, "<i8"), np.frombuffer(blocks, "<i4", n), np.frombuffer(blocks, np.uint8, n, 4 * n)
                else:
                    lists_[term] = n, blocks, payload
            at = ShardSearch(lists_, lengths, weights_, n_docs, n_terms)
            item, doc, mask, score = [], [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
            for key, terms in items_:
                docs, scores = at.best(terms, k, max(0, floors.value.get(key, 0) - 1) if floors else 0)
                item += [key] * len(docs)
                doc.append(ids[docs])
                mask.append(known_ids[docs] == 0)
                score.append(scores)
            ids_out = pa.array(np.concatenate(doc), pa.int64(), mask=np.concatenate(mask))
            return pa.Table.from_arrays([pa.array(item, target.field(0).type), ids_out, pa.array(np.concatenate(score))], schema=target)

        return rows.groupBy("shard").applyInArrow(run, schema)

    one = every.join(F.broadcast(index.where("term is null").agg(F.min("shard").alias("shard"))), "shard", "left_semi")
    first = heaps(one, None).groupBy("item_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    floors = spark.sparkContext.broadcast({r["item_id"]: r["least"] for r in first.collect()})  # k documents of one shard already reach it
    return heaps(every, floors)


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, path: str | None = None) -> DataFrame:
    """Index ``docs`` and search it for ``items``: see ``search``. An empty table of either gives no rows; null and empty texts never
    match and count nowhere; other columns are not read."""
    path = path or scratch_path(docs.sparkSession, "search-index")
    build_index(docs, path)
    return search(docs.sparkSession, path, items, k)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d WHERE len(words) > 0),
p AS (SELECT row, doc_id, len(words) AS n, unnest(words) AS term FROM d),
t AS (SELECT row, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT q.item_id, q.term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM q JOIN f USING (term), s),
r AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM w JOIN t USING (term), s GROUP BY item_id, row, doc_id),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""
