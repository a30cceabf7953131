"""Near duplicates by SimHash fingerprints, matched through the binary Golay code.

Matching. The 64 bits of a fingerprint are three segments (22, 21, 21 bits), each read as a word of the perfect
[23, 12, 7] Golay code. A word's keys are the indices of all codewords within distance 4: one if the nearest is
at distance 2 or less, else six. Two words that differ in at most 2 bits always share a key, because the nearest
codeword of a word halfway between them lies within 4 of both. At most 4 differing bits over three segments
leave two cases, which give the two kinds of composite keys:

* some segment is equal: then one of the other two differs by 2 bits at most (equal segment, its index);
* none is equal: then each differs by 2 at most, and one of the third's three parts of 7 bits is equal (the indices of
  the first two segments, that part).

So every link shares a composite key of 31 bits or more, and what shares a key is verified by counting bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyfold.llm.common import map_batches, map_stream, staged
from tallyfold.llm.components import components

SHINGLE = 4
LIMIT = 4  # differing bits of a link
BLOCK = 4096  # fingerprints of one key that are compared in one task
GENERATOR = 0b110001110101  # fixed value: a generator polynomial of the Golay code
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits


# --- fingerprints ---


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of a text's word shingles (see ``fingerprints``) as an unsigned number."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # on bytes, both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - ends[0] if len(words) == 1 else np.concatenate(([0], ends[:-1]))
    if len(words) > size:
        first, last = starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist()
    else:
        first, last = [0], [len(joined)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(first), 1 << 16):
        part = first[i : i + (1 << 16)]
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(part, last[i : i + (1 << 16)])), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """(doc_id, fp) with fp the 64-bit SimHash as a signed long.

    A-Z are lower-cased, words are what stands between ASCII white space, shingles are 4 words (all words of a
    shorter text), repeats count. A bit is set if more than half the shingles' hashes have it. A null, empty or
    blank text has fingerprint zero. With ``with_hash`` text_hash, a 64-bit hash of the text as it is, is added.
    """

    def run(b: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t) for t in b["text"].to_pylist()], np.uint64)
        return {n: b[n] for n in b.schema.names} | {"fp": fps.view(np.int64)}

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    more = ""
    if with_hash:
        given, more = given.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))), ", text_hash long"
    return map_batches(given, run, f"doc_id long, fp long{more}")


# --- Golay keys ---


def _remainder(words: np.ndarray) -> np.ndarray:
    """The syndrome: 23-bit words modulo the generator."""
    r = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        r ^= np.where(r >> bit & 1, np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
    return r


def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2,048 syndromes the error words of weight 4 or less that have it, and how many those are (1 or 6)."""
    table, count = np.zeros((2048, 6), np.uint32), np.zeros(2048, np.int64)
    for weight in range(5):
        masks = np.array([sum(1 << i for i in bits) for bits in combinations(range(23), weight)], np.uint32)
        for mask, s in zip(masks, _remainder(masks)):
            table[s, count[s]] = mask
            count[s] += 1
    return table, count


class GolayKeys:
    """Composite keys of fingerprints, built once per task."""

    def __init__(self) -> None:
        self.table, self.count = error_patterns()

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Six columns of codeword indices within distance 4 of each word, and how many of them are in use."""
        s = _remainder(words)
        near = (words.astype(np.uint32)[:, None] ^ self.table[s]) >> 11
        return near.astype(np.int64), self.count[s]

    def keys(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``fps``, key) for every key of every fingerprint."""
        seg = [(fps >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
        idx = [self.indices(x) for x in seg]
        rows, out = [], []
        slot = np.arange(6)
        used = [slot[None, :] < n[:, None] for _, n in idx]
        for kind, (x, y) in enumerate((x, y) for x in range(3) for y in range(3) if x != y):
            r, c = np.nonzero(used[y])
            rows.append(r)
            out.append((kind << 40) | (seg[x][r] << 12) | idx[y][0][r, c])
        r, i, j = np.nonzero(used[0][:, :, None] & used[1][:, None, :])
        for part in range(3):
            rows.append(r)
            out.append((6 + part << 40) | (idx[0][0][r, i] << 24) | (idx[1][0][r, j] << 12) | (seg[2] >> 7 * part & 127)[r])
        return np.concatenate(rows), np.concatenate(out)


def keyed(fps: DataFrame) -> DataFrame:
    """(key, fp) for every fingerprint in column ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        golay = GolayKeys()
        for b in batches:
            words = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(words), 1024):
                part = words[i : i + 1024]
                r, keys = golay.keys(part.view(np.uint64))
                yield {"key": keys, "fp": part[r]}

    return map_stream(fps.select("fp"), run, "key long, fp long")


# --- links ---


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; the bits of a signed number would be those of its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fps: np.ndarray, limit: int = LIMIT) -> list[tuple[int, int]]:
    """Links that connect whatever is connected among these fingerprints, no more than one less than there are."""
    left, out = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = bits_apart(left, at) <= limit
            found = left[near]
            out += [(int(at), int(x)) for x in found]
            queue += list(found)
            left = left[~near]
    return out


def _link_runs(batches: Iterator[pa.RecordBatch], limit: int = LIMIT) -> Iterator[dict]:
    """Rows sorted by (key, fp) -> links inside each key's block, and the members of keys that need several blocks."""

    def linked(keys: np.ndarray, fps: np.ndarray) -> dict:
        edge = np.flatnonzero(np.diff(keys)) + 1
        first, last = np.concatenate(([0], edge)), np.concatenate((edge, [len(keys)]))
        size = last - first
        two = first[size == 2]
        close = bits_apart(fps[two], fps[two + 1]) <= limit
        a, b = list(fps[two[close]]), list(fps[two[close] + 1])
        for i in np.flatnonzero(size > 2):
            pairs = forest(fps[first[i] : last[i]], limit)
            a += [p[0] for p in pairs]
            b += [p[1] for p in pairs]
        pairs = np.unique(np.array([a, b], np.int64), axis=1) if a else np.zeros((2, 0), np.int64)
        return {"a": pairs[0], "b": pairs[1], "block": np.full(pairs.shape[1], -1, np.int32)}

    key, held, block = None, np.zeros(0, np.int64), 0  # the run that is still open

    def members() -> dict:
        return {"a": np.full(len(held), key, np.int64), "b": held, "block": np.full(len(held), block, np.int32)}

    for b in batches:
        keys, fps = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        while len(keys):
            if key is not None and keys[0] == key:  # go on with the open run
                run = int(np.searchsorted(keys, key, "right"))
                take = min(run, BLOCK - len(held))
                held, keys, fps = np.concatenate((held, fps[:take])), keys[take:], fps[take:]
                if len(held) == BLOCK:
                    yield members()
                    yield linked(np.full(BLOCK, key), held)
                    held, block = held[:0], block + 1
                continue
            if key is not None and len(held):
                if block:
                    yield members()
                yield linked(np.full(len(held), key), held)
            whole = int(np.searchsorted(keys, keys[-1]))  # all but the last key end in this batch
            if whole:
                yield linked(keys[:whole], fps[:whole])
            key, held, block = int(keys[-1]), fps[:0], 0
            keys, fps = keys[whole:], fps[whole:]
    if key is not None and len(held):
        if block:
            yield members()
        yield linked(np.full(len(held), key), held)


def _cross_block(group, limit: int = LIMIT):
    import pandas as pd

    pairs = forest(group["fp"].drop_duplicates().to_numpy(), limit)
    return pd.DataFrame({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}, columns=["a", "b"]).astype("int64")


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b) between distinct fingerprints at most ``limit`` bits apart: enough of them to keep all that is connected together.

    All links up to 4 bits are found; of wider ones those that share a key, fewer the wider they are.

    Not every pair is listed: inside a key the links are a spanning forest, so a group of many near copies costs
    one link each. A key with more than ``BLOCK`` fingerprints is cut into blocks, and each pair of blocks is
    compared in its own task.
    """
    found = map_stream(keyed(fps).repartition("key").sortWithinPartitions("key", "fp"), lambda b: _link_runs(b, limit), "a long, b long, block int")
    found = staged(found, "simhash-links")
    wide = found.where("block >= 0").select(F.col("a").alias("key"), F.col("b").alias("fp"), "block")
    blocks = wide.groupBy("key").agg(F.max("block").alias("top"))
    pairs = wide.join(blocks, "key").select(
        "key", "fp", "block", F.explode(F.expr("filter(sequence(0, top), x -> x <> block)")).alias("other")
    )
    cross = pairs.groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).applyInPandas(lambda g: _cross_block(g, limit), "a long, b long")
    return found.where("block < 0").select("a", "b").unionAll(cross).distinct()


# --- the operator ---


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    component_id is the least doc_id that links of 4 bits or fewer reach, the row's own included. Equal
    fingerprints are one node, so copies, ties and repeated rows cost one member each. Rows with a null doc_id
    keep it and take part; they never name a component (null if nothing else is reached). An empty table gives
    no rows. Other columns of ``docs`` are not read.
    """
    prints = staged(fingerprints(docs, id_col, text_col), "simhash")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    roots = components(links(nodes))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    owner = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(owner, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
