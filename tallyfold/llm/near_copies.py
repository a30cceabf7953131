"""Near copies for deduplication: SimHash fingerprints of words found through Golay keys, links verified by five-word shingles.

Fingerprints of five-word shingles at similarity 0.8 are 9 of 64 bits apart in the median, which Golay keys cannot carry. So the
fingerprint here is of the text's different words: the same pairs are then 3 bits apart in the median, and others are far. Three
independent 64-bit fingerprints of each text are matched by the keys of ``simhash``, which prove distances up to 4 bits and find most of those up to
``LIMIT``. What is connected so is a group; a link then needs a Jaccard similarity of ``SIMILARITY`` or more of the five-word shingles of both texts, and every two
members of a group that are not connected yet are compared.

Texts with equal words are one node. A group is compared in one task, or block by block where it has more than ``BLOCK`` nodes: a task
takes one pivot after the other, and what is linked leaves, so a group of copies costs about one comparison and one link a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyfold.llm import simhash
from tallyfold.llm.common import map_batches, map_stream, staged
from tallyfold.llm.components import components, contracted

SHINGLE = 5  # words
SIMILARITY = 0.8
LIMIT = 8  # differing bits of two fingerprints whose texts are compared
BLOCK = 2048  # nodes of a group that are compared in one task, or that number of each of two blocks
PARTS = 3  # fingerprints of a text


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as ``simhash`` has them."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """The distinct hashes of all runs of five words (of all words of a shorter text; none of a blank one)."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first, last = [0, *ends[: n - 1].tolist()], (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 5) for a, b in zip(first, last)), np.uint64, n))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; blank texts are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _digest(word: bytes) -> bytes:
    """192 bits of a word, 64 for each fingerprint."""
    return xxhash.xxh3_128_digest(word) + xxhash.xxh3_64_digest(word, 1)


def fingerprints(words: list[bytes]) -> np.ndarray:
    """The SimHash values of the different words, signed; zeros where there are none."""
    if not words:
        return np.zeros(PARTS, np.int64)
    own = list(set(words))
    ones = np.zeros(64 * PARTS, np.int64)
    for i in range(0, len(own), 1 << 16):
        raw = np.frombuffer(b"".join(map(_digest, own[i : i + (1 << 16)])), np.uint8).reshape(-1, 8 * PARTS)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(own)).view(np.int64)


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, same_a, same_b, fp0, fp1, fp2): texts with the same words have the same two ``same`` hashes."""

    def run(b: pa.RecordBatch) -> dict:
        same, fps = [], []
        for t in b["text"].to_pylist():
            words = words_of(t)
            same.append(xxhash.xxh3_128_digest(b" ".join(words)))
            fps.append(fingerprints(words))
        both, prints = np.frombuffer(b"".join(same), np.int64).reshape(-1, 2), np.array(fps, np.int64).reshape(-1, PARTS)
        return {"doc_id": b["doc_id"], "text_hash": b["text_hash"], "same_a": both[:, 0], "same_b": both[:, 1]} | {f"fp{i}": prints[:, i] for i in range(PARTS)}

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    return map_batches(given, run, "doc_id long, text_hash long, same_a long, same_b long, " + ", ".join(f"fp{i} long" for i in range(PARTS)))


# --- groups ---


def grouped(nodes: DataFrame) -> DataFrame:
    """(node, group) of the nodes that fingerprints connect with another one."""
    found = None
    for i in range(PARTS):
        reps = staged(nodes.groupBy(F.col(f"fp{i}").alias("fp")).agg(F.min("node").alias("rep")), "near-prints")
        of = simhash.links(reps.select("fp"), LIMIT)
        ends = of.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        equal = nodes.join(reps, nodes[f"fp{i}"] == reps["fp"]).select(F.col("node").alias("a"), F.col("rep").alias("b"))
        mine = ends.unionAll(equal.where("a <> b"))
        found = mine if found is None else found.unionAll(mine)
    roots = staged(contracted(found), "near-roots")
    return roots.select("node", F.col("root").alias("group")).unionAll(roots.select(F.col("root").alias("node"), F.col("root").alias("group")).distinct())


def near_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of ``SIMILARITY`` that connect whatever is connected among these sets, at most one less than there are.

    Pivots are compared with all that are left at once.
    """
    out, left = [], np.arange(len(sets))
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    start = np.cumsum(size) - size
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            mine = left[(size[left] >= SIMILARITY * size[at]) & (SIMILARITY * size[left] <= size[at])]
            if not len(mine):
                continue
            n = size[mine]
            where = np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            hit = np.isin(flat[where], sets[at], assume_unique=False)
            both = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64) if n.all() else np.zeros(len(mine), np.int64)
            near = mine[both >= SIMILARITY * (n + size[at] - both)]
            out += [(int(at), int(x)) for x in near]
            queue += list(near)
            left = np.setdiff1d(left, near, assume_unique=True)
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows sorted by (group, i, j) with (node, shingles) -> links; memory holds one comparison, at most two blocks."""
    held, nodes, sets = None, [], []

    def links() -> dict:
        found = near_forest(sets)
        return {"a": [nodes[x] for x, _ in found], "b": [nodes[y] for _, y in found]}

    for b in batches:
        for group, i, j, node, raw in zip(*(b.column(k).to_pylist() for k in range(5))):
            if (group, i, j) != held:
                if len(nodes) > 1:
                    yield links()
                held, nodes, sets = (group, i, j), [], []
            nodes.append(node)
            sets.append(np.frombuffer(raw, np.uint64))
    if len(nodes) > 1:
        yield links()


def linked(members: DataFrame) -> DataFrame:
    """(a, b) from (group, node, text): verified links, a spanning forest of them for each comparison."""

    def run(b: pa.RecordBatch) -> dict:
        return {"group": b["group"], "node": b["node"], "raw": [shingles(words_of(t)).tobytes() for t in b["text"].to_pylist()]}

    sets = staged(map_batches(members.select("group", "node", "text"), run, "group long, node long, raw binary"), "near-shingles", "zstd")
    blocks = sets.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    mine = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    each = sets.join(blocks, "group").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = each.select("group", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "raw")
    return map_stream(pairs.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j"), _compared, "a long, b long")


# --- the operator ---


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component of near copies, the one with the least doc_id (null ids last, ties by the text's hash), with all its columns.

    Rows that repeat both id and text count as one. Null, empty and blank texts are one component; a text under five words
    has itself as its one shingle. An empty table stays empty. Names that begin with ``_near_`` are used inside and must not be columns of ``docs``.
    """
    key, th = "_near_id", "_near_text"
    prints = staged(marked(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "near-prints")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("text_hash").alias("text"))
    nodes = prints.groupBy("same_a", "same_b").agg(F.min("row").alias("node"), F.min(rank).alias("f"), *[F.min(f"fp{i}").alias(f"fp{i}") for i in range(PARTS)])
    nodes = staged(nodes.drop("same_a", "same_b"), "near-nodes")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))

    def same(id_: str, text: str):
        return F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (text_hash == F.col(text))

    groups = staged(grouped(nodes), "near-groups")
    of = nodes.join(groups, "node").select(F.col("node").alias("_near_node"), F.col("group").alias("_near_group"), F.col("f.id").alias(key), F.col("f.text").alias(th))
    members = docs.join(of, same(key, th)).groupBy(F.col("_near_group").alias("group"), F.col("_near_node").alias("node")).agg(F.first(text_col).alias("text"))
    roots = components(staged(linked(members), "near-links"))
    first = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("f").alias("f"))
    kept = staged(first.select(F.col("f.id").alias(key), F.col("f.text").alias(th)), "near-first")
    rows = prints.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_near_rid"), F.col("text_hash").alias("_near_rth"))
    repeated = staged(kept.join(rows, F.col(key).eqNullSafe(F.col("_near_rid")) & (F.col(th) == F.col("_near_rth")), "left_semi"), "near-repeated")
    if not repeated.limit(1).count():
        return docs.join(kept, same(key, th), "left_semi")
    single = kept.join(repeated.select(F.col(key).alias("_near_rid"), F.col(th).alias("_near_rth")), F.col(key).eqNullSafe(F.col("_near_rid")) & (F.col(th) == F.col("_near_rth")), "left_anti")
    copies = docs.join(repeated, same(key, th), "left_semi").groupBy(F.col(id_col).alias(key), text_hash.alias(th))
    return docs.join(single, same(key, th), "left_semi").unionByName(copies.agg(F.first(F.struct(*docs.columns)).alias("d")).select("d.*"))
