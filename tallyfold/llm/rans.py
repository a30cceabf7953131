"""Token stores: tokenised documents written as rANS-coded blocks in document order, and read back.

A store is a folder with two Parquet tables. ``table`` holds the frequency of every token, shared by all blocks;
``blocks`` one row for each independent block: the file part it belongs to, its number and first token there, the
documents in it with their lengths, and ``payload``, laid out little-endian as

    magic "rAN1" | lanes u32 | tokens u64 | words u64 | segments u32
    per segment (checkpoint): first word u64, crc32 of its tokens u32, the lanes' states u64 each
    words u32 each | crc32 of all that u32

Token i of a block belongs to lane i mod lanes. All lanes share one word stream, so a block decodes step by step
for all lanes at once, and any segment decodes alone from its checkpoint.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyfold.llm.common import map_stream, staged
from tallyfold.session import scratch_path

BITS = 20  # frequencies add up to 2 ** BITS
LOW = np.uint64(1 << 31)  # states stay in [2 ** 31, 2 ** 63)
LANES = 2048
SEGMENT = 1 << 17  # tokens between checkpoints, a multiple of LANES
BLOCK = 1 << 19  # tokens after which a block ends with the document at hand
HEAD, MAGIC = struct.Struct("<4sIQQI"), b"rAN1"
MOST_IDS = 1 << 16  # tokens of a vocabulary, which bounds the shared table; a larger vocabulary is refused
KEPT = 600_000  # words whose ids a worker remembers, twice: what the older half holds comes over when it is met
# fixed values: the tokenizer's word pattern, with its classes of letters and numbers as far as Latin-1 goes
LETTER, NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+").findall
PLAIN = bytes(b for b in range(256) if 0x09 <= b <= 0x0D or 0x20 <= b <= 0x7E or b > 0xA0)  # no control characters


# --- coding ---


def quantised(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies in proportion to the counts that add up to 2 ** bits; every token that occurs gets one at least."""
    total, goal = int(counts.sum()), 1 << bits
    if total == 0:
        return np.zeros(len(counts), np.int64)
    f = np.where(counts > 0, np.maximum(1, np.array(counts, dtype=object) * goal // total), 0).astype(np.int64)
    off = goal - int(f.sum())
    for i in np.argsort(-f, kind="stable"):
        step = max(off, 1 - int(f[i]))  # what is missing goes to the most frequent token, what is over is taken from the next ones
        f[i] += step
        off -= step
        if off == 0:
            return f
    raise ValueError("more tokens than the frequencies can tell apart")


class Coder:
    """Encoder and decoder of blocks under one frequency table."""

    def __init__(self, frequencies: np.ndarray, bits: int = BITS) -> None:
        f = frequencies.astype(np.uint64)
        self.f, self.low, self.bits = f, np.cumsum(f) - f, np.uint64(bits)
        self.most = f << np.uint64(31 - bits + 32)
        self.of_slot = np.repeat(np.arange(len(f), dtype=np.uint32), frequencies.astype(np.int64))

    def encode(self, ids: np.ndarray, lanes: int = LANES, segment: int = SEGMENT) -> bytes:
        if len(ids) and not (self.f[ids] > 0).all():
            raise ValueError("a token without frequency")
        x, chunks, written, marks = np.full(lanes, LOW, np.uint64), [], 0, {}
        for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes) if len(ids) else ():
            s = ids[at : at + lanes]
            f, y = self.f[s], x[: len(s)]
            over = y >= self.most[s]
            if over.any():
                out = y[over]
                chunks.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
                written += len(out)
                y[over] = out >> np.uint64(32)
            q, r = np.divmod(y, f)
            y[:] = (q << self.bits) + r + self.low[s]
            if at % segment == 0:
                marks[at // segment] = (written, x.astype("<u8").tobytes())
        words = b"".join(c.tobytes() for c in reversed(chunks))
        parts = [HEAD.pack(MAGIC, lanes, len(ids), written, len(marks))]
        for k in sorted(marks):
            parts.append(struct.pack("<QI", written - marks[k][0], zlib.crc32(ids[k * segment : (k + 1) * segment].astype("<u4").tobytes())) + marks[k][1])
        body = b"".join((*parts, words))
        return body + struct.pack("<I", zlib.crc32(body))

    def decode(self, payload: bytes, segment: int | None = None, size: int = SEGMENT) -> np.ndarray:
        """All tokens of a block, or those of one segment."""
        body = memoryview(payload)[:-4]
        if zlib.crc32(body) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("a block's checksum differs")
        magic, lanes, n, n_words, segments = HEAD.unpack_from(body)
        if magic != MAGIC:
            raise ValueError("not a block")
        step = 12 + 8 * lanes
        words = np.frombuffer(body, "<u4", n_words, HEAD.size + segments * step)
        out = []
        for k in range(segments) if segment is None else (segment,):
            pos, check = struct.unpack_from("<QI", body, HEAD.size + k * step)
            x = np.frombuffer(body, "<u8", lanes, HEAD.size + k * step + 12).copy()
            ids = np.empty(min(size, n - k * size), np.uint32)
            for at in range(0, len(ids), lanes):
                y = x[: min(lanes, len(ids) - at)]
                slot = y & np.uint64((1 << int(self.bits)) - 1)
                s = self.of_slot[slot]
                ids[at : at + lanes] = s
                y[:] = self.f[s] * (y >> self.bits) + slot - self.low[s]
                dry = y < LOW
                m = int(np.count_nonzero(dry))
                if m:
                    y[dry] = y[dry] << np.uint64(32) | words[pos : pos + m]
                    pos += m
            if zlib.crc32(ids.astype("<u4").tobytes()) != check:
                raise ValueError("a segment's checksum differs")
            out.append(ids)
        return np.concatenate(out) if out else np.empty(0, np.uint32)


# --- tokens ---


class WordEncoder:
    """Ids of whole texts by a lower-casing tokenizer that drops white space and marks the ends of words.

    No token of such a tokenizer reaches beyond a match of its word pattern, so a text's ids are those of its words, in order. Words
    are remembered; new ones go to the library joined by spaces, and their ids are told apart by the tokens that end a word.
    Texts with anything out of the ordinary (beyond Latin-1, control characters, a special token's brackets) go to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(MOST_IDS, bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 16-bit ids."""
        split = [self._words(t or "") for t in texts]
        if len(self.words) > KEPT:
            self.older, self.words = self.words, {}
        words, older = self.words, self.older
        new = set(filterfalse(words.__contains__, chain.from_iterable(ws for ws in split if ws is not None)))
        for w in filter(older.__contains__, new):
            words[w] = older[w]
        self._learn(list(filterfalse(older.__contains__, new)))
        return [b"".join(map(words.__getitem__, ws)) if ws is not None else self._whole(t) for ws, t in zip(split, texts)]

    def _words(self, text: str) -> list[str] | None:
        try:
            odd = text.encode("latin-1").translate(None, PLAIN)
        except UnicodeEncodeError:
            return None
        return None if odd or "<|" in text else WORDS(text.lower())

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn(self, missing: list[str]) -> None:
        groups = [missing[i : i + 256] for i in range(0, len(missing), 256)]
        for at in range(0, len(groups), 16):
            got = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups[at : at + 16]], add_special_tokens=False)
            for group, e in zip(groups[at : at + 16], got):
                ids = np.array(e.ids, "<u2")
                cut = (2 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(cut) != len(group):
                    raise ValueError("the tokenizer cuts words in another way")
                raw = ids.tobytes()
                self.words.update(zip(group, (raw[a:b] for a, b in zip([0, *cut], cut))))


_ENCODERS: dict[str, WordEncoder] = {}  # a worker's, kept from task to task


TOKENS = "doc_id long, ids binary, counts binary"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, counts): every whole text as little-endian 16-bit ids with the end id behind; a null text is empty.

    Each task adds one row without ids: its number of occurrences of every token, 64-bit, in ``counts``, which is null elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = WordEncoder(tokenizer)
        end, total = np.array([end_id], "<u2").tobytes(), np.zeros(MOST_IDS, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ids = [x + end for x in _ENCODERS[tokenizer].encode(part.column(1).to_pylist())]
                total += np.bincount(np.frombuffer(b"".join(ids), "<u2"), minlength=MOST_IDS)
                yield {"doc_id": part.column(0), "ids": ids, "counts": [None] * len(ids)}
        yield {"doc_id": [None], "ids": [None], "counts": [total.astype("<i8").tobytes()]}

    return map_stream(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, TOKENS)


# --- the store ---


def token_counts(tokens: DataFrame) -> DataFrame:
    """(token, n): occurrences over all documents, from the counts that each task left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(MOST_IDS, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                total += np.frombuffer(raw, "<i8")
        used = np.flatnonzero(total)
        yield {"token": used.astype(np.int32), "n": total[used]}

    return map_stream(tokens.where("counts IS NOT NULL").select("counts"), run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


BLOCKS = "part int, block int, part_start long, n_tokens long, doc_ids array<long>, lengths array<int>, payload binary"


def write_store(tokens: DataFrame, path: str) -> None:
    """Write ``tokenised`` documents as a token store, documents in ascending order over its parts (null ids first, ties by their tokens).

    Only the frequency table (one row for each of at most 65,536 tokens) passes through the driver. Blocks are made
    while the sorted documents stream by, so memory holds one block and its longest document.
    """
    counts = np.zeros(MOST_IDS, np.int64)
    for r in token_counts(tokens).collect():
        counts[r["token"]] = r["n"]
    spark, frequencies = tokens.sparkSession, quantised(counts)
    spark.createDataFrame(
        [(int(t), int(counts[t]), int(frequencies[t])) for t in np.flatnonzero(counts)], "token int, n long, frequency long"
    ).coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder, part, block, start = Coder(shared.value), TaskContext.get().partitionId(), 0, 0
        doc_ids, held, size = [], [], 0

        def closed() -> dict:
            ids = np.frombuffer(b"".join(held), "<u2")
            return {
                "part": [part], "block": [block], "part_start": [start], "n_tokens": [len(ids)], "doc_ids": [doc_ids],
                "lengths": [[len(x) // 2 for x in held]], "payload": [coder.encode(ids)],
            }

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids) // 2
                if size >= BLOCK:
                    yield closed()
                    block, start, doc_ids, held, size = block + 1, start + size, [], [], 0
        if held:
            yield closed()

    ordered = tokens.where("counts IS NULL").select("doc_id", "ids").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    map_stream(ordered, run, BLOCKS).write.parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): every document of a store with the number of ids before it, ids little-endian 32-bit."""
    frequencies = np.zeros(MOST_IDS, np.int64)
    for r in spark.read.schema("token int, frequency long").parquet(f"{path}/table").collect():
        frequencies[r["token"]] = r["frequency"]
    shared = spark.sparkContext.broadcast(frequencies)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each task that wrote; payloads are not read
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder = Coder(shared.value)
        for b in batches:
            for at, doc_ids, lengths, payload in zip(*(b.column(i).to_pylist() for i in range(4))):
                ids = coder.decode(payload).astype("<u4")
                ends = np.cumsum(lengths)
                yield {"doc_id": doc_ids, "start": at + ends - lengths, "ids": [ids[e - n : e].tobytes() for e, n in zip(ends, lengths)]}

    placed = blocks.join(F.broadcast(offsets), "part").select((F.col("part_offset") + F.col("part_start")).alias("at"), "doc_ids", "lengths", "payload")
    return map_stream(placed, run, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Tokenise documents, write them as a token store and read the store: (doc_id, start, ids).

    Every row of ``docs`` is one document: repeated rows and equal ids stay, a null or empty text is the end id alone,
    an empty table is an empty store and gives no rows. Other columns are not read.
    """
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_store(staged(tokenised(docs, tokenizer, end_id), "token-ids"), path)
    return read_store(docs.sparkSession, path)
