"""Sharding by histogram sort: exact counts below candidate boundaries, refined until the splitters fit, then one exchange.

Rows are ordered by (key, row number), so equal keys can be cut anywhere. Every round counts the exact bytes and rows
below a few dozen probes for each splitter in one pass over the small (key, size) table; each task sends one
partial sum for each interval. A splitter is settled when its bytes are within tolerance of the ideal, or when no row
is left between the nearest probes on both sides. Shards larger than ``PIECE_BYTES`` are sorted in several pieces,
so no task gets a whole shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyfold.llm.common import map_stream, staged

TOLERANCE = 0.001  # of a shard's ideal bytes
PROBES = 32  # for each open splitter and round
PIECE_BYTES = 128 << 20
MOST_PIECES = 100_000
_HALF = 1 << 63


def _joint(key: int, row: int) -> int:
    """(key, row) as one number that sorts like the pair."""
    return ((key + _HALF) << 63) | row


def _placed(keys: np.ndarray, rows: np.ndarray, probes: list[int]) -> np.ndarray:
    """How many of the sorted probes are at most (key, row)."""
    high = np.array([(p >> 63) - _HALF for p in probes], np.int64)
    low = np.array([p & (_HALF - 1) for p in probes], np.int64)
    at = np.searchsorted(high, keys, "left")
    tied = at < np.searchsorted(high, keys, "right")
    for h in np.unique(keys[tied]):
        a, e = np.searchsorted(high, h, "left"), np.searchsorted(high, h, "right")
        mine = keys == h
        at[mine] = a + np.searchsorted(low[a:e], rows[mine], "right")
    return at


def below(table: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, rows) of (key, row, size) that sort before each probe; the driver gets a row for each interval."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        size, count = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            keys, rows, sizes = (b[n].to_numpy(zero_copy_only=False) for n in ("key", "row", "size"))
            at = _placed(keys, rows, probes)
            np.add.at(size, at, sizes)
            count += np.bincount(at, minlength=len(count))
        used = np.flatnonzero(count)
        yield {"slot": used, "size": size[used], "rows": count[used]}

    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in map_stream(table.select("key", "row", "size"), run, "slot long, size long, rows long").groupBy("slot").agg(F.sum("size").alias("size"), F.sum("rows").alias("n")).collect():
        size[r["slot"]], rows[r["slot"]] = r["size"], r["n"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(table: DataFrame, pieces: int, tolerance: float = TOLERANCE) -> tuple[list[int], list[int]]:
    """The first (key, row) of every piece but the first, and the rows before it."""
    r = table.agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("size").alias("t"), F.count("*").alias("n")).first()
    if not r["n"] or pieces == 1:
        return [], []
    total, slack = r["t"], max(1, int(tolerance * r["t"] / pieces))
    ends = (_joint(r["a"], 0), 0, 0), (_joint(r["b"] + 1, 0), total, r["n"])  # (probe, bytes below, rows below)
    goals = [total * i // pieces for i in range(1, pieces)]
    near = [list(ends) for _ in goals]
    settled: list[tuple[int, int] | None] = [None] * len(goals)
    while True:
        probes: set[int] = set()
        for i, goal in enumerate(goals):
            (low, low_bytes, low_rows), (high, high_bytes, high_rows) = near[i]
            best = min(near[i], key=lambda x: abs(x[1] - goal))
            if abs(best[1] - goal) <= slack or high - low <= 1 or low_rows >= high_rows - 1:
                settled[i] = (best[0], best[2])
            else:
                probes.update(low + (high - low) * k // (PROBES + 1) for k in range(1, PROBES + 1))
        if not probes:
            return [s[0] for s in settled], [s[1] for s in settled]
        order = sorted(p for p in probes)
        size, rows = below(table, order)
        for i, goal in enumerate(goals):
            if settled[i] is None:
                a = int(np.searchsorted(size, goal, "right"))  # probes with no more bytes below than wanted
                low = (order[a - 1], int(size[a - 1]), int(rows[a - 1])) if a else near[i][0]
                high = (order[a], int(size[a]), int(rows[a])) if a < len(order) else near[i][1]
                near[i] = [max(near[i][0], low), min(near[i][1], high)]


def sharded(docs: DataFrame, shards: int, key: str = "doc_id", size: str = "size", tolerance: float = TOLERANCE) -> DataFrame:
    """Every row of ``docs`` with ``shard`` (0 to shards - 1, of near equal bytes) and ``slot`` (its place there, gapless from 0).

    Shards hold consecutive keys. All columns stay (columns named shard or slot are replaced); null keys sort
    first, a null size counts as 0; equal keys and repeated rows keep their rows and may be cut between shards; an empty
    table gives no rows. Rows are numbered once, in a table below the shared folder, so that a task that runs again
    places them alike.
    """
    k, row, piece, sz = "_sort_key", "_sort_row", "_sort_piece", "_sort_size"
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    given = docs.select(*names, F.coalesce(F.col(key).cast("long"), F.lit(-_HALF)).alias(k), F.coalesce(F.col(size), F.lit(0)).cast("long").alias(sz), F.monotonically_increasing_id().alias(row))
    given = staged(given, "shard-rows", "zstd")  # whole rows: disk counts
    table = given.select(F.col(k).alias("key"), F.col(row).alias("row"), F.col(sz).alias("size"))
    total = table.agg(F.sum("size")).first()[0] or 0
    each = max(1, min(MOST_PIECES // shards, -(-total // (shards * PIECE_BYTES))))
    starts, before = splitters(table, shards * each, tolerance)
    offsets = [0, *before]
    first = [offsets[p - p % each] if p < len(offsets) else 0 for p in range(shards * each)]

    @F.pandas_udf("int")
    def place(keys, rows):
        import pandas as pd

        return pd.Series(_placed(keys.to_numpy(), rows.to_numpy(), starts) if starts else np.zeros(len(keys), np.int64), dtype="int32")

    at = F.row_number().over(Window.partitionBy(piece).orderBy(k, row)) - 1  # the one exchange
    known = F.array(*[F.lit(o - f).cast("long") for o, f in zip(offsets, first)]) if starts else F.array(F.lit(0).cast("long"))
    out = given.withColumn(piece, place(F.col(k), F.col(row)))
    return out.select(*names, F.floor(F.col(piece) / each).cast("int").alias("shard"), (at + F.element_at(known, F.col(piece) + 1)).alias("slot"))
