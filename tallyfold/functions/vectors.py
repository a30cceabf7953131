"""Vector columns: cosine distance, hash embedding, arg-max of a probability map."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyfold.operators.dedupe import top_per_key


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def recall(memories: DataFrame, queries: DataFrame, key: str, vec: str, vec_id: str, k: int = 5) -> DataFrame:
    """The k nearest memories of each query inside the query's partition.

    A memory meets the queries of its own partition key; the k-cut is a group limit for each query applied
    before the shuffle, so a partition of any size sends at most k rows per query and task.
    """
    q = queries.select(key, F.col(vec).alias("_q"), F.col(vec_id).alias("query_id"))
    d = memories.join(q, key).select(key, "query_id", vec_id, cosine_distance(F.col(vec), F.col("_q")).alias("distance"))
    return top_per_key(d, [key, "query_id"], [F.col("distance"), F.col(vec_id)], k, rank="rank")


def hash_embedding(text: Column, dims: int = 384) -> Column:
    """Unit vector of hashed tokens over the whole text.

    Every digest byte of token i adds (byte - 127.5) / 127.5 to slot (131 i + 17 j + byte) mod dims.
    Row-local, so it needs no shuffle; the digests are computed in Arrow batches.
    """
    offsets = 17 * np.arange(32)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            tokens = (t or "").lower().split()
            if not tokens:
                out.append(np.zeros(dims))
                continue
            raw = b"".join(hashlib.sha256(f"{i}:{tok}".encode()).digest() for i, tok in enumerate(tokens))
            b = np.frombuffer(raw, dtype=np.uint8).reshape(len(tokens), 32).astype(np.int64)
            slots = (131 * np.arange(len(tokens))[:, None] + offsets[None, :] + b) % dims
            v = np.bincount(slots.ravel(), weights=((b - 127.5) / 127.5).ravel(), minlength=dims)
            norm = np.sqrt((v * v).sum())
            out.append(v / norm if norm > 0 else v)
        return pd.Series(out)

    return embed(text)


def best_class(probabilities: Column, floor: float = 0.55) -> Column:
    """Arg-max of a probability map; below the floor the row abstains."""
    top = F.array_max(F.transform(F.map_entries(probabilities), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("k"))))
    return F.struct(
        F.when(top["p"] < floor, "WARNING").otherwise(top["k"]).alias("action"), F.round(top["p"], 3).alias("confidence"), (top["p"] < floor).alias("abstained")
    )


def messages_to_sessions(turns: DataFrame, per_row: int = 256) -> DataFrame:
    """Ordered message lists per session, at most ``per_row`` messages in one row so that a
    session of any length stays a set of bounded rows."""
    seg = F.floor(F.col("turn") / per_row).cast("long")
    g = turns.groupBy("conv_id", seg.alias("segment")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return g.select("conv_id", "segment", F.transform("m", lambda x: x["text"]).alias("messages"), F.transform("m", lambda x: x["role"]).alias("roles"), F.transform("m", lambda x: x["turn"]).alias("turns"))


def sessions_to_messages(sessions: DataFrame) -> DataFrame:
    return sessions.select("conv_id", F.explode(F.arrays_zip("turns", "roles", "messages")).alias("z")).select(
        "conv_id", F.col("z.turns").alias("turn"), F.col("z.roles").alias("role"), F.col("z.messages").alias("text")
    )
