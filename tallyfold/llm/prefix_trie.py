"""Prefix trie of conversations: a double-array trie for each shard of prefixes, upper nodes merged over all shards.

Turns become pairs of 64-bit hashes with the bytes of their text, and each different sequence of turns stands once with its number of
conversations. Sequences are sharded by their first turn; where more than ``SHARD_TURNS`` turns begin alike, by their first
two, four and so on turns (``cut``), so a very common beginning is spread. A shard's turns get dense ids, and its trie is packed into two
arrays: the child of state s by turn id c is t = BASE[s] + c if CHECK[t] = s. All sequences walk it together, level by level, and leave
their counts at the states. Nodes from ``cut`` down are whole in their shard; those above it are partial, and are added up by
the hash of their prefix in one small aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyfold.llm.common import map_stream, staged

SHARD_TURNS = 1 << 15
MOST_HEAD = 8  # turns that a conversation can take over
WIDE = 32  # children from which a node gets new slots without a search
NODE = "upper boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, length long, sig_a long, sig_b long, key string, parent_key string, path array<string>"
NONE_SHA = hashlib.sha256(b"").hexdigest()


# --- sequences ---


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of every conversation in order, each as (turn, a, b, length).

    Turns are ordered by number, null first, then by the hash of role and text. Rows without a conv_id belong to no conversation. A
    conversation's turns are one array of 32 bytes a turn; texts do not travel.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(text, F.lit(1), role).alias("b"), F.octet_length(text).cast("long").alias("length"))
    given = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    return given.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % 5, then c's own turns behind its first h; h is crc32(c) % 9."""
    own = staged(sequences(turns), "trie-turns")
    h = F.expr("CAST(crc32(CAST(CAST(conv_id AS string) AS binary)) % 9 AS int)")
    heads = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_HEAD).alias("head"))
    at = own.withColumns({"base": F.expr("conv_id - conv_id % 5"), "h": h}).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    return at.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


# --- shards ---


def _key(depth: Column | int) -> Column:
    return F.xxhash64(F.slice("codes", F.lit(1), depth if isinstance(depth, Column) else F.lit(depth)))


def with_cut(seqs: DataFrame, most: int = SHARD_TURNS) -> DataFrame:
    """Sequences with ``cut``, how many first turns decide their shard, and ``key``, the hash of those."""
    longest = seqs.agg(F.max(F.size("codes"))).first()[0] or 0
    out, cut = seqs.withColumns({"cut": F.lit(1), "key": _key(1)}), 1
    while cut < longest:
        hot = out.where(F.col("cut") == cut).groupBy("key").agg(F.sum(F.size("codes")).alias("n")).where(F.col("n") > most).select("key", F.lit(True).alias("hot"))
        hot = staged(hot, "trie-hot")  # no more than all turns divided by ``most``
        if not hot.limit(1).count():
            break
        met = out.join(hot, "key", "left")
        deeper = F.col("hot").isNotNull()
        out = staged(met.withColumns({"cut": F.when(deeper, 2 * cut).otherwise(F.col("cut")), "key": F.when(deeper, _key(2 * cut)).otherwise(F.col("key"))}).select(*out.columns), "trie-cut")
        cut *= 2
    return out


# --- one shard ---


class DoubleArray:
    """A trie over sequences of dense ids, given as one array of ids and the end of each sequence."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ids, self.starts, self.sizes = ids, np.concatenate(([0], ends[:-1])), np.diff(np.concatenate(([0], ends)))
        wide = int(ids.max()) + 1 if len(ids) else 1
        node, edges, n = np.zeros(len(ends), np.int64), [], 1  # the trie by levels: (parent, id, child)
        for d in range(int(self.sizes.max(initial=0))):
            on = np.flatnonzero(self.sizes > d)
            pair, which = np.unique(node[on] * wide + ids[self.starts[on] + d], return_inverse=True)
            edges.append((pair // wide, pair % wide, np.arange(n, n + len(pair))))
            node[on] = n + which
            n += len(pair)
        self.base, self.check = self._pack(edges, n)

    @staticmethod
    def _pack(edges: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        size = 2 * n + 16
        base, check, slot, free = np.zeros(size, np.int64), np.full(size, -2, np.int64), np.zeros(n, np.int64), 1
        check[0] = -1  # the root
        top = 1  # slots from here on have never been used
        for parents, ids, children in edges:
            first = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1])))
            for a, e in zip(first.tolist(), [*first[1:].tolist(), len(parents)]):
                own = ids[a:e] - ids[a]
                while free < top and check[free] != -2:
                    free += 1
                at = free
                if e - a == 1:
                    pass
                elif e - a > WIDE:
                    at = top
                else:
                    while at < top and (check[np.minimum(at + own, size - 1)] != -2).any():
                        at += 1
                if at + int(own[-1]) >= size:
                    more = max(size, at + int(own[-1]) + 16 - size)
                    base, check, size = np.concatenate((base, np.zeros(more, np.int64))), np.concatenate((check, np.full(more, -2, np.int64))), size + more
                state = slot[parents[a]]
                base[state] = at - ids[a]
                check[at + own] = state
                slot[children[a:e]] = at + own
                top = max(top, at + int(own[-1]) + 1)
        return base[:top].copy(), check[:top].copy()

    def walk(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, sequences that reach it, their states) from the root down."""
        state = np.zeros(len(self.sizes), np.int64)
        yield 0, np.arange(len(state)), state.copy()
        for d in range(int(self.sizes.max(initial=0))):
            on = np.flatnonzero(self.sizes > d)
            to = self.base[state[on]] + self.ids[self.starts[on] + d]
            if not (self.check[to] == state[on]).all():
                raise ValueError("a sequence leaves the trie")
            state[on] = to
            yield d + 1, on, to


def _nodes(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """All nodes of one shard: rows (sig_a, sig_b, n, conv_id, cut, codes) -> ``NODE`` rows."""
    table = table.combine_chunks()
    codes = table["codes"].combine_chunks()
    codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
    flat, ends = codes.flatten(), np.cumsum(np.diff(codes.offsets.to_numpy()))
    a, b, length = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    n, conv, cut, sig_a, sig_b = (table[c].to_numpy() for c in ("n", "conv_id", "cut", "sig_a", "sig_b"))
    order = np.lexsort((b, a))
    ids = np.zeros(len(a), np.int64)
    if len(a):
        ids[order] = np.cumsum(np.concatenate(([False], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))))
    trie = DoubleArray(ids, ends)
    size, far = len(trie.check), np.iinfo(np.int64).max
    count, least, bytes_, at_cut, depth, some = np.zeros(size, np.int64), np.full(size, far), np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1), np.zeros(size, np.int64)
    end, levels = np.full(size, -1), []
    for d, on, states in trie.walk():
        np.add.at(count, states, n[on])
        np.minimum.at(least, states, conv[on])
        depth[states], some[states], at_cut[states] = d, on, cut[on]
        if d:
            bytes_[states] = length[trie.starts[on] + d - 1]
        done = trie.sizes[on] == d
        end[states[done]] = on[done]
        levels.append(np.unique(states))
    upper = depth < at_cut
    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for states in levels[:0:-1]:  # from the bottom up; what whole nodes hold goes to the upper node above them, and no further
        whole = states[~upper[states]]
        leaves[whole] += children[whole] == 0
        saved[whole] += (count[whole] - 1) * bytes_[whole]
        up = trie.check[whole]
        np.add.at(children, up, 1)
        np.add.at(leaves, up, leaves[whole])
        np.add.at(saved, up, saved[whole])
    used = np.concatenate(levels)
    parent = trie.check[used]
    keys: dict[int, str] = {}

    def key(state: int) -> str:
        if state not in keys:
            s, d = trie.starts[some[state]], depth[state]
            keys[state] = xxhash.xxh3_128_hexdigest(np.stack([a[s : s + d], b[s : s + d]]).tobytes())
        return keys[state]

    def path(state: int) -> list[str]:
        out = [key(state)]
        while (state := int(trie.check[state])) >= 0:
            out.append(key(state))
        return out

    is_upper = upper[used]
    under_upper = (parent >= 0) & upper[np.maximum(parent, 0)]
    has_end = end[used] >= 0
    known = ~is_upper & ~under_upper
    out = {
        "upper": is_upper, "conv_id": least[used], "depth": depth[used], "parent_conv_id": pa.array(least[np.maximum(parent, 0)], mask=~known), "n_convs": count[used],
        "n_children": children[used], "n_leaves": leaves[used], "saved": saved[used], "length": bytes_[used],
        "sig_a": pa.array(sig_a[end[used]], mask=~has_end), "sig_b": pa.array(sig_b[end[used]], mask=~has_end),
        "key": [key(s) if u else None for s, u in zip(used.tolist(), is_upper)], "parent_key": [key(p) if u else None for p, u in zip(parent.tolist(), under_upper)],
        "path": [path(s) if u else None for s, u in zip(used.tolist(), is_upper)],
    }
    return pa.Table.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name] for f in schema], schema=schema)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows sorted by (sig_a, sig_b, conv_id) -> one hash for each signature; ids are hashed as they stream by."""
    held, sha = None, None
    for x in batches:
        out: dict = {"sig_a": [], "sig_b": [], "ends_sha256": []}
        for a, b, c in zip(*(x.column(i).to_pylist() for i in range(3))):
            if (a, b) == held:
                sha.update(b",%d" % c)
                continue
            if held:
                for name, v in zip(out, (*held, sha.hexdigest())):
                    out[name].append(v)
            held, sha = (a, b), hashlib.sha256(b"%d" % c)
        yield out
    if held:
        yield {"sig_a": [held[0]], "sig_b": [held[1]], "ends_sha256": [sha.hexdigest()]}


# --- the operator ---


def trie(seqs: DataFrame, most: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of (conv_id, turns), turns as in ``sequences``; see ``prefix_nodes``."""
    codes = F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["length"].alias("length")))
    one = staged(seqs.select("conv_id", codes.alias("codes")).select("*", F.xxhash64("codes").alias("sig_a"), F.xxhash64(F.lit(1), "codes").alias("sig_b")), "trie-sequences")
    each = staged(one.groupBy("sig_a", "sig_b").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("codes").alias("codes")), "trie-distinct")
    total = each.agg(F.sum(F.size("codes"))).first()[0] or 0
    shards = max(int(each.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // most))
    placed = with_cut(each, most).withColumn("shard", F.pmod(F.xxhash64("cut", "key"), F.lit(shards)))
    schema = to_arrow_schema(StructType.fromDDL(NODE))
    nodes = staged(placed.select("shard", "sig_a", "sig_b", "n", "conv_id", F.col("cut").cast("long").alias("cut"), "codes").groupBy("shard").applyInArrow(lambda t: _nodes(t.drop_columns("shard"), schema), NODE), "trie-nodes")
    ends = map_stream(one.select("sig_a", "sig_b", "conv_id").repartition("sig_a", "sig_b").sortWithinPartitions("sig_a", "sig_b", "conv_id"), _ends, "sig_a long, sig_b long, ends_sha256 string")
    # the nodes above the cuts: partial sums of all shards
    merged = nodes.where("upper").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.first("path").alias("path"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("whole_children"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved").alias("below_saved"), F.max("length").alias("length"), F.max("sig_a").alias("sig_a"), F.max("sig_b").alias("sig_b"),
    )
    merged = staged(merged, "trie-upper")
    uppers = merged.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("upper_children"))
    sized = merged.join(uppers, "key", "left").withColumn("n_children", F.col("whole_children") + F.coalesce("upper_children", F.lit(0)))
    own = sized.withColumns({"leaves": F.col("below_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0), "saves": F.col("below_saved") + (F.col("n_convs") - 1) * F.col("length")})
    sums = own.select(F.explode("path").alias("key"), "leaves", "saves").groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saves").alias("saved"))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv"))
    top = sized.join(sums, "key").join(parents, "parent_key", "left").select("conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved", "sig_a", "sig_b")
    low = nodes.where("not upper").join(parents, "parent_key", "left").select("conv_id", "depth", F.coalesce("parent_conv_id", "parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved", "sig_a", "sig_b")
    return top.unionByName(low).join(ends, ["sig_a", "sig_b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE_SHA)).alias("ends_sha256")
    )


def prefix_nodes(turns: DataFrame, most: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the rebuilt conversations.

    Null roles and texts are empty, null turns come first, turns of one number are ordered by their hashes and all count, repeated rows are turns of their
    own, rows without a conv_id are left out. Turns are equal if both 64-bit hashes of role and text are. A conversation that loses all its turns
    is a member of the root. An empty table gives no rows; other columns are not read. ends_sha256 is a running hash, so the ids that
    end at one node pass through one task, in order and without being held.
    """
    return trie(rebuilt(turns), most)


SQL = """
WITH b AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM b GROUP BY c),
h AS (SELECT *, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
  lambda p, x: list_reduce([xor(p, x), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 9 AS h FROM s),
r AS (SELECT h.c, list_concat(coalesce(o.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN s o ON o.c = h.base),
p AS (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM r),
n AS (SELECT d AS depth, turns[1:d] AS prefix, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(turns) = d), '') AS ends FROM p GROUP BY d, turns[1:d]),
k AS (SELECT n.*, coalesce((SELECT count(*) FROM n m WHERE m.depth = n.depth + 1 AND m.prefix[1:n.depth] = n.prefix), 0) AS n_children FROM n),
a AS (SELECT *, unnest(range(0, depth + 1)) AS up FROM k),
t AS (SELECT up AS depth, prefix[1:up] AS prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE strlen(prefix[depth].t) END) AS saved FROM a GROUP BY up, prefix[1:up])
SELECT k.conv_id, k.depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, t.n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN t ON t.depth = k.depth AND t.prefix = k.prefix LEFT JOIN n q ON q.depth = k.depth - 1 AND q.prefix = k.prefix[1:k.depth - 1]
"""
