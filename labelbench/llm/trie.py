"""Prefix trie of conversations, from sorted sequences.

Conversations become sequences of turn digests, 16 bytes a turn, and are sorted by them over the
whole table: a range exchange gives blocks of neighbours, numbered in order and written with their
rows.  A block computes the lengths of the prefixes that neighbours share (LCPs) and a sparse table
of their range minima.  Every candidate prefix - row i, depth d - finds the first and the last row
that share it by binary searches over that table, one to the left and one to the right: as powers
of two fall, a step is taken where the minimum over it is at least d.  The two extents are the
node's members; there is no stack and no order among the searches.

Everything told of a node is a sum or a minimum over its rows, so a node whose members lie in
several blocks is put together from one row per block.  Those nodes are prefixes of the blocks'
first and last rows.  For sums over a subtree, a new node counts at the first row that has it, a
childless one at the last: both are known from the LCP with the neighbour, also at a border.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import land

BLOCK = 16_384  # conversations to a block, about
BLOCK_TURNS = 262_144  # turns to a block, about
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def prefix_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its hundred (the contract's rule)."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 6).cast("int")


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation's turns in order, as structs of turn, digest and code points.

    Turns go by number, null first; equal numbers by digest.  A null role or text is an empty one;
    rows of a null conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat_ws(" ", F.length(role).cast("string"), role, text).cast("binary"))
    return (turns.filter("conv_id IS NOT NULL")
            .select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.length(text).alias("size")).alias("t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))


def rebuilt(turns: DataFrame, shared=prefix_turns) -> DataFrame:
    """(conv_id, seq, sizes): a conversation's first ``shared(conv_id)`` turns come from conversation ``c - c % 100``."""
    own = land(sequences(turns), "trie-turns")
    base = own.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, 5).alias("base"))
    h = shared(F.col("conv_id"))
    joined = own.join(base, F.col("conv_id") - F.col("conv_id") % 100 == F.col("base_id"), "left")
    whole = F.concat(F.slice(F.coalesce("base", F.filter("turns", lambda t: F.lit(False))), F.lit(1), h),
                     F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0))))
    return joined.select("conv_id", whole.alias("turns")).select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("seq"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"))


def sorted_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``block``, landed, and for every block the last sequence before it and the first behind it.  Runs jobs."""
    n, n_turns = rows.agg(F.count(F.lit(1)), F.sum(F.size("sizes").cast("bigint"))).first()
    blocks = max(1, -(-n // BLOCK), -(-(n_turns or 0) // BLOCK_TURNS))
    rows = land(rows.repartitionByRange(blocks, "seq", "conv_id").withColumn("block", F.spark_partition_id()), "trie-blocks")
    ends = land(rows.groupBy("block").agg(F.min("seq").alias("low"), F.max("seq").alias("high")), "trie-borders")
    there = sorted(r.block for r in ends.select("block").collect())  # one number per block
    near = rows.sparkSession.createDataFrame(
        [(b, p, q) for b, p, q in zip(there, [None, *there], [*there, None][1:])], "block int, before int, behind int")
    return rows, near.join(ends.select(F.col("block").alias("before"), "high"), "before", "left") \
        .join(ends.select(F.col("block").alias("behind"), "low"), "behind", "left").select("block", "high", "low")


def common(a: bytes | None, b: bytes | None) -> int:
    """Turns that two sequences share at their beginnings; -1 where there is no other."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // 16
    x, y = (np.frombuffer(s[:16 * n], "V16") for s in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def neighbour_lcps(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every row but the first, how many turns it shares with the row before."""
    size = np.diff(first)
    n = np.minimum(size[1:], size[:-1])
    out = n.copy()
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(np.arange(len(n)), n)
    differ = np.flatnonzero((flat[first[row] + k] != flat[first[row + 1] + k]).any(1))
    np.minimum.at(out, row[differ], k[differ])
    return out


class RangeMin:
    """Sparse table: minima over all runs of 2^k neighbours."""

    def __init__(self, x: np.ndarray):
        self.levels, self.n = [x], len(x)
        while 2 << (len(self.levels) - 1) <= len(x):
            a, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(a[:-half], a[half:]))

    def over(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of x[a:b] (a < b)."""
        k = np.frexp((b - a).astype(float))[1] - 1
        out = np.empty(len(a), self.levels[0].dtype)
        for level in np.unique(k):
            at = k == level
            out[at] = np.minimum(self.levels[level][a[at]], self.levels[level][b[at] - (1 << int(level))])
        return out

    def last(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Largest r with x[i], ..., x[r - 1] all >= depth, by binary search."""
        at = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            can = at + (1 << k) <= self.n
            can[can] = self.levels[k][at[can]] >= depth[can]
            at[can] += 1 << k
        return at

    def first(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Smallest l with x[l], ..., x[i - 1] all >= depth, by binary search."""
        at = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            can = at >= 1 << k
            can[can] = self.levels[k][at[can] - (1 << k)] >= depth[can]
            at[can] -= 1 << k
        return at


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)]).astype(np.int64)


def prefix_digests(seq: bytes, top: int) -> list[bytes]:
    """Names of a sequence's prefixes of 0 to ``top`` turns."""
    h, out = hashlib.sha256(), []
    for d in range(top + 1):
        out.append(d.to_bytes(4, "big") + h.digest()[:16])
        h.update(seq[16 * d:16 * d + 16])
    return out


def block_nodes(conv: np.ndarray, seqs: list[bytes], sizes: np.ndarray, before: int, behind: int) -> dict[str, list | np.ndarray]:
    """What a block knows of the nodes among its rows, which are sorted by (seq, conv_id).

    ``sizes`` has the code points of all turns end to end; ``before`` and ``behind`` are the LCPs of
    the first and last row with their neighbours in other blocks.  A node that lies in other blocks,
    too, has a ``key``; so has the parent of a node where the parent does (``parent_key``).
    """
    n = len(conv)
    length = np.array([len(s) // 16 for s in seqs], np.int64)
    first = _sums(length)
    flat = np.frombuffer(b"".join(seqs), "<u8").reshape(-1, 2)
    lcp = neighbour_lcps(flat, first)  # lcp[i] is of rows i and i + 1
    table, smallest = RangeMin(lcp), RangeMin(conv)
    shared = np.concatenate([[before], lcp, [behind]])  # with the row before, by row, and of the last row with the next block's
    # candidate prefixes: of every row those that no row of the block before it has (the first row: all)
    lowest = np.concatenate([[0], lcp + 1])
    count = length - lowest + 1
    off = _sums(count)
    row = np.repeat(np.arange(n), count)
    depth = np.arange(off[-1]) - off[row] + lowest[row]
    left, right = table.first(row, depth), table.last(row, depth)
    up = np.maximum(depth - 1, 0)
    up_left, up_right = table.first(row, up), table.last(row, up)
    parent = off[up_left] + up - lowest[up_left]
    new = depth > shared[row]  # not in the block before either
    child = new & (depth > 0)
    n_children = np.bincount(parent[child], minlength=len(row))
    childless_end = _sums(shared[1:] < length)
    total, turns_before = _sums(np.add.reduceat(np.append(sizes, 0), first[:-1]) * (length > 0)), _sums(sizes)
    # code points of all members' turns from this depth on, less those of the nodes below that begin here, once each
    above = turns_before[first[left] + np.maximum(depth - 1, 0)] - turns_before[first[left]]
    every = total[right + 1] - total[left] - (right + 1 - left) * above
    fresh_from = np.minimum(np.maximum(shared[:-1], 0), length)  # depth d is turn d - 1: new depths begin behind the shared ones
    fresh = _sums(turns_before[first[1:]] - turns_before[first[:-1] + fresh_from])
    own_from = np.minimum(np.maximum(np.maximum(depth - 1, 0), fresh_from[left]), length[left])
    once = fresh[right + 1] - fresh[left + 1] + turns_before[first[left] + length[left]] - turns_before[first[left] + own_from]
    outside = lambda a, b, d: ((a == 0) & (before >= d)) | ((b == n - 1) & (behind >= d))
    names = [prefix_digests(seqs[0], min(max(before, 0), int(length[0])) if before >= 0 else -1),
             prefix_digests(seqs[-1], min(max(behind, 0), int(length[-1])) if behind >= 0 else -1)]

    def keys(a, b, d):
        out = [None] * len(a)
        for j in np.flatnonzero(outside(a, b, d)):
            out[j] = names[0][d[j]] if a[j] == 0 and before >= d[j] else names[1][d[j]]
        return out

    key, parent_key = keys(left, right, depth), keys(up_left, up_right, up)
    low = smallest.over(left, right + 1)
    # conversations that end at a node come first among its members
    ending = np.flatnonzero(np.concatenate([[True], (lcp < length[1:]) | (lcp < length[:-1])]))  # first rows of equal sequences
    stop = np.append(ending[1:], n)
    ends: list = [None] * len(row)
    for a, b in zip(ending.tolist(), stop.tolist(), strict=True):
        at = off[table.first(np.array([a]), length[[a]])[0]]
        i = int(at + length[a] - lowest[a]) if length[a] >= lowest[a] else -1
        ends[i] = ",".join(map(str, conv[a:b].tolist())).encode()
    return {"conv_id": low, "depth": depth, "parent_conv_id": [None if d == 0 else int(c) for d, c in zip(depth, low[parent], strict=True)],
            "n_convs": right + 1 - left, "n_children": n_children, "n_leaves": childless_end[right + 1] - childless_end[left],
            "saved_tokens": every - once, "key": key, "parent_key": [None if d == 0 else k for d, k in zip(depth, parent_key, strict=True)],
            "ends": ends}


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, comma-joined, from rows sorted by (key, block): one running digest, whatever their number."""
    key, h = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch["key"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if k != key:
                if h:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(ids)
            else:
                h.update(b"," + ids)
        yield pa.record_batch([pa.array([k for k, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names=["key", "ends_sha256"])
    if h:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def prefix_trie(turns: DataFrame, shared=prefix_turns) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``turns`` has conv_id, turn, role and text; other columns are not read.  A node is a distinct
    sequence of the first d turns of conversations rebuilt by ``shared``; conv_id is its smallest
    member.  Null roles and texts are empty ones; a null turn comes first; equal turns go by their
    content, so repeated rows are turns of their own.  Rows of a null conv_id are left out.  ``c % 100``
    has the sign of c.  An empty table has no node.  A text of any length counts as 16 bytes and its size; a
    conversation is one row of 24 bytes a turn, so its length is what a row may hold.  Runs jobs.
    """
    rows, borders = sorted_blocks(rebuilt(turns.select("conv_id", "turn", "role", "text"), shared))

    def nodes_of(rows: pa.Table, border: pa.Table) -> pa.Table:
        rows = rows.sort_by([("seq", "ascending"), ("conv_id", "ascending")])
        seqs = rows["seq"].to_pylist()
        sizes = rows["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        got = block_nodes(rows["conv_id"].to_numpy(), seqs, sizes, common(border["high"][0].as_py(), seqs[0]), common(seqs[-1], border["low"][0].as_py()))
        kinds = {c: pa.int64() for c in NODE} | {"key": pa.binary(), "parent_key": pa.binary(), "ends": pa.binary()}
        block = rows["block"][0].as_py()
        whole = [None if k else hashlib.sha256(e or b"").hexdigest() for k, e in zip(got["key"], got["ends"], strict=True)]
        got["ends"] = [e if k else None for k, e in zip(got["key"], got["ends"], strict=True)]
        return pa.table({c: pa.array(got[c], t) for c, t in kinds.items()} | {"ends_sha256": pa.array(whole, pa.string()),
                        "block": pa.array([block] * len(whole), pa.int32())})

    schema = ", ".join(f"{c} long" for c in NODE) + ", key binary, parent_key binary, ends binary, ends_sha256 string, block int"
    parts = land(rows.groupBy("block").cogroup(borders.groupBy("block")).applyInArrow(nodes_of, schema), "trie-nodes")
    over = parts.filter("key IS NOT NULL")
    digests = over.filter("ends IS NOT NULL").select("key", "block", "ends").repartition("key").sortWithinPartitions("key", "block") \
        .mapInArrow(_digest_runs, "key binary, ends_sha256 string")
    merged = over.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]).join(digests, "key", "left")
    merged = land(merged, "trie-border-nodes")
    least = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_least"))
    # a block asks for each parent once, so the children of one parent are spread over their blocks
    asked = parts.filter("key IS NULL AND parent_key IS NOT NULL").select("block", "parent_key").distinct().join(least, "parent_key")
    parent = F.coalesce("_least", "parent_conv_id").alias("parent_conv_id")
    no_ends = F.lit(hashlib.sha256(b"").hexdigest())
    cols = [parent if c == "parent_conv_id" else F.col(c) for c in NODE]
    inside = parts.filter("key IS NULL").join(asked, ["block", "parent_key"], "left").select(*cols, "ends_sha256")
    across = merged.withColumn("parent_conv_id", F.lit(None).cast("bigint")).join(least, "parent_key", "left") \
        .select(*cols, F.coalesce("ends_sha256", no_ends).alias("ends_sha256"))
    return inside.unionByName(across)
