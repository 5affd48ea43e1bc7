"""Prefix trie of conversations, built as a Patricia tree over sorted sequences of turns.

1. A turn is a fingerprint of 128 bits over role and text, with its number of words. A conversation is the
   list of its turns; its path is their fingerprints in one binary value, 16 bytes a turn. Texts are read
   once and never shuffled.
2. Equal paths become one sequence with its number of conversations, its least id and the hash of its ids.
   The ids of a path stream through one task in order, as the hash needs; nothing else is held.
3. The distinct sequences are range-partitioned and sorted by path. Each part builds a Patricia tree with a
   stack over the longest common prefixes of neighbours: points are made where sequences end or part only.
   Members, least ids, leaves and saved tokens are summed over the points.
4. Nodes without a branch are the inner turns of a compressed edge. They have the members of the point
   below; what they save is that point's sum plus a suffix sum of words along the edge.
5. Where one part ends and the next begins, both hold the prefix that their border sequences share. These
   nodes are cut from the local trees and added up by fingerprint. The border prefixes are themselves sorted
   sequences, and each node belongs to the first that has it, so their own savings add up by suffix sums too.

A part has up to ``PART`` turns. The driver gets Spark's sample of paths for the ranges; one task orders two
paths a part.

Defined cases: rows without conv_id take no part; null roles and texts are empty; turns go by ``turn``
(null first), those with the same one by fingerprint, and repeated rows are turns of their own; a
conversation without turns is a member of the root only; an empty table has no nodes. Other columns are not
read. Distinct turns and prefixes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bytetext import mix
from tessera.llm.staging import stage

#: Turns of a part at most, about, and turns for which a part of its own is made while there are free tasks.
PART, LEAST_PART = 1_000_000, 4_000
WORD = r"[^\x20\x09-\x0D]+"
NOTHING = hashlib.sha256(b"").hexdigest()
_SEQUENCE = "f1 long, f2 long, path binary, words binary, conv_id long"
_DISTINCT = "path binary, words binary, conv_id long, n long, ends string"
_NODE = (
    "part int, shared boolean, border boolean, owned boolean, ask boolean, f1 long, f2 long, p1 long, p2 long, depth long, conv_id long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string"
)


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the fingerprints and numbers of words of each conversation's turns, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "a", "b", "words"))).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["words"].alias("words"))).alias("turns"))


def with_heads(seqs: DataFrame, every: int, most: int) -> DataFrame:
    """Give each conversation c the first h turns of conversation c - c % every in place of its own first h, with h = crc32(c) % most."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = seqs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    none = F.slice("turns", 1, 0)
    joined = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left")
    own = F.slice(F.col("turns"), h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), own).alias("turns"))


def _prefixes(a: np.ndarray, b: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Running combination of turns with their places, twice 64 bits: that of a prefix is x[off + depth] ^ x[off]."""
    place = np.arange(len(a), dtype=np.uint64) - np.repeat(off[:-1], np.diff(off)).astype(np.uint64)
    each = mix(a, mix(b, place)), mix(b, mix(a, place + np.uint64(1 << 32)))
    return [np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(x)]) if len(x) else np.zeros(1, np.uint64) for x in each]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("turns")
        flat = lists.flatten()
        off = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        a, b = (flat.field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in ("a", "b"))
        both = _prefixes(a, b, off)
        binary = lambda data, width: pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((off * width).astype(np.int32)), pa.py_buffer(data.tobytes())])  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays(
            [*(pa.array((x[off[1:]] ^ x[off[:-1]]).view(np.int64)) for x in both), binary(np.stack([a, b], 1).astype(">u8"), 16), binary(flat.field("words").to_numpy(zero_copy_only=False).astype("<i4"), 4), batch.column("conv_id").cast(pa.int64())],
            ["f1", "f2", "path", "words", "conv_id"],
        )


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal paths in rows sorted by path and conv_id; a run may go on in the next batch."""
    held, ids = None, None
    done: list[tuple] = []

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["path", "words", "conv_id", "n", "ends"])
        done.clear()
        return out

    for batch in batches:
        f1, f2 = (batch.column(k).to_numpy() for k in ("f1", "f2"))
        cuts = [0, *(np.flatnonzero((f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])) + 1).tolist(), len(f1)] if len(f1) else [0]
        conv = batch.column("conv_id").to_pylist()
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            key = (int(f1[low]), int(f2[low]))
            text = ",".join(map(str, conv[low:high])).encode()
            if held and held[0] == key:
                ids.update(b"," + text)
                held[4] += high - low
            else:
                if held:
                    done.append((*held[1:], ids.hexdigest()))
                held, ids = [key, batch.column("path")[low].as_py(), batch.column("words")[low].as_py(), conv[low], high - low], hashlib.sha256(text)
        if len(done) >= 10_000:
            yield rows()
    if held:
        done.append((*held[1:], ids.hexdigest()))
    if done:
        yield rows()


def _common(a: np.ndarray, b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Turns that each sequence has in common with the one before it; 0 for the first."""
    size, out = np.diff(off), np.zeros(len(off) - 1, np.int64)
    live, d = np.arange(1, len(out)), 0
    while len(live):
        live = live[(size[live - 1] > d) & (size[live] > d)]
        x, y = off[live - 1] + d, off[live] + d
        live = live[(a[x] == a[y]) & (b[x] == b[y])]
        d += 1
        out[live] = d
    return out


def _both(x: bytes, y: bytes | None) -> int:
    """Turns that two paths have in common; -1 without a second one."""
    if y is None:
        return -1
    n = min(len(x), len(y)) // 16
    p, q = (np.frombuffer(v, ">u8", 2 * n).reshape(-1, 2) for v in (x, y))
    differ = np.flatnonzero((p != q).any(axis=1))
    return int(differ[0]) if len(differ) else n


class _Patricia:
    """Points of the compressed tree of sorted distinct sequences; point 0 is the root."""

    def __init__(self, size: np.ndarray, common: np.ndarray, before: int, after: int) -> None:
        self.seq, self.depth, self.parent, self.end = [0], [0], [-1], [-1]
        stack, lengths = [0], size.tolist()

        def add(seq: int, depth: int) -> None:
            for to, x in ((self.seq, seq), (self.depth, depth), (self.parent, -1), (self.end, -1)):
                to.append(x)
            stack.append(len(self.seq) - 1)

        def close(to: int) -> None:
            while self.depth[stack[-1]] > to:
                x = stack.pop()
                if self.depth[stack[-1]] < to:  # the sequences part inside an edge
                    add(self.seq[x], to)
                self.parent[x] = stack[-1]

        for i, shared in enumerate(common.tolist()):
            close(shared)
            if i == 0 and before > 0:
                add(0, before)
            if lengths[i] > self.depth[stack[-1]]:
                add(i, lengths[i])
            self.end[stack[-1]] = i
        close(max(after, 0))
        close(0)


def _part(rows: pa.Table, bounds: pa.Table) -> pa.Table:
    """Nodes of one part: whole ones, and what it has of those that it shares with its neighbours."""
    rows = rows.sort_by("path")
    m, part = len(rows), rows.column("part")[0].as_py()
    paths, words = rows.column("path").combine_chunks(), rows.column("words").combine_chunks()
    off = np.concatenate([[0], np.cumsum([len(x) // 16 for x in paths.to_pylist()])]).astype(np.int64)
    flat = np.frombuffer(b"".join(paths.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
    a, b = np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1])
    word = np.frombuffer(b"".join(words.to_pylist()), "<i4").astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(word)])
    first, last = paths[0].as_py(), paths[m - 1].as_py()
    before, after = (_both(x, bounds.column(k)[0].as_py()) for x, k in ((first, "before"), (last, "after")))
    common = _common(a, b, off)
    tree = _Patricia(np.diff(off), common, before, after)
    seq, depth, parent, end = (np.array(x, np.int64) for x in (tree.seq, tree.depth, tree.parent, tree.end))
    k = len(seq)
    count, least, ends = (rows.column(c).to_pylist() for c in ("n", "conv_id", "ends"))
    # over the points, children first
    n, conv, hi, kids, leaves = [0] * k, [None] * k, seq.tolist(), [0] * k, [0] * k
    order = np.argsort(-depth, kind="stable").tolist()
    for x in order:
        if (e := tree.end[x]) >= 0:
            n[x] += count[e]
            conv[x] = least[e] if conv[x] is None else min(conv[x], least[e])
            hi[x] = max(hi[x], e)
        if (p := tree.parent[x]) >= 0:
            n[p] += n[x]
            conv[p] = conv[x] if conv[p] is None else min(conv[p], conv[x])
            hi[p] = max(hi[p], hi[x])
            kids[p] += 1
    n_of, conv_of = np.array(n, np.int64), np.array(conv, np.int64)
    on_last = (np.array(hi) == m - 1) & (depth <= after)
    shared = on_last | ((seq == 0) & (depth <= before))
    at = off[seq] + depth
    above = np.where(parent >= 0, depth[parent], 0)
    own = np.where(shared | (depth == 0), 0, (n_of - 1) * (upto[at] - upto[np.maximum(at - 1, 0)]))
    inner = np.where(shared | (depth == 0), 0, (n_of - 1) * (upto[np.maximum(at - 1, 0)] - upto[off[seq] + above]))
    saved, whole_kids, own, inner = own.tolist(), [0] * k, own.tolist(), inner.tolist()
    for x in order:
        if tree.end[x] >= 0 and not kids[x] and not shared[x]:
            leaves[x] += 1
        if (p := tree.parent[x]) >= 0:
            saved[p] += saved[x] + inner[x]
            leaves[p] += leaves[x]
            whole_kids[p] += not shared[x]
    # expand the edges: the nodes of a point are those from below its parent down to it; the root has none above
    length = depth - above
    length[0] = 1
    x = np.repeat(np.arange(k), length)
    step = np.arange(len(x)) - np.repeat(np.cumsum(length) - length, length)
    d = np.where(x == 0, 0, above[x] + 1 + step)
    start, bottom = off[seq[x]], d == depth[x]
    edge = (n_of[x] - 1) * np.where(shared[x] | bottom, 0, upto[np.maximum(start + depth[x] - 1, 0)] - upto[np.maximum(start + d - 1, 0)])
    both = _prefixes(a, b, off)
    prefix = [(y[start + d] ^ y[start]).view(np.int64) for y in both]
    upper = [np.where(d > 0, y[start + np.maximum(d - 1, 0)] ^ y[start], 0).view(np.int64) for y in both]
    top = (step == 0) & (d > 0)
    above_shared = top & shared[parent[x]] & ~shared[x]
    parent_conv = np.where(top, conv_of[parent[x]], conv_of[x])
    owned_from = -1 if before < 0 else min(before, after, int(common[1:].min()) if m > 1 else before)
    children = np.where(bottom, np.array(whole_kids)[x], np.where(shared[x], 0, 1))
    sha = [ends[e] if low and e >= 0 else None for e, low in zip(end[x].tolist(), bottom.tolist(), strict=True)]
    no_parent = (d == 0) | shared[x] | above_shared
    return pa.table({
        "part": pa.array(np.full(len(x), part, np.int32)), "shared": pa.array(shared[x]), "border": pa.array(on_last[x]), "owned": pa.array(on_last[x] & (d > owned_from)), "ask": pa.array(above_shared),
        "f1": pa.array(prefix[0]), "f2": pa.array(prefix[1]), "p1": pa.array(upper[0]), "p2": pa.array(upper[1]), "depth": pa.array(d), "conv_id": pa.array(conv_of[x]),
        "parent_conv_id": pa.array(parent_conv, mask=no_parent), "n_convs": pa.array(n_of[x]), "n_children": pa.array(children.astype(np.int64)), "n_leaves": pa.array(np.array(leaves, np.int64)[x]),
        "saved_tokens": pa.array(np.array(saved, np.int64)[x] + edge), "words": pa.array(np.where(d > 0, upto[start + d] - upto[np.maximum(start + d - 1, 0)], 0)), "ends": pa.array(sha, pa.string()),
    })


def prefix_trie(seqs: DataFrame, least_part: int = LEAST_PART) -> DataFrame:
    """A row for each distinct prefix of the sequences (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = seqs.sparkSession
    paths = seqs.mapInArrow(_paths, _SEQUENCE).repartition(F.col("f1"), F.col("f2")).sortWithinPartitions("f1", "f2", "conv_id")
    distinct = stage(paths.mapInArrow(_distinct, _DISTINCT), "trie-sequences")
    turns = distinct.agg(F.coalesce(F.sum(F.octet_length("path") / 16 + 1), F.lit(0)).cast("long")).first()[0]
    parts = max(1, -(-turns // PART), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // least_part)))
    ordered = stage(distinct.repartitionByRange(parts, "path").withColumn("part", F.spark_partition_id()), "trie-sorted")
    line = Window.orderBy("part")
    bounds = ordered.groupBy("part").agg(F.min("path").alias("lo"), F.max("path").alias("hi")).select("part", F.lag("hi").over(line).alias("before"), F.lead("lo").over(line).alias("after"))
    nodes = stage(ordered.groupBy("part").cogroup(bounds.groupBy("part")).applyInArrow(_part, _NODE), "trie-nodes")

    node, above = ["f1", "f2"], ["p1", "p2"]
    borders = nodes.where("shared")
    merged = borders.groupBy(*node, *above, "depth").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends")
    )
    merged = stage(merged, "trie-borders")
    kids = merged.where("depth > 0").groupBy(F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("kids"))
    down = Window.partitionBy("part").orderBy(F.col("depth").desc())
    own = borders.where("border").select("part", *node, "depth", "owned", "words").join(merged.select(*node, "n_convs"), node)
    own = own.withColumn("sum", F.sum(F.when(F.col("owned"), (F.col("n_convs") - 1) * F.col("words")).otherwise(0)).over(down)).groupBy(*node).agg(F.sum("sum").alias("sum"))
    parents = merged.select(F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("depth") + 1, F.col("conv_id").alias("parent_conv_id")).toDF("p1", "p2", "depth", "parent_conv_id")
    zero = lambda c: F.coalesce(c, F.lit(0))
    shared = merged.join(kids, node, "left").join(own, node, "left").join(parents, [*above, "depth"], "left").withColumns(
        {"n_children": F.col("n_children") + zero("kids"), "saved_tokens": F.col("saved_tokens") + zero("sum")}
    )
    # the least member of a shared parent, by part, so that the many children of one are spread over the parts
    asked = borders.select("part", *node).join(merged.select(*node, F.col("conv_id").alias("parent_conv_id")), node).toDF("p1", "p2", "part", "parent_conv_id")
    below = nodes.where("ask").drop("parent_conv_id").join(asked, ["part", *above])
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256")]
    return nodes.where("not shared and not ask").select(*columns).union(below.select(*columns)).union(shared.select(*columns))
