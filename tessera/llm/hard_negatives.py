"""Hard negatives of anchor vectors, found through a vector-approximation file.

Components are whole numbers, so scores (inner products) are exact. Rows with one vector and one label are
one entry with its least ``KEEP`` members: no more of them can be among the first of any list.

1. The file: each dimension is cut into ``CELLS`` cells at its quantiles, with the least and the largest
   value of each cell known over all entries; an entry is a byte for each dimension.
2. For an anchor, two tables give the least and the largest contribution of each cell; sums of looked-up
   values bound the score of an entry from below and from above.
3. Positives: of an anchor's label, entries whose upper bound reaches the ``KEEP``-th largest lower bound
   are scored exactly.
4. Negatives: of other labels, entries whose bounds meet the window of a positive are scored exactly, but
   not those below ``NEGATIVES`` entries that lie in the window for certain.

Anchors are a set of queries against all rows: entries are dealt into shards and anchors into groups, and
each shard meets each group in a task of its own, which holds ``ROWS`` entries and ``QUERIES`` anchors and
returns at most ``KEEP`` rows an anchor or ``NEGATIVES`` rows a window. What is shuffled is about a byte for
each four thousand look-ups. Equal anchors are asked once. Nothing but cell bounds reaches the driver.

Defined cases: rows with a null label, a null vector or a component that is null or not finite take no part.
Shorter vectors end in zeros; components are held within the range in which no score can overflow, 2**31 /
sqrt(dimensions). Rows without an id are no anchors; among equal scores they come last, with a null id, for
which the id 2**63 - 1 stands inside. Repeated ids are rows of their own. Windows of negative scores are
empty. Other columns are not read; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.staging import stage, with_rows

POSITIVES, NEGATIVES = 5, 5
#: An anchor's positives and the anchor itself.
KEEP = POSITIVES + 1
#: Cells of a dimension, at most 256.
CELLS = 64
ROWS, QUERIES = 4096, 2048
NO_ID = (1 << 63) - 1
ENTRY = "entry long, label long, z array<long>, codes binary, ids array<long>, rows array<long>"


def relabelled(vectors: DataFrame) -> DataFrame:
    """The labels of the contract: each seventh row, by id, takes the next of ten labels."""
    label = F.col("label").cast("long")
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(row, id, label, z) of the rows that take part; z: floor(scale * component)."""
    v = F.col("own.embedding").cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = with_rows(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"))
    rows = base.where(F.col("own.label").isNotNull() & F.col("own.embedding").isNotNull() & finite)
    dims = max(1, rows.agg(F.max(F.size("own.embedding"))).first()[0] or 1)
    most = int((2**62 / dims) ** 0.5)
    z = F.transform(v, lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(most)), F.lit(-most)))
    z = F.concat(z, F.array_repeat(F.lit(0).cast("long"), dims - F.size(v)))
    return stage(rows.select("row", F.coalesce("own.vec_id", F.lit(NO_ID)).alias("id"), F.col("own.label").alias("label"), z.alias("z")), "vectors")


def cell_bounds(entries: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts between cells, and least and largest value of each cell, for each dimension."""
    at = [k / CELLS for k in range(1, CELLS)]
    found = entries.select(F.posexplode("z").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.percentile_approx("x", at, 1000).alias("cuts")).orderBy("d").collect()
    if not found:
        return (np.zeros((1, CELLS + e), np.int64)[:, : CELLS - 1 + e] for e in (0, 1, 1))
    cuts = np.array([r.cuts for r in found], np.int64)
    lo, hi = (np.array([[r[k]] for r in found], np.int64) for k in ("lo", "hi"))
    # whole numbers: a cell ends one below the next cut
    return cuts, np.concatenate([lo, cuts], 1), np.concatenate([cuts - 1, hi], 1)


def approximate(entries: DataFrame, cuts: np.ndarray) -> DataFrame:
    """The vector-approximation file: ENTRY rows."""

    def run(batches):
        for batch in batches:
            z = _matrix(batch.column("z"), len(cuts))
            code = np.stack([np.searchsorted(cuts[d], z[:, d], "right") for d in range(len(cuts))], 1).astype(np.uint8)
            codes = pa.array([row.tobytes() for row in code], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) if c != "codes" else codes for c in ("entry", "label", "z", "codes", "ids", "rows")], ["entry", "label", "z", "codes", "ids", "rows"])

    return entries.mapInArrow(run, ENTRY)


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, dims)


class Shard:
    """Entries of one shard, by label, with bounds of their scores by table look-up."""

    def __init__(self, entries: pa.Table, lower: np.ndarray, upper: np.ndarray) -> None:
        order = np.argsort(entries.column("label").to_numpy(), kind="stable")
        entries = entries.take(pa.array(order))
        self.label = entries.column("label").to_numpy()
        self.z = _matrix(entries.column("z"), len(lower))
        codes = np.frombuffer(b"".join(entries.column("codes").to_pylist()), np.uint8).reshape(len(self.label), -1)
        self.cells = codes.astype(np.int32) + CELLS * np.arange(codes.shape[1], dtype=np.int32)
        self.ids, self.rows = entries.column("ids").to_pylist(), entries.column("rows").to_pylist()
        self.lower, self.upper = lower, upper
        self.most = int(max(np.abs(lower).max(), np.abs(upper).max())) * len(lower)

    def bounds(self, a: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible score of the entries from low to high."""
        p, q = a[:, None] * self.lower, a[:, None] * self.upper
        # narrow numbers where no sum can exceed them
        kind = np.int32 if self.most * int(np.abs(a).max(initial=0)) < 1 << 31 else np.int64
        lb, ub = (each.ravel().astype(kind).take(self.cells[low:high]).sum(1, dtype=kind) for each in (np.minimum(p, q), np.maximum(p, q)))
        return lb, ub

    def first(self, at: np.ndarray, score: np.ndarray, most: int) -> list[tuple[int, int, int]]:
        """(score, id, row) of the first rows of the entries at these places, by score and id."""
        if len(at) > most:
            keep = score >= np.partition(score, -most)[-most]
            at, score = at[keep], score[keep]
        rows = [(-s, i, r) for e, s in zip(at.tolist(), score.tolist(), strict=True) for i, r in zip(self.ids[e], self.rows[e], strict=True)]
        return [(-s, i, r) for s, i, r in sorted(rows)[:most]]

    def positives(self, a: np.ndarray, label: int) -> list[tuple[int, int, int]]:
        low, high = np.searchsorted(self.label, label), np.searchsorted(self.label, label, "right")
        lb, ub = self.bounds(a, low, high)
        at = np.arange(low, high)
        if len(at) > KEEP:
            at = at[ub >= np.partition(lb, -KEEP)[-KEEP]]
        return self.first(at, self.z[at] @ a, KEEP)

    def negatives(self, a: np.ndarray, label: int, windows: list[int]) -> list[tuple[int, int, int, int]]:
        """(top of the window, score, id, row)."""
        lb, ub = self.bounds(a, 0, len(self.label))
        other, wanted = self.label != label, {}
        for top in windows:
            floor = top - top // 5  # the least whole score of at least 80 in 100
            sure = lb[other & (lb >= floor) & (ub <= top)]
            if len(sure) >= NEGATIVES:
                floor = int(np.partition(sure, -NEGATIVES)[-NEGATIVES])
            wanted[top] = (floor, np.flatnonzero(other & (ub >= floor) & (lb <= top)))
        at = np.unique(np.concatenate([x for _, x in wanted.values()])) if wanted else np.zeros(0, np.int64)
        score, out = self.z[at] @ a, []
        for top, (floor, mine) in wanted.items():
            exact = score[np.searchsorted(at, mine)]
            held = (exact >= floor) & (exact <= top)
            out += [(top, *x) for x in self.first(mine[held], exact[held], NEGATIVES)]
        return out


def meet(file: DataFrame, anchors: DataFrame, shards: int, groups: int, ask: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``ask`` of each shard of the file with each group of anchors (q, label, z, ...)."""
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = file.withColumn("s", deal("entry", shards)).withColumn("g", every(groups))
    right = anchors.withColumn("g", deal("q", groups)).withColumn("s", every(shards))
    return left.groupBy("s", "g").cogroup(right.groupBy("s", "g")).applyInArrow(ask, schema)


def _ranked(found: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """The first rows by keys, as one array."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "row"))
    rows = found.withColumn("place", place).where(F.col("place") <= most)
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "score", "id", "row"))).alias(name))


def _real(id: Column) -> Column:
    return F.nullif(id, F.lit(NO_ID))


def mine(vectors: DataFrame, anchor: Column, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors (vec_id, label, embedding); ``anchor`` marks anchors by the column ``id``."""
    whole = whole_vectors(vectors)
    place = F.row_number().over(Window.partitionBy("z", "label").orderBy("id", "row"))
    # an array of one entry's members has at most KEEP of them
    entries = whole.withColumn("place", place).where(F.col("place") <= KEEP).groupBy("z", "label").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("members"))
    entries = stage(entries.select(F.col("members")[0]["row"].alias("entry"), "label", "z", F.col("members.id").alias("ids"), F.col("members.row").alias("rows")), "entries")
    asking = whole.where(anchor & (F.col("id") != NO_ID))
    anchors = stage(asking.groupBy("z", "label").agg(F.min("row").alias("q")), "anchors")
    of_row = stage(asking.join(anchors, ["z", "label"]).select("row", "id", "q"), "anchor-rows")
    cuts, lower, upper = cell_bounds(entries)
    file = stage(approximate(entries, cuts), "va-file")
    shards, groups = max(1, -(-file.count() // rows)), max(1, -(-anchors.count() // queries))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left):
            shard, z = Shard(left, lower, upper), _matrix(right.column("z"), len(lower))
            for k, (q, label) in enumerate(zip(right.column("q").to_pylist(), right.column("label").to_pylist(), strict=True)):
                out += [(q, *x) for x in shard.positives(z[k], label)]
        return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate(("q", "score", "id", "row"))})

    def in_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left):
            shard, z = Shard(left, lower, upper), _matrix(right.column("z"), len(lower))
            for k, (q, label, tops) in enumerate(zip(*(right.column(c).to_pylist() for c in ("q", "label", "tops")), strict=True)):
                out += [(q, *x) for x in shard.negatives(z[k], label, tops)]
        return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate(("q", "top", "score", "id", "row"))})

    near = stage(_ranked(meet(file, anchors, shards, groups, nearest, "q long, score long, id long, row long"), ["q"], KEEP, "near"), "positives")
    tops = F.array_distinct(F.filter("near.score", lambda s: s >= 0))
    asked = anchors.join(near.select("q", tops.alias("tops")), "q").where(F.size("tops") > 0)
    far = _ranked(meet(file, asked, shards, groups, in_windows, "q long, top long, score long, id long, row long"), ["q", "top"], NEGATIVES, "far")

    others = F.slice(F.filter("near", lambda x: x["row"] != F.col("row")), 1, POSITIVES)
    pairs = of_row.join(near, "q").select("id", "q", F.explode(others).alias("p")).select("id", "q", _real(F.col("p.id")).alias("positive_id"), F.col("p.score").alias("top"))
    listed = pairs.join(far, ["q", "top"]).select("id", "positive_id", "top", F.explode("far").alias("n"))
    return listed.select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("n.place").cast("int").alias("rank"), _real(F.col("n.id")).alias("negative_id"), F.col("top").alias("positive_score"), F.col("n.score").alias("negative_score")
    )
