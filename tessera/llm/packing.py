"""Best-fit packing by minimum bin slack.

Texts become byte-level BPE ids and an end id; only longer ones are cut, into full pieces after a
first piece with the rest. Packing needs no more than how many pieces there are of each length, at
most ``capacity`` numbers, so the driver plans on those: for the longest piece left, a bitset dynamic
programme over the available lengths finds the fullest combination for the rest of its bin, and that
combination is taken as often as the counts allow. Tasks then look up bin and place by a piece's
length and rank among its length. Ranks come from counts by length and hash bucket, so no task holds
all pieces of a common length.

Defined cases: null text is empty and gives one piece, the end id alone; repeated rows are packed
each; null doc_id is allowed; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import Encoder
from tessera.llm.staging import stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process, with its cache of words."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece with its length and the checksum of its little-endian 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for row, end, count, ids in own.counts_and_ids(batch.column(1)):
                size = count + 1
                stop = np.cumsum(size)
                flat = np.full(stop[-1], end_id, dtype="<u4")
                if ids is not None and len(ids):
                    flat[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
                n = -(-size // capacity)
                first = size - (n - 1) * capacity
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.where(piece == 0, 0, np.repeat(first, n) + (piece - 1) * capacity)
                length = np.where(piece == 0, np.repeat(first, n), capacity)
                at = np.repeat(stop - size, n) + start
                view = memoryview(flat.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                ids_col = batch.column(0).slice(row, end - row).take(pa.array(np.repeat(np.arange(end - row), n)))
                yield pa.RecordBatch.from_arrays([ids_col, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def fullest(lengths: list[int], counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, copies) with the greatest sum within room, by dynamic programming over bitsets of sums."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in lengths:
        if size > room:
            continue
        left, copies = min(int(counts[size]), room // size), 1
        while left > 0:
            take = min(copies, left)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            left -= take
            copies *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for size, take, before in reversed(steps):
        if not before >> total & 1:
            used[size] = used.get(size, 0) + take
            total -= size * take
    return list(used.items())


def plan(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Slots: pieces of ``length`` ranked from ``rank`` on go, one each, to bins from ``bin`` on at ``offset``.

    counts[n]: pieces of n tokens. At most capacity lengths, so this is small whatever the data.
    """
    counts = counts.copy()
    taken = np.zeros(capacity + 1, np.int64)
    slots: list[tuple[int, int, int, int]] = []
    bins = 0
    lengths = [n for n in range(capacity, 0, -1) if counts[n]]
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        parts = fullest([n for n in lengths if counts[n]], counts, capacity - seed)
        counts[seed] += 1
        need: dict[int, int] = {seed: 1}
        for size, copies in parts:
            need[size] = need.get(size, 0) + copies
        times = min(int(counts[size]) // copies for size, copies in need.items())
        offset = 0
        for size, copies in need.items():
            for _ in range(copies):
                slots.append((size, int(taken[size]), bins, offset))
                taken[size] += times
                offset += size
            counts[size] -= times * copies
        bins += times
        lengths = [n for n in lengths if counts[n]]
    slots.sort()
    return dict(zip(("length", "rank", "bin", "offset"), np.array(slots, np.int64).reshape(-1, 4).T, strict=True)) | {"bins": np.int64(bins)}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, rows_a_bucket: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    found = stage(pieces_of(docs, tokenizer, capacity), "pieces")
    by_length = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in by_length.items():
        counts[size] = n
    slots = plan(counts, capacity)
    buckets = max(1, int(counts.sum()) // rows_a_bucket)
    bucketed = found.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    base = bucketed.groupBy("length", "_b").agg(F.count("*").alias("_n")).withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    own = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = bucketed.withColumn("_r", F.row_number().over(own)).join(base.select("length", "_b", "_base"), ["length", "_b"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_r") - 1 + F.coalesce("_base", F.lit(0))).alias("rank"))
    key = slots["length"] << 44 | slots["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            sequence = slots["bin"][at] + rank - slots["rank"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(slots["offset"][at], pa.int64())], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
