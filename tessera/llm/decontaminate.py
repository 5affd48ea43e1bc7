"""Benchmark decontamination by suffix arrays over shards of the training text.

A shard is a run of whole documents of a few megabytes, and its words are the text that is indexed.
Its suffix array keeps the positions from which a test could match at all (the first two words stand
side by side in some test item, or the first is a whole item), ordered by the words that follow, to
the depth of a window. Every test suffix of a window's length is binary-searched there; the range
that it finds are its locations. From each location where a match with an item begins (the words before
differ), the match is followed word for word along that item: the longest one of a document is its
longest verbatim match. Words are compared by 64-bit hashes.

The tests are dealt to blocks of whole items, which executors build, write once to the shared folder and
memory-map, a block once a task, so neither the driver nor a task holds all tests or a list of them.

Defined cases: null or wordless text has no words, no hits and no items; a null item_id counts as
the empty id; repeated rows are judged each, whatever their doc_id; an empty benchmark contaminates
nothing; of several longest matches the first counts.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytetext import ALNUM, LOWER, chunks, docs_of, hash_spans, mix, spans
from tessera.llm.staging import local_path, new_path, with_rows

WINDOW = 13
#: A text is contaminated from one hit word in so many on.
SHARE = 20
#: Pairs of a location and a place in an item that are looked at together.
PAIRS = 1 << 21
#: Odd, so that its powers keep all bits of a sum of word hashes.
BASE = 0x9E3779B97F4A7C15
OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_at long"


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and the offsets of each text into them."""
    low = LOWER[buf]
    start, stop = spans(low, off, ALNUM)
    return (hash_spans(low, start, stop) if len(start) else np.zeros(0, np.uint64)), docs_of(start, off)


def _block(texts: pa.ChunkedArray, ids: list[str], window: int) -> dict[str, np.ndarray]:
    """Distinct windows as rows of hashes, their sizes, where each stands in which item, and the items' words."""
    column = texts.cast(pa.large_string()).combine_chunks()
    parts = [words(buf, off) for _, _, buf, off in chunks(column)]
    bounds = np.cumsum(np.concatenate([[0], *(np.diff(p[1]) for p in parts)])).astype(np.int64)
    found = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in parts)])
    n = np.diff(bounds)
    has = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
    if not has.sum():
        return {}
    owner = np.repeat(np.arange(len(n)), has)
    inside = np.arange(has.sum()) - np.repeat(np.cumsum(has) - has, has)
    size = np.minimum(n[owner], window)
    at = (bounds[owner] + inside)[:, None] + np.arange(window)
    grams = np.where(np.arange(window) < size[:, None], found[np.minimum(at, len(found) - 1)], np.uint64(0))
    rows, group = np.unique(grams, axis=0, return_inverse=True)
    group = group.ravel()
    order = np.argsort(group, kind="stable")
    length = np.zeros(len(rows), np.int64)
    length[group] = size
    # pairs of neighbouring words from which a window starts, and one-word windows
    second = np.where(length > 1, rows[:, 1] if window > 1 else 0, np.uint64(0))
    return {
        "rows": rows, "size": length, "use_at": np.searchsorted(group[order], np.arange(len(rows) + 1)), "owner": owner[order], "place": inside[order],
        "pairs": np.unique(mix(rows[:, 0], second)), "single": np.unique(rows[length == 1, 0]), "words": found, "bounds": bounds,
        "ids": np.array([x.encode() for x in ids], dtype=object).astype("S") if ids else np.zeros(0, "S1"),
    }


def write_blocks(benchmark: DataFrame, window: int = WINDOW, block_chars: int = 4_000_000) -> list[str]:
    """Folders of the test blocks, each of whole items of about block_chars."""
    spark = benchmark.sparkSession
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    root = local_path(new_path(spark, "tests"))
    blocks = max(1, -(-chars // block_chars))

    def write(group: pa.Table) -> pa.Table:
        arrays = _block(group.column("text"), group.column("id").to_pylist(), window)
        folder = f"{root}/{uuid.uuid4().hex}"
        if arrays:
            os.makedirs(folder)
            for name, value in arrays.items():
                np.save(f"{folder}/{name}.npy", value)
        return pa.table({"folder": pa.array([folder] if arrays else [], pa.string())})

    # a repeated task writes another folder; only those that are reported count
    dealt = tests.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    return sorted(r[0] for r in dealt.groupBy("block").applyInArrow(write, "folder string").collect())


@dataclass
class SuffixArray:
    """Positions of a shard in the order of the words that follow, as far as depth."""

    at: np.ndarray
    keys: np.ndarray

    @classmethod
    def build(cls, tokens: np.ndarray, bounds: np.ndarray, candidates: np.ndarray, depth: int) -> SuffixArray:
        """Sort candidate positions; a document's end sorts first. The order is refined only among equals."""
        end = bounds[np.searchsorted(bounds, candidates, "right")]
        place = candidates[:, None] + np.arange(depth)
        keys = np.where(place < end[:, None], tokens[np.minimum(place, len(tokens) - 1)] if len(tokens) else 0, np.uint64(0))
        order = np.lexsort(keys.T[::-1]) if len(candidates) else candidates
        return cls(candidates[order], keys[order])

    def ranges(self, queries: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query, the range of suffixes that begin with its first ``size`` words, by binary search."""
        depth = queries.shape[1]
        unused = np.arange(depth) >= size[:, None]
        bounds = []
        for upper in (False, True):
            low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.at), np.int64)
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                here, want = self.keys[mid], queries[open_]
                differs = (here != want) & ~unused[open_]
                first = differs.argmax(1)
                rows = np.arange(len(open_))
                equal = ~differs[rows, first]
                right = here[rows, first] < want[rows, first]
                right = np.where(equal, upper, right)
                low[open_[right]] = mid[right] + 1
                high[open_[~right]] = mid[~right]
            bounds.append(low)
        return bounds[0], bounds[1]


def _matches(tokens: np.ndarray, bounds: np.ndarray, block: dict[str, np.ndarray], bits: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, position) of every occurrence of the block's windows."""
    none = np.zeros(0, np.int64)
    if not len(tokens):
        return none, none
    after = np.append(tokens[1:], np.uint64(0))
    last = bounds[1:][np.diff(bounds) > 0] - 1
    after[last] = 0
    pair = mix(tokens, after)
    shift = np.uint64(64 - 22)
    some = np.flatnonzero(bits[pair >> shift])
    at = np.searchsorted(block["pairs"], pair[some])
    keep = block["pairs"][np.minimum(at, len(block["pairs"]) - 1)] == pair[some]
    candidates = some[keep]
    if len(block["single"]):
        candidates = np.union1d(candidates, np.flatnonzero(np.isin(tokens, block["single"])))
    if not len(candidates):
        return none, none
    array = SuffixArray.build(tokens, bounds, candidates, window)
    there = np.unique(array.keys[:, 0])
    first = block["rows"][:, 0]
    asked = np.flatnonzero(there[np.minimum(np.searchsorted(there, first), len(there) - 1)] == first)
    if not len(asked):
        return none, none
    low, high = array.ranges(block["rows"][asked], block["size"][asked])
    n = high - low
    total = np.cumsum(n)
    which = np.repeat(asked, n)
    place = array.at[np.repeat(low - total + n, n) + np.arange(total[-1])]
    return which, place


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of entries whose sizes add up to about ``most``."""
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def _uses(which: np.ndarray, place: np.ndarray, block: dict[str, np.ndarray], most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document place, item, place in the item) of all pairs of a match and a use of its window, in parts of about ``most``."""
    use_at = np.asarray(block["use_at"])
    n = use_at[which + 1] - use_at[which]
    for a, b in _slices(n, most):
        # one match with very many uses is cut as well
        for first in range(0, int(n[a:b].max()), most):
            some = np.clip(n[a:b] - first, 0, most)
            at = np.repeat(use_at[which[a:b]] + first - np.cumsum(some) + some, some) + np.arange(some.sum())
            yield np.repeat(place[a:b], some), block["owner"][at], block["place"][at]


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]), dtype=np.uint64)


def _sums(tokens: np.ndarray, power: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * power[: len(tokens)], dtype=np.uint64)])


def _follow(tokens: np.ndarray, bounds: np.ndarray, block: dict[str, np.ndarray], place: np.ndarray, item: np.ndarray, inside: np.ndarray, sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of the matches that begin at pairs of a document place and a place in an item.

    Word hashes are summed with powers of an odd base, so equal runs have sums that differ by a power."""
    own, test = np.asarray(block["words"]), np.asarray(block["bounds"])
    there = test[item] + inside
    before = (inside > 0) & (place > bounds[np.searchsorted(bounds, place, "right") - 1])
    before[before] = tokens[place[before] - 1] == own[there[before] - 1]
    place, item, there = place[~before], item[~before], there[~before]
    mine, theirs, power = sums
    low = np.ones(len(place), np.int64)
    high = np.minimum(bounds[np.searchsorted(bounds, place, "right")] - place, test[item + 1] - there)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_] + 1) // 2
        a, b = place[open_], there[open_]
        same = (mine[a + mid] - mine[a]) * power[b] == (theirs[b + mid] - theirs[b]) * power[a]
        low[open_[same]] = mid[same]
        high[open_[~same]] = mid[~same] - 1
    return place, low


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Contamination of each row of docs; longest: words of its longest verbatim match of a window or more, from word longest_at on (-1: none)."""
    return _judge(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, window, share)


def _judge(docs: DataFrame, benchmark: DataFrame, window: int, share: int) -> DataFrame:
    """judge() of a table of a number and a text."""
    folders = write_blocks(benchmark, window)

    def load(folder: str) -> dict[str, np.ndarray]:
        return {n: np.load(f"{folder}/{n}.npy", mmap_mode="r") for n in ("rows", "size", "use_at", "owner", "place", "pairs", "single", "words", "bounds", "ids")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [load(folder) for folder in folders]
        # one filter of word pairs for all blocks
        bits = np.zeros(1 << 22, dtype=bool)
        for block in blocks:
            bits[np.asarray(block["pairs"]) >> np.uint64(64 - 22)] = True
        for batch in batches:
            for row, end, buf, off in chunks(batch.column(1)):
                tokens, bounds = words(buf, off)
                n_docs = end - row
                cover = np.zeros(len(tokens) + 1, np.int64)
                items: dict[int, set[str]] = {}
                longest, longest_at = np.zeros(n_docs, np.int64), np.full(n_docs, -1, np.int64)
                for block in blocks:
                    which, place = _matches(tokens, bounds, block, bits, window)
                    if not len(which):
                        continue
                    np.add.at(cover, place, 1)
                    np.add.at(cover, place + np.asarray(block["size"])[which], -1)
                    power = _powers(max(len(tokens), len(block["words"])) + 1)
                    sums = _sums(tokens, power), _sums(np.asarray(block["words"]), power), power
                    for at, item, inside in _uses(which, place, block):
                        own = np.searchsorted(bounds, at, "right") - 1
                        for d, o in np.unique(np.stack([own, item], axis=1), axis=0).tolist():
                            items.setdefault(d, set()).add(block["ids"][o].decode())
                        start, length = _follow(tokens, bounds, block, at, item, inside, sums)
                        own = np.searchsorted(bounds, start, "right") - 1
                        # the longest of each document, its first place on a tie
                        order = np.lexsort((start, -length, own))
                        best = order[np.append(True, own[order][1:] != own[order][:-1])] if len(order) else order
                        d, new, at = own[best], length[best], start[best] - bounds[own[best]]
                        better = (new > longest[d]) | ((new == longest[d]) & (at < longest_at[d]))
                        longest[d[better]], longest_at[d[better]] = new[better], at[better]
                hit = np.cumsum(cover[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                n_words, n_hit = np.diff(bounds), np.diff(total[bounds])
                lists = [sorted(items.get(i, ())) for i in range(n_docs)]
                sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n_docs), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in lists], pa.int64()), pa.array(sha), pa.array((n_hit > 0) & (share * n_hit >= n_words)), pa.array(longest, pa.int64()), pa.array(longest_at, pa.int64())],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_at"],
                )

    return docs.mapInArrow(run, OUT)


def without_tests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline form: the rows of docs that are not contaminated."""
    rows = with_rows(docs)
    judged = _judge(rows.select(F.col("row").alias("doc_id"), F.col("own.text").alias("text")), benchmark, WINDOW, SHARE)
    bad = judged.where("contaminated").select(F.col("doc_id").alias("row"))
    return rows.join(bad, "row", "left_anti").select("own.*")
