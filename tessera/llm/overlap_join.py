"""Similarity join on sets of word shingles by T-occurrence search (DivideSkip), exact at any Jaccard threshold of tenths.

1. Documents with one set of shingles are one set: a row number stands for it.
2. Which sets can link. Sets that link share at least T shingles, so under any order of all shingles (here
   that of their hashes) their first n - T + l share at least l. Each set sends its first 2 (n - T) + 1
   hashes; hashes that no other set sent are dropped, and so are sets left with fewer than the l that a
   partner of the least size would share. Common passages alone never keep a set.
3. Sets that share one of their first n - T + 1 hashes meet: each hash names the least row among its sets,
   and sets gather under the rows so named, with their first hashes only. Those of which l are common are
   candidates of each other; their components are closed under links, so each set is in one family.
4. Families meet with their whole sets, each of which travels once.
5. A meeting, both times, is a T-occurrence search in a cell: an inverted list for each hash; a set asks for
   all others that are on at least T of its lists. The longest lists are left aside (as many as DivideSkip's
   rule says), the others are merged from a heap, shortest first, and what is on enough of them is looked up
   in the long lists by binary search. Sets already in one component are not compared again: they need no
   further link to be of one component.
6. Small gatherings share a cell; one that is larger than a cell is split into blocks, and what then stands
   outside its largest component asks all other blocks in the same way, in groups that fit a cell.
7. A component of links is named by its least doc_id.

A shingle is a 64-bit hash of its words, within a cell its upper 48 bits; sets are told apart by 128 bits.

Defined cases: null and wordless texts have no shingles and link with nothing; a text of fewer words than a
shingle is one shingle; rows with equal sets link whatever their doc_id; rows of one doc_id are documents of
their own; a component's name is null if none of its documents has an id. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bytetext import LOWER, NON_SPACE, chunks, docs_of, hash_spans, mix, spans
from tessera.llm.components import components
from tessera.llm.near_dedup import squeeze, unsqueeze
from tessera.llm.staging import stage, with_rows

#: Shingles of a cell, about: bounds the memory of a task.
CELL = 2_000_000
#: Row numbers up to this many (8 bytes each) are broadcast, more are joined by a shuffle.
MOST_SENT = 4_000_000
#: Bytes of text that are cut into shingles at a time.
RUN = 2 << 20
#: The weight of DivideSkip's rule for the number of long lists (Li, Lu and Lu, 2008).
MU = 0.0085
SET = "row long, n long, load long, keys binary"


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    low = LOWER[buf]
    start, stop = spans(low, off, NON_SPACE)
    bounds = docs_of(start, off).tolist()
    word = hash_spans(low, start, stop) if len(start) else np.zeros(0, np.uint64)
    h = word.copy()
    for k in range(1, size):
        h[:-k] = mix(h[:-k], word[k:])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(h[a : b - size + 1]))
            continue
        short = word[a : a + 1]
        for w in range(a + 1, b):
            short = mix(short, word[w : w + 1])
        out.append(mix(short, np.full(len(short), b - a, np.uint64)))
    return out


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for low, high, buf, off in chunks(batch.column(at), RUN):
            yield batch.slice(low, high - low), shingle_sets(buf, off, size)


class Overlap:
    """What whole sets must share to reach a threshold of ``tenths`` in ten."""

    def __init__(self, tenths: int) -> None:
        self.tenths = tenths

    def least_partner(self, n: int) -> int:
        return -(-self.tenths * n // 10)

    def spare(self, n: np.ndarray | int) -> np.ndarray | int:
        """Shingles that a set may have beside those of a partner."""
        return n - -(-self.tenths * n // 10)

    def needed(self, n: int, m: np.ndarray | int) -> np.ndarray | int:
        """Least number of common shingles of linked sets of n and m."""
        return -(-self.tenths * (n + m) // (10 + self.tenths))

    def least(self, n: int) -> int:
        """The least that any partner of n needs."""
        return int(self.needed(n, self.least_partner(n)))


class FirstOverlap(Overlap):
    """What the first hashes of sets must share, if the sets link."""

    def needed(self, n: int, m: np.ndarray | int) -> np.ndarray | int:
        return self.spare(np.minimum(n, m)) + 1


class Cell:
    """Inverted lists of some sets of hashes, of which each stands for a set of ``sizes``, and the links between them."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], rule: Overlap, comps: np.ndarray | None = None) -> None:
        self.rows, self.sets, self.sizes, self.rule = rows, sets, sizes, rule
        flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        member = np.repeat(np.arange(len(sets), dtype=np.int64), [len(x) for x in sets])
        by = np.argsort(flat, kind="stable")
        flat, self.members = flat[by], member[by]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
        self.keys, self.starts, self.ends = flat[first], first, np.append(first[1:], len(flat))
        #: Places of the lists: (list, member) in one sorted array for binary search.
        self.places = np.repeat(np.arange(len(first), dtype=np.int64), self.ends - self.starts) * max(1, len(sets)) + self.members
        #: Names of known components, and the place of each member's own.
        self.names, self.comp = np.unique(rows if comps is None else comps, return_inverse=True)
        self.n_comps = len(self.names)

    def merged(self, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Members of sorted lists and on how many they are: lists are taken from a heap, shortest first, and merged in pairs."""
        heap = [(len(x), k, x) for k, x in enumerate(lists)]
        heapq.heapify(heap)
        while len(heap) > 1:
            (_, _, x), (_, k, y) = heapq.heappop(heap), heapq.heappop(heap)
            both = np.concatenate([x, y])
            both.sort(kind="stable")  # merges two sorted runs
            heapq.heappush(heap, (len(both), k, both))
        if not heap:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole = heap[0][2]
        first = np.flatnonzero(np.append(True, whole[1:] != whole[:-1]))
        return whole[first], np.diff(np.append(first, len(whole)))

    def search(self, n: int, keys: np.ndarray, alone: int, wanted: np.ndarray) -> np.ndarray:
        """Members that reach the required overlap with a set of n, of those marked as wanted. Lists of up to ``alone`` members have none to find."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        at = at[self.keys[at] == keys]
        length = self.ends[at] - self.starts[at]
        at, length = at[length > alone], length[length > alone]
        least = self.rule.least(n)
        if len(at) < least:
            return np.zeros(0, np.int64)
        by = np.argsort(length, kind="stable")
        at, length = at[by], length[by]
        n_long = min(least - 1, int(least / (MU * math.log2(max(2, int(length[-1]))) + 1)))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        found, count = self.merged([self.members[a:b] for a, b in zip(self.starts[short].tolist(), self.ends[short].tolist(), strict=True)])
        size = self.sizes[found]
        need, lower, upper = self.rule.needed(n, size), np.minimum(n, size), np.maximum(n, size)
        keep = (count + n_long >= need) & (10 * lower >= self.rule.tenths * upper) & wanted[found]
        found, count, need = found[keep], count[keep], need[keep]
        step = max(1, CELL // max(1, n_long))
        for a in range(0, len(found), step):
            probe = (long * len(self.sets))[None, :] + found[a : a + step, None]
            place = np.searchsorted(self.places, probe.ravel())
            place[place == len(self.places)] = 0
            count[a : a + step] += (self.places[place] == probe.ravel()).reshape(probe.shape).sum(1)
        return found[count >= need]

    def join(self, kept: int, found: np.ndarray) -> list[int]:
        """Put the components of found into that of kept; one link is returned for each."""
        links = []
        for x in found.tolist():
            if self.comp[x] != self.comp[kept]:
                self.comp[self.comp == self.comp[x]] = self.comp[kept]
                self.n_comps -= 1
                links.append(x)
        return links

    def links(self, leader: int | None = None) -> list[tuple[int, int]]:
        """Links (row, row) that connect the components of the cell; ``leader`` asks first."""
        out, waiting = [], np.ones(len(self.sets), bool)
        asking = sorted(range(len(self.sets)), key=lambda x: self.rows[x] != leader)
        for x in asking:
            if self.n_comps == 1:
                break
            waiting[x] = False
            out += [(int(self.rows[x]), int(self.rows[y])) for y in self.join(x, self.search(int(self.sizes[x]), self.sets[x], 1, waiting & (self.comp != self.comp[x])))]
        return out


def _short(keys: np.ndarray) -> bytes:
    return squeeze(keys >> np.uint64(16))


def _first_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.sort(x.values.to_numpy().view(np.uint64)) for x in batch.column("keys")]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), pa.array([len(k) for k in keys], pa.int64()), pa.array([_short(k) for k in keys], pa.binary())], ["row", "n", "load", "keys"])


def _link_table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({c: pa.array([x[k] for x in links], pa.int64()) for k, c in enumerate("ab")})


def _cell(group: pa.Table, rule: Overlap) -> Cell:
    sets = [unsqueeze(x) for x in group.column("keys").to_pylist()]
    return Cell(group.column("row").to_numpy(), group.column("n").to_numpy(), sets, rule, group.column("c").to_numpy())


def _met(met: DataFrame, sets: DataFrame, rule: Overlap, cell: int) -> DataFrame:
    """(node, component) of the sets that are linked by the rule, among those that gather as (lead, row); sets are SET rows."""
    loads = met.join(sets.select("row", "load"), "row").groupBy("lead").agg(F.sum("load").alias("load"), F.count("*").alias("n")).where("n > 1")
    loads = stage(loads.withColumn("blocks", F.when(F.col("load") > cell, F.ceil(F.col("load") * 2 / cell)).otherwise(0).cast("int")), "loads")
    total, most = loads.agg(F.coalesce(F.sum(F.when(F.col("blocks") == 0, F.col("load"))), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(0))).first()
    bins = max(1, -(-2 * total // cell))
    # a cell holds a bin of small gatherings (lead -1), or a block of a large one together with its lead
    large = F.col("blocks") > 0
    of_row = F.pmod(F.xxhash64("row"), F.when(large, F.col("blocks")).otherwise(1))
    placed = met.join(loads, "lead").select("lead", "row", "blocks", F.when(large, of_row).otherwise(F.pmod(F.xxhash64("lead"), F.lit(bins))).cast("int").alias("block"))
    each_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    leads = loads.where(large).select("lead", each_block, F.col("lead").alias("row"))
    dealt = stage(placed.select(F.when(large, F.col("lead")).otherwise(-1).alias("lead"), "block", "row").union(leads).distinct(), "cells")

    def within(group: pa.Table) -> pa.Table:
        return _link_table(_cell(group, rule).links(group.column("lead")[0].as_py()))

    cells = dealt.withColumn("c", F.col("row")).join(sets.select("row", "n", "keys"), "row")
    links = stage(cells.groupBy("lead", "block").applyInArrow(within, "a long, b long"), "links")
    comp = stage(components(links), "components")
    if most:
        links = stage(links.union(_across(dealt, loads.where(large), comp, sets, rule, cell)), "links")
        comp = stage(components(links), "components")
    return comp


def _across(dealt: DataFrame, large: DataFrame, comp: DataFrame, sets: DataFrame, rule: Overlap, cell: int) -> DataFrame:
    """Links between the blocks of large gatherings: what stands outside the largest component asks all other blocks."""
    block = dealt.where("lead >= 0").join(comp, F.col("row") == F.col("node"), "left").select("lead", "block", "row", F.coalesce("component", "row").alias("c"))
    block = stage(block, "blocks")
    largest = block.groupBy("lead", "c").agg(F.count_distinct("row").alias("k")).groupBy("lead").agg(F.max(F.struct("k", "c"))["c"].alias("top"))
    outside = block.join(largest, "lead").where("c <> top").select("lead", "row", F.col("block").alias("home"), "c").distinct()
    chunk = F.ceil(F.sum("load").over(Window.partitionBy("lead")) * 2 / cell)
    asked = outside.join(sets.select("row", "load"), "row").select("lead", "row", "home", "c", F.pmod(F.xxhash64("row", F.lit(1)), chunk).cast("int").alias("chunk"))
    each_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    asks = stage(asked, "outside").join(large.select("lead", "blocks"), "lead").select("lead", each_block, "chunk", "row", "home", "c").where("home <> block")
    asks = asks.select("lead", "block", "chunk", "row", "c", F.lit(True).alias("asks")).distinct()
    answers = asks.select("lead", "block", "chunk").distinct().join(block, ["lead", "block"]).select("lead", "block", "chunk", "row", "c", F.lit(False).alias("asks"))

    def across(group: pa.Table) -> pa.Table:
        asking = group.column("asks").to_numpy(zero_copy_only=False)
        held, questions, out = _cell(group.filter(pa.array(~asking)), rule), group.filter(pa.array(asking)), []
        for row, own, n, keys in zip(*(questions.column(k).to_pylist() for k in ("row", "c", "n", "keys")), strict=True):
            got = held.search(n, unsqueeze(keys), 0, held.names[held.comp] != own)
            # one link for each component that is found
            out += [(row, int(held.rows[y])) for y in got[np.unique(held.comp[got], return_index=True)[1]].tolist()]
        return _link_table(out)

    return asks.union(answers).join(sets.select("row", "n", "keys"), "row").groupBy("lead", "block", "chunk").applyInArrow(across, "a long, b long")


def similar_sets(docs: DataFrame, size: int = 3, tenths: int = 9, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    rule = Overlap(tenths)
    base = with_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    texts = base.select("row", F.col("own.doc_id").alias("doc_id"), F.col("own.text").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, size):
            n = [len(s) for s in sets]
            first = [s[: 2 * rule.spare(k) + 1] for s, k in zip(sets, n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array([int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets], pa.int64()),
                    pa.array([int(mix(s, s).sum(dtype=np.uint64).astype(np.int64)) for s in sets], pa.int64()), pa.array([rule.spare(k) + 1 for k in n], pa.int32()),
                    pa.array([rule.spare(rule.least_partner(k)) + 1 for k in n], pa.int32()), pa.array([s.view(np.int64) for s in first], pa.list_(pa.int64())),
                ],
                ["row", "doc_id", "n", "h1", "h2", "short", "need", "first"],
            )

    sketched = stage(texts.mapInArrow(sketch, "row long, doc_id long, n long, h1 long, h2 long, short int, need int, first array<long>"), "sketches")
    sets = stage(sketched.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least")), "sets")
    copies = sketched.where("n > 0").select("row").join(sets.select(F.col("rep").alias("row")), "row", "left_anti")
    copies = stage(copies, "copies")
    copies = F.broadcast(copies) if copies.count() <= MOST_SENT else copies
    keyed = sketched.where("n > 0").join(copies, "row", "left_anti").select("row", "n", "short", "need", F.posexplode("first").alias("place", "key"))
    keyed = keyed.select("key", "row", "n", "need", (F.col("place") < F.col("short")).alias("early"))
    of_key = Window.partitionBy("key")
    shared = keyed.withColumns({"lo": F.min("row").over(of_key), "hi": F.max("row").over(of_key)}).where("lo < hi").drop("lo", "hi")
    for turn in range(2):  # the second time, hashes that only dropped sets shared go too
        shared = stage(shared, "shared")
        stay = shared.groupBy("row").agg(F.count("*").alias("has"), F.max("need").alias("need")).where("has >= need").select("row")
        shared = shared.join(stay, "row", "left_semi")
        if turn:
            shared = stage(shared, "shared")
        else:
            shared = shared.withColumns({"lo": F.min("row").over(of_key), "hi": F.max("row").over(of_key)}).where("lo < hi").drop("lo", "hi")
    first = stage(shared.groupBy("row", "n").agg(F.collect_list("key").alias("keys")).mapInArrow(_first_hashes, SET), "first-hashes")
    lead = {"lead": F.min("row").over(of_key), "hi": F.max("row").over(of_key)}
    early = shared.where("early").withColumns(lead).where("lead < hi").select("lead", "row").distinct()
    families = _met(stage(early, "gatherings"), first, FirstOverlap(tenths), cell)

    meeting = families.select(F.col("node").alias("row"))
    meeting = F.broadcast(meeting) if meeting.count() <= MOST_SENT else meeting

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _sets(batches, size):
            n = pa.array([len(s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), n, n, pa.array([_short(s) for s in found], pa.binary())], ["row", "n", "load", "keys"])

    whole = stage(texts.join(meeting, "row", "left_semi").select("row", "text").mapInArrow(full, SET), "whole-sets")
    comp = _met(families.select(F.col("component").alias("lead"), F.col("node").alias("row")), whole, rule, cell)

    named = sets.join(comp, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.col("n").alias("size"), "least", F.coalesce("component", "rep").alias("c"))
    named = stage(named, "named")
    names = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(names, "c").select("h1", "h2", F.col("size").alias("n"), "component_id")
    back = sketched.where("n > 0").select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return back.union(sketched.where("n = 0").select("doc_id", "n", "doc_id"))
