"""LM scoring: an Elias-Fano n-gram trie, sharded, memory-mapped, with quantised smoothed probabilities.

Model: words and an end token, orders 1 to 3, interpolated absolute discounting over the add-half
unigram distribution. Counting and building cover all training texts, every n-gram stays, and the model
grows with them.

Levels, each cut into shards by a hash of the context, so that no task builds or holds the whole:
  words     sorted 64-bit hashes of distinct words (Elias-Fano) and their counts; a word's id is its rank
  bigrams   contexts v with pointers to their successors w
  trigrams  contexts (u, v) with pointers to their successors w
A level of successors is one monotone Elias-Fano sequence: context rank times the number of words
plus successor id; the pointers of contexts are monotone too. A look-up finds the context's rank,
then searches the successor relative to it: high bits give the bucket by a select on the bit vector,
low bits are compared within. Discounted probabilities of successors and back-off weights of contexts are
16-bit codes of log10 on a grid of ``GRID`` steps; a token's probability is its own share plus the
back-off weight times its probability one order down. Every token but an end has one successor, so a
context's occurrences are the sum of its successors' counts, and both levels are built from one pass.

Every shard is one file in the shared folder, written under another name and renamed: a repeated or
speculative task writes the same file again. A manifest names the shards that there are; a file of it that
is missing is an error. Tasks map the files and read the pages that they touch.

Defined cases: null text is empty and scores its end token; repeated rows are scored each, and learnt
as often, whatever their doc_id; without training texts every token is unknown, and all scores are those
of the base model. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytetext import LOWER, NON_SPACE, chunks, docs_of, hash_spans, mix, spans
from tessera.llm.near_dedup import _pack, _unpack, squeeze, unsqueeze
from tessera.llm.staging import drop, local_path, new_path, stage

END = np.uint64(0x5EED0E5D0E5D0001)
DISCOUNT = 0.75
GRID = 4096.0
ID_BITS = 32
OUT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


# --- Elias-Fano ------------------------------------------------------------------------------------


def ef_arrays(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """High bits as a unary bit vector with its directory of zeros, low bits as packed bytes."""
    n = len(values)
    most = min(56, max(0, int(universe // max(n, 1)).bit_length() - 1))
    # low bits take whole bytes, so fewer of them with more high bits can be smaller
    low_bits = min((most, most // 8 * 8), key=lambda b: 8 * -(-b // 8) * n + 1.5 * (n + (universe >> b)))
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    top = int(universe >> low_bits) + 1
    bits = np.zeros(n + top + 1, np.uint8)
    bits[high + np.arange(n)] = 1
    packed = np.packbits(bits, bitorder="little")
    packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)])
    words = packed.view("<u8")
    zeros = 64 - np.bitwise_count(words).astype(np.int64)
    directory = np.concatenate([[0], np.cumsum(zeros)]).astype(np.uint32 if n + top < 1 << 31 else np.int64)
    width = (low_bits + 7) // 8
    low = (values & np.uint64((1 << low_bits) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    # low bits stand in whole bytes: a byte more at most, and no shifts to read them
    return {"bits": words, "zeros": directory, "low": np.concatenate([np.ascontiguousarray(low).ravel(), np.zeros(8, np.uint8)]), "meta": np.array([n, low_bits, top], np.int64)}


_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Place of the k-th one of each byte.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


class EliasFano:
    """A monotone sequence that answers where values stand, many at a time."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.bits, self.zeros, self.low = arrays["bits"], arrays["zeros"], arrays["low"]
        self.n, self.low_bits, self.top = (int(x) for x in arrays["meta"])
        self.width = (self.low_bits + 7) // 8
        self.mask = np.uint64((1 << self.low_bits) - 1)
        self.lows = np.ndarray(shape=(max(1, self.n),), dtype="<u8", buffer=self.low, strides=(self.width,)) if self.width else np.zeros(max(1, self.n), np.uint64)
        self.low_mask = np.uint64((1 << (8 * self.width)) - 1) if self.width < 8 else np.uint64(0xFFFFFFFFFFFFFFFF)

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero (from 0) of the bit vector: its word by the directory, its byte by sums of bytes."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        left = (k - self.zeros[word]).astype(np.uint64)
        x = ~self.bits[word]
        sums = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
        sums = (sums & np.uint64(0x3333333333333333)) + ((sums >> np.uint64(2)) & np.uint64(0x3333333333333333))
        sums = ((sums + (sums >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
        # bytes up to which there are no more than left
        byte = np.bitwise_count((((left * _BYTES) | _TOPS) - sums) & _TOPS).astype(np.uint64) * np.uint64(8)
        left -= ((sums << np.uint64(8)) >> byte) & np.uint64(255)
        return word * 64 + byte.astype(np.int64) + _IN_BYTE[((x >> byte) & np.uint64(255)).astype(np.int64), left.astype(np.int64)]

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end index of the values with these high bits."""
        at = np.where(high > 0, self._select_zero(np.maximum(high - 1, 0)) + 1, 0)
        start = at - high
        # ones from there on, as far as the word goes
        inside = (at & 63).astype(np.uint64)
        run = self.bits[at >> 6] >> inside
        ones = np.bitwise_count(run & ~(run + np.uint64(1))).astype(np.int64)
        end = start + ones
        over = np.flatnonzero(ones + inside.astype(np.int64) >= 64)
        if len(over):
            end[over] = self._select_zero(high[over]) - high[over]
        return start, end

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value of x, or -1: the bucket of its high bits, then a search of the low bits."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        rows = np.flatnonzero(high < self.top)
        low, end = self._bucket(high[rows])
        some = np.flatnonzero(low < end)
        rows, low, end = rows[some], low[some], end[some]
        want = x[rows] & self.mask
        while len(rows):
            mid = (low + end) >> 1
            here = self.lows[mid] & self.low_mask
            equal = here == want
            out[rows[equal]] = mid[equal]
            less = here < want
            low = np.where(less, mid + 1, low)
            end = np.where(less, end, mid)
            some = np.flatnonzero((low < end) & ~equal)
            rows, low, end, want = rows[some], low[some], end[some], want[some]
        return out


def code(log10: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-log10 * GRID), 65535).astype(np.uint16)


def value(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / -GRID


# --- Files -----------------------------------------------------------------------------------------


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of aligned arrays, in place at once."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = [a.dtype.str, int(a.size), at]
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    start = -(-(8 + len(text)) // 64) * 64
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as file:
        file.write(len(text).to_bytes(8, "little") + text)
        for name, a in arrays.items():
            file.seek(start + head[name][2])
            file.write(np.ascontiguousarray(a).tobytes())
        file.truncate(start + at + 64)
    os.replace(own, path)


def load(path: str) -> dict[str, np.ndarray]:
    whole = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(whole[:8].tobytes(), "little")
    head = json.loads(whole[8 : 8 + size].tobytes())
    start = -(-(8 + size) // 64) * 64
    return {name: np.ndarray(shape=(n,), dtype=dtype, buffer=whole, offset=start + at) for name, (dtype, n, at) in head.items()}


def _sub(arrays: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {k[len(prefix) :]: v for k, v in arrays.items() if k.startswith(prefix)}


# --- Tokens ----------------------------------------------------------------------------------------


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words with an end token after each text, and the offsets of texts."""
    low = LOWER[buf]
    start, stop = spans(low, off, NON_SPACE)
    bounds = docs_of(start, off)
    n = len(off) - 1
    out = np.empty(len(start) + n, np.uint64)
    if len(start):
        out[np.arange(len(start)) + np.repeat(np.arange(n), np.diff(bounds))] = hash_spans(low, start, stop)
    ends = bounds + np.arange(n + 1)
    out[ends[1:] - 1] = END
    return out, ends


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each context key."""
    return ((mix(keys, np.full(len(keys), 77, np.uint64)) >> np.uint64(33)).astype(np.int64) % shards).astype(np.uint16 if shards <= 1 << 16 else np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin."""
    new = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(np.ones(min(1, len(columns[0])), bool), new))


def _sizes(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


class Words:
    """The level of words: id and count of hashes."""

    def __init__(self, folder: str, meta: dict):
        self.folder, self.meta, n = folder, meta, meta["shards"]
        manifest = load(f"{folder}/manifest")
        self.base, self.size = manifest["word_base"], manifest["word_size"]
        self.edges = np.array([(b << 64) // n for b in range(1, n)], np.uint64)
        self.open: dict[int, tuple[EliasFano, np.ndarray]] = {}

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted distinct hashes: id (-1: unknown) and count. Ids are in the order of hashes."""
        n = self.meta["shards"]
        out, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        cuts = [0, *np.searchsorted(h, self.edges).tolist(), len(h)]
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b and self.size[i]:
                if i not in self.open:
                    arrays = load(f"{self.folder}/words-{i}")
                    self.open[i] = EliasFano(_sub(arrays, "ef_")), arrays["count"]
                ef, counts = self.open[i]
                at = ef.find(h[a:b] - np.uint64((i << 64) // n))
                known = np.flatnonzero(at >= 0)
                out[a + known] = at[known] + self.base[i]
                count[a + known] = counts[at[known]]
        return out, count

    def base_p(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.meta["n"] + 0.5 * (self.meta["v"] + 1))


class Level:
    """Successors of contexts: sorted context keys, pointers, successor ids, codes."""

    def __init__(self, folder: str, order: int, meta: dict):
        self.folder, self.order, self.shards, self.words = folder, order, meta["shards"], meta["v"]
        self.there = load(f"{folder}/manifest")[f"order{order}"]
        self.open: dict[int, tuple] = {}

    def _shard(self, i: int) -> tuple:
        if i not in self.open:
            a = load(f"{self.folder}/order{self.order}-{i}")
            self.open[i] = (EliasFano(_sub(a, "ctx_")), EliasFano(_sub(a, "succ_")), a["prob"], a["back"])
        return self.open[i]

    def look(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(discounted probability or 0, back-off weight or 1) of context keys and successor ids (-1: unknown), in order of both."""
        p, back = np.zeros(len(context)), np.ones(len(context))
        first = _starts(context)
        shard = np.repeat(_shard_of(context[first], self.shards), _sizes(first, len(context)))
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for i in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            if not self.there[i]:
                continue
            rows = order[cuts[i] : cuts[i + 1]]
            contexts, successors, probs, backs = self._shard(i)
            own = context[rows]
            first = _starts(own)
            rank = np.repeat(contexts.find(own[first]), _sizes(first, len(own)))
            rows, rank = rows[rank >= 0], rank[rank >= 0]
            back[rows] = 10 ** value(backs[rank])
            known = word[rows] >= 0
            rows, rank = rows[known], rank[known]
            at = successors.find(rank.astype(np.uint64) * np.uint64(self.words) + word[rows].astype(np.uint64))
            p[rows[at >= 0]] = 10 ** value(probs[at[at >= 0]])
        return p, back


def _level_arrays(context: np.ndarray, word: np.ndarray, count: np.ndarray, words: int, universe: int) -> dict[str, np.ndarray]:
    """Arrays of one shard from its n-grams in order of context and word."""
    first = _starts(context)
    size = _sizes(first, len(context))
    rank = np.repeat(np.arange(len(first)), size)
    total = np.add.reduceat(count, first)
    ctx = ef_arrays(context[first], universe)
    succ = ef_arrays(rank.astype(np.uint64) * np.uint64(words) + word.astype(np.uint64), max(1, len(first) * words))
    return {f"ctx_{k}": v for k, v in ctx.items()} | {f"succ_{k}": v for k, v in succ.items()} | {"prob": code(np.log10((count - DISCOUNT) / total[rank])), "back": code(np.log10(DISCOUNT * size / total))}


# --- Building --------------------------------------------------------------------------------------


def _merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) of the blobs of a group in order, with the sums of their counts."""
    context = np.concatenate([unsqueeze(x) for x in group.column("keys").to_pylist()])
    word = np.concatenate([_unpack(x) for x in group.column("words").to_pylist()])
    count = np.concatenate([_unpack(x) for x in group.column("counts").to_pylist()])
    distinct, rank = np.unique(context, return_inverse=True)
    del context
    key = rank.astype(np.uint64) << np.uint64(ID_BITS) | word
    del rank, word
    order = np.argsort(key)
    key = key[order]
    first = _starts(key)
    count = np.add.reduceat(count[order], first, dtype=np.int64)
    key = key[first]
    return distinct[(key >> np.uint64(ID_BITS)).astype(np.int64)], (key & np.uint64((1 << ID_BITS) - 1)).astype(np.int64), count


def _blobs(order: int, context: np.ndarray, word: np.ndarray, count: np.ndarray, shards: int) -> pa.RecordBatch:
    """A row per shard of n-grams that are in order of context and word."""
    first = _starts(context)
    shard = np.repeat(_shard_of(context[first], shards), _sizes(first, len(context)))
    by = np.argsort(shard, kind="stable")
    context, word, count = context[by], word[by], count[by]
    cuts = np.searchsorted(shard[by], np.arange(shards + 1))
    some = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
    parts = [slice(cuts[i], cuts[i + 1]) for i in some]
    return pa.RecordBatch.from_arrays(
        [pa.array([order] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([squeeze(context[p]) for p in parts], pa.binary()), pa.array([_pack(word[p]) for p in parts], pa.binary()), pa.array([_pack(count[p]) for p in parts], pa.binary())],
        names=["order", "shard", "keys", "words", "counts"],
    )


def _ngrams(local: np.ndarray, ends: np.ndarray, n_local: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Distinct bigrams (v, w, count) and trigrams (u, v, w, count) of texts of local word numbers, in order."""
    inner = np.ones(len(local), bool)
    inner[ends[:-1]] = False
    at = np.flatnonzero(inner)
    d = np.uint64(max(1, n_local))
    pair = local[at - 1].astype(np.uint64) * d + local[at].astype(np.uint64)
    # both tokens before are of the same text
    second = inner[at - 1]
    if n_local < 1 << 21:
        triple = local[at[second] - 2].astype(np.uint64) * d * d + pair[second]
        triple.sort()
        first = _starts(triple)
        times3, head = _sizes(first, len(triple)), triple[first] // d
        last = triple[first] - head * d
    else:  # the words of a very long text: numbers of its pairs in place of two words
        keys, number = np.unique(local[at[second] - 2].astype(np.uint64) * d + local[at[second] - 1].astype(np.uint64), return_inverse=True)
        triple = number.astype(np.uint64) * d + local[at[second]].astype(np.uint64)
        triple.sort()
        first = _starts(triple)
        times3, head = _sizes(first, len(triple)), keys[(triple[first] // d).astype(np.int64)]
        last = triple[first] % d
    pair.sort()
    first = _starts(pair)
    pairs, times2 = pair[first], _sizes(first, len(pair))
    v = pairs // d
    u3 = head // d
    return (v, pairs - v * d, times2), (u3, head - u3 * d, last, times3)


class Trie:
    """build() learns from texts; score() scores texts; drop() deletes the files."""

    def __init__(self, folder: str, meta: dict):
        self.folder, self.meta = folder, meta

    @classmethod
    def build(cls, texts: DataFrame, shard_tokens: int = 3_000_000) -> Trie:
        """texts: a column text."""
        spark = texts.sparkSession
        folder = local_path(new_path(spark, "trie"))
        os.makedirs(folder)
        texts = texts.select(F.col("text").cast("string").alias("text"))
        chars = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(1, -(-chars // (6 * shard_tokens)))
        meta = {"shards": shards, "n": 0, "v": 0}

        # unigrams, cut by ranges of the hash
        def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges = np.array([(b << 64) // shards for b in range(1, shards)], np.uint64)
            for batch in batches:
                for _, _, buf, off in chunks(batch.column(0), 8 << 20):
                    found, _ = tokens(buf, off)
                    found.sort()
                    first = _starts(found)
                    keys, counts = found[first], _sizes(first, len(found))
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    some = [i for i in range(shards) if cuts[i] < cuts[i + 1]]
                    parts = [slice(cuts[i], cuts[i + 1]) for i in some]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([squeeze(keys[p]) for p in parts], pa.binary()), pa.array([_pack(counts[p]) for p in parts], pa.binary())], names=["shard", "keys", "counts"])

        def build_words(group: pa.Table) -> pa.Table:
            i = group.column("shard")[0].as_py()
            keys = np.concatenate([unsqueeze(x) for x in group.column("keys").to_pylist()])
            counts = np.concatenate([_unpack(x) for x in group.column("counts").to_pylist()]).astype(np.int64)
            order = np.argsort(keys)
            keys = keys[order]
            first = _starts(keys)
            counts, keys = np.add.reduceat(counts[order], first), keys[first]
            start = (i << 64) // shards
            save(f"{folder}/words-{i}", {f"ef_{k}": v for k, v in ef_arrays(keys - np.uint64(start), ((i + 1) << 64) // shards - start).items()} | {"count": counts.astype(np.uint32) if counts.max() < 1 << 32 else counts})
            return pa.table({"shard": pa.array([i], pa.int32()), "n": pa.array([int(counts.sum())], pa.int64()), "v": pa.array([len(keys)], pa.int64())})

        size = np.zeros(shards, np.int64)
        # three numbers a shard reach the driver
        built = stage(texts.mapInArrow(unigrams, "shard int, keys binary, counts binary").groupBy("shard").applyInArrow(build_words, "shard int, n long, v long"), "trie-words").toArrow()
        size[built.column("shard").to_numpy()] = built.column("v").to_numpy()
        meta["n"] = int(built.column("n").to_numpy().sum())
        meta["v"] = int(size.sum())
        if meta["v"] >= 1 << (ID_BITS - 1):
            raise ValueError("more distinct words than ids")
        manifest = {"word_base": np.cumsum(size) - size, "word_size": size}
        save(f"{folder}/manifest", manifest)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Words(folder, meta)
            for batch in batches:
                for _, _, buf, off in chunks(batch.column(0), 8 << 20):
                    found, ends = tokens(buf, off)
                    distinct, local = np.unique(found, return_inverse=True)
                    del found
                    # ids are in the order of hashes, so what is in order of local numbers stays in order
                    ids = words.ids(distinct)[0].astype(np.uint64)
                    (v, w, n2), (a, b, c, n3) = _ngrams(local, ends, len(distinct))
                    del local
                    yield _blobs(2, ids[v], ids[w], n2, shards)
                    yield _blobs(3, ids[a] * np.uint64(meta["v"]) + ids[b], ids[c], n3, shards)

        def build_level(group: pa.Table) -> pa.Table:
            order, i = group.column("order")[0].as_py(), group.column("shard")[0].as_py()
            context, word, count = _merged(group)
            save(f"{folder}/order{order}-{i}", _level_arrays(context, word, count, meta["v"], meta["v"] ** (order - 1)))
            return pa.table({"order": pa.array([order], pa.int32()), "shard": pa.array([i], pa.int32())})

        manifest |= {"order2": np.zeros(shards, bool), "order3": np.zeros(shards, bool)}
        built = stage(texts.mapInArrow(emit, "order int, shard int, keys binary, words binary, counts binary").groupBy("order", "shard").applyInArrow(build_level, "order int, shard int"), "trie-levels").toArrow()
        for order in (2, 3):
            manifest[f"order{order}"][built.column("shard").to_numpy()[built.column("order").to_numpy() == order]] = True
        save(f"{folder}/manifest", manifest)
        return cls(folder, meta)

    @staticmethod
    def log_probs(found: np.ndarray, ends: np.ndarray, words: Words, bigrams: Level, trigrams: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, base log10, model log10) of each token."""
        distinct, local = np.unique(found, return_inverse=True)
        ids, count = words.ids(distinct)
        one = words.base_p(count)
        known, base = (count > 0)[local], np.log10(one)[local]
        p = one[local]
        inner = np.ones(len(found), bool)
        inner[ends[:-1]] = False
        at = np.flatnonzero(inner & np.append(False, known[:-1]))
        if not len(at):
            return known, base, base
        # distinct (v, w) in order; unknown w, and contexts that are not there, have no share of their own
        d = max(1, len(distinct))
        pairs, pair = np.unique(local[at - 1] * d + local[at], return_inverse=True)
        v, w = pairs // d, pairs % d
        share, back = bigrams.look(ids[v].astype(np.uint64), ids[w])
        two = share + back * one[w]
        p[at] = two[pair]
        # (u, v, w) with a pair (u, v) that the model has
        number = np.full(len(found), -1, np.int64)
        number[at] = np.where(share[pair] > 0, pair, -1)
        third = at[(number[at - 1] >= 0) & inner[at - 1]]
        if len(third):
            triples, triple = np.unique(number[third - 1] * d + local[third], return_inverse=True)
            head, w3 = triples // d, triples % d
            share, back = trigrams.look((ids[v[head]] * words.meta["v"] + ids[w[head]]).astype(np.uint64), ids[w3])
            p[third] = share[triple] + back[triple] * p[third]
        return known, base, np.log10(np.minimum(p, 1.0))

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_tokens, n_known, base_score, score for each row of docs."""
        folder, meta = self.folder, self.meta

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, bigrams, trigrams = Words(folder, meta), Level(folder, 2, meta), Level(folder, 3, meta)
            for batch in batches:
                for row, end, buf, off in chunks(batch.column(1), 8 << 20):
                    found, ends = tokens(buf, off)
                    known, base, p = Trie.log_probs(found, ends, words, bigrams, trigrams)
                    sums = [np.add.reduceat(x, ends[:-1]) for x in (known.astype(np.int64), base, p)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(np.diff(ends)), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)

    def drop(self, docs: DataFrame) -> None:
        drop(docs.sparkSession, "file://" + self.folder)


def score_documents(docs: DataFrame, shard_tokens: int = 3_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: learns from rows that are not held out. The model is deleted once all rows have scores."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    model = Trie.build(docs.where(~held), shard_tokens)
    scored = stage(model.score(docs).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.meta["n"]).cast("long").alias("train_tokens"), "base_score", "score"), "scores")
    model.drop(docs)
    return scored
