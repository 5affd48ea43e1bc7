"""Near duplicates: consistent weighted sampling over TF-IDF shingles, banded and verified.

1. Equal texts are one class; only one of them goes on, and the others leave before texts are shuffled.
2. Document frequencies of five-word shingles: chunks of documents send the sorted distinct hashes of
   their shingles to buckets of the hash range, which send back how many documents have each. Texts
   and answers meet again by chunk. A hash is as wide as the corpus needs (24 bits over its size).
3. A document can only be similar if shingles that others have too make up ``threshold`` of its
   weight: the similarity is at most that share. The rest of the documents is done.
4. For those that remain, Ioffe's improved consistent weighted sampling draws signatures over the
   shingles that others share (no other could agree), cut into bands.
5. In each band bucket, the least document is compared with all others by exact weighted Jaccard
   similarity; buckets whose documents then still fall into several components go on, until every
   document outside the largest component has been compared with all of its bucket outside its own.
6. Classes are the components of verified links. Documents of one component need no further links to
   be of one class, so those are not looked for, and none are counted.

A weight is the shingle's count in the text times 1 + ``damping`` * ln(N / df) / ln(N + 1), with the
exact document frequency. Documents are rows of the table: inside, each text is known by the row number
of its representative, so nothing depends on doc_id, which only names the classes in the end.

Defined cases: null and wordless texts are in classes of their own; a text of one to four words is one
shingle; rows with equal texts are one document whatever their doc_id, and rows with one doc_id and
different texts are different documents; a class is named by its least doc_id (null if it has none), and
its first row by (doc_id, place in the table; null last) stands for it. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytetext import ALNUM, LOWER, chunks, docs_of, hash_spans, mix, spans
from tessera.llm.components import components
from tessera.llm.staging import stage, with_rows

SHINGLE = 5
BANDS, ROWS = 16, 4
#: Bytes of text that are cut into shingles at a time, and documents whose bands are drawn at a time: they bound a worker's memory.
RUN, DRAWN = 2 << 20, 1024
#: Row numbers of copies up to this many (8 bytes each) are broadcast, more are joined by a shuffle.
MOST_SENT = 4_000_000
VECTOR = "doc_id long, total double, shared double, profile array<double>, hashes binary, weights binary"
#: Octaves of document frequency in a profile; the last takes all above.
OCTAVES = 16


def squeeze(values: np.ndarray) -> bytes:
    """Compact form of a sorted uint64 array: differences, by byte planes."""
    step = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def shingles(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, count) of the distinct shingles of each text, by hash and document."""
    low = LOWER[buf]
    start, stop = spans(low, off, ALNUM)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    word = hash_spans(low, start, stop)
    bounds = docs_of(start, off)
    n = np.diff(bounds)
    h = word.copy()
    for k in range(1, SHINGLE):
        h[:-k] = mix(h[:-k], word[k:])
    has = np.maximum(n - (SHINGLE - 1), (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n), dtype=np.int32), has)
    at = np.repeat(bounds[:-1], has) + np.arange(has.sum()) - np.repeat(np.cumsum(has) - has, has)
    key = h[at]
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)).tolist():
        short = word[bounds[i]]
        for w in word[bounds[i] + 1 : bounds[i + 1]]:
            short = mix(np.array([short]), np.array([w]))[0]
        key[(np.cumsum(has) - has)[i]] = mix(np.array([short]), np.array([np.uint64(n[i])]))[0]
    key >>= np.uint64(64 - bits)
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    return key[new], doc[new], np.diff(np.append(new, len(key))).astype(np.int32)


def _chunk(texts: pa.Table, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The documents of a chunk, sorted by number, and their shingles."""
    ids = texts.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    column = texts.column("text").take(pa.array(order)).combine_chunks()
    keys, docs, counts = [], [], []
    for row, _, buf, off in chunks(column, RUN):
        k, d, c = shingles(buf, off, bits)
        keys.append(k)
        docs.append(d + np.int32(row))
        counts.append(c)
    if not keys:
        return ids[order], [np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)]
    key, doc, count = (np.concatenate(x) for x in (keys, docs, counts))
    if len(keys) > 1:
        by = np.argsort(key, kind="stable")
        key, doc, count = key[by], doc[by], count[by]
    return ids[order], [key, doc, count]


def _cuts(key: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket of the hash range starts in sorted hashes."""
    edges = [(b << bits) // buckets for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(key, np.array(edges, np.uint64)), [len(key)]])


def _pack(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u4")


def _weights(df: np.ndarray, count: np.ndarray, n_docs: int, damping: float) -> np.ndarray:
    return count * (1 + damping * (np.log(max(n_docs, 1)) - np.log(df)) / np.log(n_docs + 1))


def vectors(texts: DataFrame, n_docs: int, chars: int, threshold: float, damping: float, chunk_chars: int = 4 << 20) -> DataFrame:
    """VECTOR rows of the documents (doc_id, text), all different, that could be similar to another: total weight, and hashes and weights of shared shingles."""
    bits = int(min(64, max(40, 24 + np.ceil(np.log2(max(2, chars / 6))))))
    # a bucket holds what twice a chunk's text has: it takes less memory for a shingle than a chunk does
    n_chunks, buckets = max(1, -(-chars // chunk_chars)), max(1, -(-chars // (2 * chunk_chars)))
    texts = texts.select(F.pmod(F.xxhash64(F.lit("chunk"), "doc_id"), F.lit(n_chunks)).cast("int").alias("chunk"), "doc_id", "text")

    def send(group: pa.Table) -> pa.Table:
        _, (key, _, _) = _chunk(group, bits)
        mine = group.column("chunk")[0].as_py()
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(at, len(key)))
        key = key[at]
        cuts = _cuts(key, buckets, bits)
        some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        return pa.table({
            "bucket": pa.array(some, pa.int32()), "chunk": pa.array([mine] * len(some), pa.int32()),
            "hashes": pa.array([squeeze(key[cuts[b] : cuts[b + 1]]) for b in some], pa.binary()), "times": pa.array([_pack(times[cuts[b] : cuts[b + 1]]) for b in some], pa.binary()),
        })

    def count(group: pa.Table) -> pa.Table:
        keys = [unsqueeze(x) for x in group.column("hashes").to_pylist()]
        times = [_unpack(x) for x in group.column("times").to_pylist()]
        sizes = [len(k) for k in keys]
        whole = np.concatenate(keys)
        order = np.argsort(whole, kind="stable")
        whole = whole[order]
        at = np.flatnonzero(np.append(True, whole[1:] != whole[:-1]))
        df = np.add.reduceat(np.concatenate(times)[order].astype(np.int64), at)
        back = np.empty(len(whole), np.int64)
        back[order] = np.repeat(df, np.diff(np.append(at, len(whole))))
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "dfs": pa.array([_pack(p) for p in np.split(back, np.cumsum(sizes)[:-1])], pa.binary())})

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, (key, doc, times) = _chunk(left, bits)
        by = dict(zip(right.column("bucket").to_pylist(), right.column("dfs").to_pylist(), strict=True))
        df = np.concatenate([np.zeros(0, "<u4"), *(_unpack(by[b]) for b in sorted(by))])
        first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        if len(df) != first.sum():
            raise RuntimeError("document frequencies of other shingles than those asked for")
        df = df[np.cumsum(first) - 1] if len(key) else df
        weight = _weights(df.astype(np.float64), times, n_docs, damping)
        total = np.bincount(doc, weight, minlength=len(ids))
        shared = np.bincount(doc, weight * (df > 1), minlength=len(ids))
        octave = np.minimum(np.log2(np.maximum(df, 1)).astype(np.int64), OCTAVES - 1)
        profile = np.bincount(doc * OCTAVES + octave, weight * (df > 1), minlength=len(ids) * OCTAVES).reshape(-1, OCTAVES)
        stay = (total > 0) & (shared >= threshold * total * (1 - 1e-9))
        keep = (df > 1) & stay[doc] if len(doc) else np.zeros(0, bool)
        key, doc, weight = key[keep], doc[keep], weight[keep].astype("<f4")
        order = np.argsort(doc, kind="stable")
        key, doc, weight = key[order], doc[order], weight[order]
        which = np.flatnonzero(stay)
        low, high = np.searchsorted(doc, which), np.searchsorted(doc, which, "right")
        return pa.table({
            "doc_id": pa.array(ids[which], pa.int64()), "total": pa.array(total[which]), "shared": pa.array(shared[which]), "profile": pa.array(list(profile[which]), pa.list_(pa.float64())),
            "hashes": pa.array([key[a:b].astype("<u8").tobytes() for a, b in zip(low, high, strict=True)], pa.binary()),
            "weights": pa.array([weight[a:b].tobytes() for a, b in zip(low, high, strict=True)], pa.binary()),
        })

    asked = texts.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, hashes binary, times binary")
    answered = asked.groupBy("bucket").applyInArrow(count, "chunk int, bucket int, dfs binary")
    return texts.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(weigh, VECTOR)


def _uniform(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniforms in (0, 1) from each 64-bit hash."""
    high, low = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)
    return (high.astype(np.float64) + 0.5) / 2**32, (low.astype(np.float64) + 0.5) / 2**32


def signature(key: np.ndarray, weight: np.ndarray, size: int, own: int = 0, rest: float = 0.0) -> np.ndarray:
    """``size`` consistent weighted samples: two vectors agree in each with the probability of their weighted Jaccard similarity.

    rest is the weight of shingles that no other document has. The least of their values is exponential
    at that rate, like that of any other weight, and agrees with no other document: one draw by the
    document's number ``own`` stands for all of them."""
    out = np.zeros(size, np.uint64)
    ln = np.log(weight.astype(np.float64))[:, None]
    best = np.full(size, np.inf)
    if rest > 0:
        out = mix(np.full(size, own, np.int64).astype(np.uint64), np.arange(1, size + 1, dtype=np.uint64) + np.uint64(1 << 40))
        best = np.log(-np.log(_uniform(out)[0]) / rest)
    for a in range(0, len(key), 4096):
        k = key[a : a + 4096, None]
        seed = mix(np.broadcast_to(k, (len(k), size)).ravel(), np.tile(np.arange(1, size + 1, dtype=np.uint64), len(k))).reshape(len(k), size)
        u1, u2 = _uniform(seed)
        r = -np.log(u1 * u2)
        second = seed * np.uint64(0x9FB21C651E98DF25)
        second ^= second >> np.uint64(32)
        u3, u4 = _uniform(second)
        third = second * np.uint64(0xD6E8FEB86659FD93)
        beta = ((third >> np.uint64(33)).astype(np.float64) + 0.5) / 2**31
        t = np.floor(ln[a : a + 4096] / r + beta)
        ln_a = np.log(-np.log(u3 * u4)) - r * (t - beta) - r
        at = ln_a.argmin(0)
        cols = np.arange(size)
        value = ln_a[at, cols]
        better = value < best
        best[better] = value[better]
        sample = mix(k[at, 0], t[at, cols].astype(np.int64).astype(np.uint64))
        out[better] = sample[better]
    return out


def band_keys(found: DataFrame, bands: int, rows: int) -> DataFrame:
    """band, key, doc_id, total, shared, and the keys of all bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, DRAWN) for whole in batches for at in range(0, len(whole), DRAWN)):
            keys = np.zeros((len(batch), bands), np.int64)
            for i in range(len(batch)):
                doc, rest = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() - batch.column(2)[i].as_py()
                drawn = signature(np.frombuffer(batch.column(4)[i].as_py(), "<u8"), np.frombuffer(batch.column(5)[i].as_py(), "<f4"), bands * rows, doc, rest).reshape(bands, rows)
                key = drawn[:, 0]
                for r in range(1, rows):
                    key = mix(key, drawn[:, r])
                keys[i] = key.astype(np.int64)
            n = len(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array(keys.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(n), bands))), *[batch.column(k).take(pa.array(np.repeat(np.arange(n), bands))) for k in (1, 2, 3)], pa.array(list(np.repeat(keys, bands, axis=0)), pa.list_(pa.int64()))],
                names=["band", "key", "doc_id", "total", "shared", "profile", "keys"],
            )

    return found.mapInArrow(run, "band int, key long, doc_id long, total double, shared double, profile array<double>, keys array<long>")


def similarity(a: tuple[np.ndarray, np.ndarray, float], b: tuple[np.ndarray, np.ndarray, float]) -> float:
    """Weighted Jaccard similarity of two vectors: sorted hashes and weights of shared shingles, and total weight."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    common = float(np.minimum(a[1][at[same]], b[1][same]).sum(dtype=np.float64))
    return common / (a[2] + b[2] - common)


def verify(pairs: DataFrame, found: DataFrame, threshold: float, members: int = 400) -> DataFrame:
    """(a, b) of the distinct pairs whose similarity reaches the threshold. Pairs of a frequent a are spread over salts."""
    sized = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salted = pairs.join(sized, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / members)).cast("int").alias("salt"))
    own = salted.join(found.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "total", "hashes", "weights")
    heads = salted.select("a", "salt").distinct().join(found.withColumnRenamed("doc_id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "total", "hashes", "weights")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        def vector(t: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray, float]:
            return np.frombuffer(t.column("hashes")[i].as_py(), "<u8"), np.frombuffer(t.column("weights")[i].as_py(), "<f4"), t.column("total")[i].as_py()

        links = []
        if len(left):
            head = vector(left, 0)
            links = [right.column("b")[i].as_py() for i in range(len(right)) if similarity(head, vector(right, i)) >= threshold]
        a = left.column("a")[0].as_py() if len(left) else 0
        return pa.table({"a": pa.array([a] * len(links), pa.int64()), "b": pa.array(links, pa.int64())})

    # other names on one side: both come from the same tables
    own = own.toDF("a_", "salt_", "b", "total", "hashes", "weights")
    heads = heads.toDF("a", "salt", "none", "total", "hashes", "weights")
    return heads.groupBy("a", "salt").cogroup(own.groupBy("a_", "salt_")).applyInArrow(compare, "a long, b long")


def c_top(name: str) -> Column:
    return F.col(f"top.{name}")


def members(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, damping: float = 0.2, leader_rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows (row, own) of docs, and for each of them (row, doc_id, class_id, stands): its class, and whether it stands for it."""
    spark = docs.sparkSession
    base = with_rows(docs)
    text = F.col("own.text").cast("string")
    worded = F.coalesce(text.rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"), F.lit(False))
    hashed = stage(base.select("row", F.col("own.doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"), F.octet_length(text).alias("size"), worded.alias("worded")), "texts")
    # the first row of each text, by (doc_id, row), stands for it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    reps = hashed.where("worded").groupBy("h1", "h2").agg(first, F.max("size").alias("size")).select("h1", "h2", "size", F.col("first.row").alias("rep"), F.col("first.doc_id").alias("rep_id"))
    copies = stage(hashed.where("worded").select("row", "doc_id", "h1", "h2").join(reps, ["h1", "h2"]).select("row", "doc_id", "rep", "rep_id", "size"), "copies")
    leaders = copies.where("row = rep")
    n_docs, chars = leaders.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    others = hashed.where("NOT worded").select("row").union(copies.where("row <> rep").select("row"))
    others = F.broadcast(others) if others.count() <= MOST_SENT else others
    texts = base.select("row", text.alias("text")).join(others, "row", "left_anti").withColumnRenamed("row", "doc_id")
    found = stage(vectors(texts, n_docs, chars, threshold, damping), "vectors")
    keyed = stage(band_keys(found, bands, rows), "bands")
    crowded = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    keyed = stage(keyed.join(crowded, ["band", "key"]), "bands")

    edges = spark.createDataFrame([], "a long, b long")
    tested = spark.createDataFrame([], "a long, b long")
    comp = spark.createDataFrame([], "node long, component long")
    for turn in range(leader_rounds + 1):
        labelled = keyed.join(comp, keyed["doc_id"] == comp["node"], "left").select("band", "key", "doc_id", "total", "shared", "profile", "keys", F.coalesce("component", "doc_id").alias("c"))
        parts = labelled.groupBy("band", "key", "c").agg(F.count("*").alias("n"))
        largest = parts.groupBy("band", "key").agg(F.max(F.struct("n", "c")).alias("top"), F.count("*").alias("k"), F.sum("n").alias("n")).where("k > 1")
        largest = stage(largest.select("band", "key", c_top("c").alias("top"), (F.col("n") * (F.col("n") - c_top("n"))).alias("work"), "n"), "buckets")
        work, size = largest.agg(F.coalesce(F.sum("work"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not work:
            break
        last = turn == leader_rounds or (turn > 0 and work <= 4 * size)
        rest = labelled.join(largest.drop("work", "n"), ["band", "key"])
        # a document that copies vary has little that no other has, and one that only holds what its
        # bucket has in common is the shortest: these two are compared with all others first
        heads = rest.select("band", "key", "doc_id", "total", "shared", "c", "profile", "keys")
        if last:
            heads = rest.where("c <> top").select(*heads.columns)
        else:
            order = 1 - F.col("shared") / F.col("total") if turn == 0 else F.col("total") if turn == 1 else F.xxhash64(F.col("doc_id"), F.lit(turn)).cast("double")
            outside = heads if turn < 2 else rest.where("c <> top")
            heads = outside.groupBy("band", "key").agg(F.min(F.struct(order.alias("o"), *[F.col(x) for x in ("doc_id", "total", "shared", "c", "profile", "keys")])).alias("h")).select("band", "key", "h.doc_id", "h.total", "h.shared", "h.c", "h.profile", "h.keys")
        heads = heads.toDF("band", "key", "x", "x_total", "x_shared", "x_c", "x_profile", "x_keys")
        # what two documents have in common is at most the lesser shared weight, of all frequencies
        # together and so in each octave of them
        def near(most: Column) -> Column:
            return most >= threshold * (F.col("total") + F.col("x_total") - most) * (1 - 1e-9)

        each = F.aggregate(F.zip_with("profile", "x_profile", lambda p, q: F.least(p, q)), F.lit(0.0), lambda p, q: p + q)
        similar = near(F.least("shared", "x_shared")) & near(each)
        # a pair meets in the first band that has both, not in each
        before = F.col("band")
        once = ~F.exists(F.zip_with(F.slice("keys", F.lit(1), before), F.slice("x_keys", F.lit(1), before), lambda p, q: p == q), lambda p: p)
        pairs = rest.join(heads, ["band", "key"]).where((F.col("c") != F.col("x_c")) & similar & (once if last else F.lit(True)))
        if last:
            # of two that both stand outside the largest component, the lesser one asks
            pairs = pairs.where((F.col("c") == F.col("top")) | (F.col("x") < F.col("doc_id")))
        pairs = pairs.select(F.col("x").alias("a"), F.col("doc_id").alias("b")).distinct()
        pairs = pairs.join(tested, ["a", "b"], "left_anti").join(tested.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        links = verify(pairs, found, threshold)
        edges = stage(edges.union(links), "links")
        tested = stage(tested.union(pairs), "tested")
        comp = stage(components(edges), "components")
        if last:
            break
    grouped = leaders.join(comp, F.col("rep") == F.col("node"), "left").select("rep", "rep_id", F.coalesce("component", "rep").alias("c"))
    first = F.min(F.struct(F.col("rep_id").isNull().alias("last"), F.col("rep_id").alias("id"), F.col("rep").alias("row"))).alias("first")
    names = grouped.groupBy("c").agg(first).select("c", F.col("first.id").alias("class_id"), F.col("first.row").alias("head"))
    named = grouped.join(names, "c").select("rep", "class_id", "head")
    back = copies.join(named, "rep").select("row", "doc_id", "class_id", (F.col("row") == F.col("head")).alias("stands"))
    return base, back.unionAll(hashed.where("NOT worded").select("row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(True)))


def classes(docs: DataFrame, **how: float) -> DataFrame:
    """doc_id, class_id (least doc_id of the class; null if none has one), for each row of docs; ``how`` as for ``members``."""
    return members(docs, **how)[1].select("doc_id", "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline form: the first row of each class, with the columns of docs."""
    rows, found = members(docs)
    gone = found.where("NOT stands").select("row")
    return rows.join(gone, "row", "left_anti").select("own.*")
