"""Quality classifier: naive Bayes support vectors.

Features are indicators of byte n-grams of the whole text and of runs of equal neighbouring words.
Each is scaled by its log-count ratio between the classes, rows are scaled to unit length, and a
linear hinge-loss model is fitted by dual coordinate descent. A logistic curve, fitted to margins of
folds that the model did not see, turns margins into scores.

The model learns from at most ``max_rows`` labelled documents, those with the smallest hash of their
id, as far as their feature lists take ``max_bytes``: that is the bound on what reaches the driver. Every
document is scored.

Defined cases: null text is empty; an empty text has the bias alone; without labelled rows of both
classes the score is the share of label 1 (0.5 without any); a document labelled more than once is
learnt as often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytetext import NON_SPACE, chunks, docs_of, hash_spans, spans
from tessera.llm.staging import stage

BITS = 17
SIZES = (3, 4)
RUNS = (1, 2, 4, 8)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def features(buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct feature numbers of each text."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    n = len(buf)
    columns = []
    for size in SIZES:
        gram = eight[:n] & np.uint64((1 << (8 * size)) - 1)
        columns.append((((gram + np.uint64(size << 40)) * _SPREAD) >> np.uint64(64 - BITS)).astype(np.int32))
    start, stop = spans(buf, off, NON_SPACE)
    word = hash_spans(buf, start, stop) if len(start) else np.zeros(0, np.uint64)
    bounds = docs_of(start, off)
    stamp = np.zeros(1 << BITS, np.int32)
    for i in range(len(off) - 1):
        a, b = off[i], off[i + 1]
        parts = [c[a : max(a, b - size + 1)] for size, c in zip(SIZES, columns, strict=True)]
        own = word[bounds[i] : bounds[i + 1]]
        if len(own) > 1:
            same = np.concatenate([[0], np.cumsum(own[1:] == own[:-1])])
            parts.append(np.array([7919 * r for r in RUNS if len(same) > r and (same[r:] - same[:-r] == r).any()], np.int32))
        flat = np.concatenate(parts)
        order = np.arange(len(flat), dtype=np.int32)
        stamp[flat] = order
        yield flat[stamp[flat] == order]


class Model:
    """Weights over features, bias, and the curve from margins to scores."""

    def __init__(self, weight: np.ndarray, bias: float, a: float, b: float):
        self.weight, self.bias, self.a, self.b = weight, bias, a, b

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weight[x].sum() / np.sqrt(max(1, len(x))) + self.bias for x in rows])

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))


def _hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float, epochs: int, seed: int, close: float = 1e-3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; the bias is one more feature.

    Each dual variable lies between 0 and its row's cost, which evens out the classes. The descent ends
    when no projected gradient of a pass is over ``close``, or after ``epochs`` passes."""
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    scaled = [ratio[x] / np.sqrt(max(1, len(x))) for x in rows]
    cost = np.where(y > 0, c * len(y) / max(1, 2 * (y > 0).sum()), c * len(y) / max(1, 2 * (y < 0).sum()))
    diagonal = np.array([(v * v).sum() + 1 for v in scaled])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in random.permutation(len(rows)).tolist():
            x, v = rows[i], scaled[i]
            gradient = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost[i])
            if new != alpha[i]:
                most = max(most, abs(gradient))
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
        if most <= close:
            break
    return w * ratio, bias


def fit(rows: list[np.ndarray], label: np.ndarray, c: float = 1.0, epochs: int = 12, folds: int = 3, seed: int = 7) -> Model:
    """The model of feature lists and labels 0 and 1."""
    y = np.where(label > 0, 1.0, -1.0)
    size = 1 << BITS
    if not len(y) or (y > 0).all() or (y < 0).all():
        share = (np.sum(y > 0) + 0.5) / (len(y) + 1)
        return Model(np.zeros(size), 0.0, 0.0, float(np.log(share / (1 - share))))

    def train(which: np.ndarray) -> tuple[np.ndarray, float]:
        counts = []
        for sign in (1, -1):
            own = [rows[i] for i in which[y[which] == sign].tolist()]
            p = 1.0 + np.bincount(np.concatenate(own) if own else np.zeros(0, np.int32), minlength=size)
            counts.append(p / p.sum())
        return _hinge([rows[i] for i in which.tolist()], y[which], np.log(counts[0] / counts[1]), c, epochs, seed)

    fold = np.random.default_rng(seed).permutation(len(y)) % folds
    margin = np.zeros(len(y))
    for k in range(folds):
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if (y[inside] > 0).all() or (y[inside] < 0).all():
            continue
        m = Model(*train(inside), 1, 0)
        margin[outside] = m.margin([rows[i] for i in outside.tolist()])
    weight, bias = train(np.arange(len(y)))
    a, b = 1.0, 0.0
    target = (y > 0).astype(float)
    target = target * (target.sum() + 1) / (target.sum() + 2) + (1 - target) / ((1 - target).sum() + 2)
    for _ in range(50):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        q = p * (1 - p)
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(q * margin * margin).sum() + 1e-6, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return Model(weight, bias, float(a), float(b))


def _fold(modulus: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_bytes: int = 256 << 20, bound: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs. Rows with crc32(doc_id) mod 4 = 2 teach nothing."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (_fold(4) != 2)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    taught = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, off in chunks(batch.column(1)):
                own = [x.astype("<i4").tobytes() for x in features(buf, off)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(2).slice(row, end - row), pa.array(own, pa.binary())], names=["doc_id", "quality", "features"])

    listed = taught.mapInArrow(extract, "doc_id long, quality int, features binary").withColumn("h", F.xxhash64("doc_id")).withColumn("n", F.monotonically_increasing_id())
    listed = stage(listed, "quality-features")
    order = ["h", "doc_id", "quality", "n"]
    # numbers of at most max_rows rows, whatever ids repeat, tell where the bytes end
    sizes = listed.select(*order, (F.octet_length("features").cast("long") + 8).alias("size")).orderBy(*order).limit(max_rows).toArrow()
    fit_in = int((np.cumsum(sizes.column("size").to_numpy()) <= max_bytes).sum())
    found = []
    if fit_in:
        last = F.struct(*[F.lit(sizes.column(c)[fit_in - 1].as_py()).cast(listed.schema[c].dataType).alias(c) for c in order])
        found = listed.where(F.struct(*order) <= last).select("doc_id", "quality", "features").toLocalIterator()
    rows = sorted(((r[0], r[1], bytes(r[2])) for r in found))
    model = fit([np.frombuffer(r[2], "<i4") for r in rows], np.array([r[1] for r in rows]))
    weight = model.weight.astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, off in chunks(batch.column(1)):
                margin = np.array([weight[x].sum(dtype=np.float64) / np.sqrt(max(1, len(x))) for x in features(buf, off)]) + model.bias
                value = model.score(margin)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(value), pa.array((value >= bound).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
