"""Token counts: rollups by source, language and tokenizer version, kept up by signed deltas.

A store is a folder with one sub-folder of aggregated deltas for each committed batch. Totals are the
sums over batches, so inserts add, deletes subtract and a revised document adds the difference. A
batch is written beside the store and renamed into it once, under its own name: a second commit of
the same batch, or one after a crash, changes nothing. ``compact`` folds the batches that are there into
one snapshot, which keeps their names, so reading a store costs what came since and a folded batch still
cannot be committed again. A snapshot counts from its rename on; what it holds is not read twice, whether
or not the old folders are gone by then.

Defined cases: null text has no tokens but counts as a document; null source or language is a group
of its own; rows that repeat a document count as often as they stand; a group whose documents and
tokens are all gone has no total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.packing import encoder
from tessera.llm.staging import new_path

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_chars long, n_tokens long"


def count_tokens(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_docs (1), n_chars, n_tokens: a row per document and tokenizer version."""
    versions = sorted(tokenizers.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for version, path in versions:
                for row, end, count, _ in encoder(path).counts_and_ids(batch.column(3), want_ids=False):
                    n = end - row
                    cut = [batch.column(i).slice(row, n) for i in (0, 1, 2, 4)]
                    yield pa.RecordBatch.from_arrays([*cut[:3], pa.array([version] * n, pa.string()), pa.array(np.ones(n, np.int64)), cut[3], pa.array(count, pa.int64())], names=["doc_id", "source", "lang", "tokenizer", "n_docs", "n_chars", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), text.alias("text"), F.length(text).cast("long").alias("n_chars"))
    return rows.mapInArrow(run, "doc_id long, " + SCHEMA)


def deltas(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Signed rows that lead from one set of counts to the other; unchanged documents give none."""
    signed = []
    for sign, rows in ((-1, before), (1, after)):
        if rows is not None:
            signed.append(rows.select("doc_id", *KEYS, *[(sign * F.col(c)).alias(c) for c in ("n_docs", "n_chars", "n_tokens")]))
    both = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    summed = both.groupBy("doc_id", *KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_chars", "n_tokens")])
    return summed.where("n_docs <> 0 OR n_chars <> 0 OR n_tokens <> 0")


class Rollup:
    """A store of totals at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._root)

    def _folder(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add signed rows (KEYS, n_docs, n_chars, n_tokens) under the batch's name; False if it was there already."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.batches():
            return False
        staged = self.path + f".pending/{batch}-{new_path(self.spark, 'x')[-12:]}"
        summed = rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in ("n_docs", "n_chars", "n_tokens")])
        summed.write.parquet(staged)
        moved = self._fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(staged), self._folder(f"batch={batch}"))
        if moved and self._fs.exists(self._folder(f"batch={batch}/{staged.rpartition('/')[2]}")):
            # another commit of the batch came first, and the rename went into its folder
            self._fs.delete(self._folder(f"batch={batch}/{staged.rpartition('/')[2]}"), True)
            return False
        return bool(moved)

    def _listed(self, head: str) -> list[str]:
        return sorted(s.getPath().getName()[len(head) :] for s in self._fs.listStatus(self._root) if s.getPath().getName().startswith(head))

    def _snapshot(self) -> tuple[str | None, list[str]]:
        """Folder of the newest snapshot, and the batches that it holds."""
        numbers = self._listed("snapshot=")
        if not numbers:
            return None, []
        newest = f"{self.path}/snapshot={max(numbers, key=int)}"
        return newest, [r[0] for r in self.spark.read.schema("batch string").parquet(f"{newest}/names").collect()]

    def batches(self) -> list[str]:
        """Names of all committed batches."""
        return sorted({*self._listed("batch="), *self._snapshot()[1]})

    def _rows(self) -> DataFrame:
        """What the newest snapshot and the batches after it hold."""
        newest, held = self._snapshot()
        paths = [f"{self.path}/batch={n}" for n in self._listed("batch=") if n not in held] + ([f"{newest}/rows"] if newest else [])
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def totals(self) -> DataFrame:
        summed = self._rows().groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_chars", "n_tokens")])
        return summed.where("n_docs <> 0 OR n_chars <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold all batches into a new snapshot. One at a time; batches committed meanwhile stay as they are."""
        names, old = self.batches(), self._listed("snapshot=")
        staged = self.path + f".pending/snapshot-{new_path(self.spark, 'x')[-12:]}"
        newest, held = self._snapshot()
        fresh = [n for n in names if n not in held]
        paths = [f"{self.path}/batch={n}" for n in fresh] + ([f"{newest}/rows"] if newest else [])
        if not paths:
            return
        rows = self.spark.read.schema(SCHEMA).parquet(*paths).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_chars", "n_tokens")])
        rows.where("n_docs <> 0 OR n_chars <> 0 OR n_tokens <> 0").write.parquet(f"{staged}/rows")
        self.spark.createDataFrame([(n,) for n in names], "batch string").write.parquet(f"{staged}/names")
        number = max(map(int, old), default=0) + 1
        if not self._fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(staged), self._folder(f"snapshot={number}")):
            raise RuntimeError("the snapshot could not be put in place")
        for gone in [f"batch={n}" for n in fresh] + [f"snapshot={n}" for n in old]:
            self._fs.delete(self._folder(gone), True)
