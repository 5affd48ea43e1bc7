"""Two chained stateful stages over the events of files, with the same results as the batch forms whatever the order of arrival.

Stage one, the transcript pass, holds for each file when it was taken out and its first transcript before that.
Stage two, the full pass, takes what stage one says about a file, and its summaries, which stage one hands on. It
holds the file's epoch: a counter that stage one raises with each change. What was said in an older epoch than the
held one is late and changes nothing; a newer epoch replaces the marks, and the full pass is looked for anew among
the summaries seen so far. Each stage answers with a row for each file that a micro-batch touches; the row of the
highest version is the file's state.

The stale-event filter is a stage of its own, a streaming aggregate: for each file and epoch its state holds how many
events there are and the last of them. The current epoch is that of the latest event, so a file's answer is the row of
the greatest ``seq``, and among those of the greatest count, which only grows. Each micro-batch answers with one row for
each file that it touches; of a micro-batch with late events only, that row lies behind an earlier one and changes nothing.

Defined cases: rows without a path take no part, nor do those without ``seq`` in the passes. The filter counts them in
their epoch, which they do not make the current one. No epoch is an epoch too. Repeated events count once for the
passes, and as often as they come for the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.queue import rocks

NEVER = 2**63 - 1
_MARK = "path long, kind string, seq long, epoch long, first_pass long, gone long"
PASSES = "path long, version long, first_pass long, full_pass long"
KEPT = "path long, kept long, seq long"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return pd.DataFrame({n: pd.array([r[k] for r in rows], dtype="string" if n == "kind" else "Int64") for k, n in enumerate(names)})


class TranscriptPass(StatefulProcessor):
    """Events (path, seq, stage) in; summaries, and marks of the file whenever they change, out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # the least transcript of all: while it stands before the removal, it is the first pass
        self._marks = handle.getValueState("marks", "epoch long, first long, gone long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        epoch, first, gone = self._marks.get() if self._marks.exists() else (0, NEVER, NEVER)
        before, out = (first, gone), []
        for part in rows:
            for seq, stage in zip(part["seq"], part["stage"], strict=True):
                if stage == "transcribe":
                    first = min(first, int(seq))
                elif stage == "error":
                    gone = min(gone, int(seq))
                elif stage == "summarize":
                    out.append((key[0], "summary", int(seq), 0, 0, 0))
        if (first, gone) != before:
            epoch += 1
            self._marks.update((epoch, first, gone))
            out.append((key[0], "mark", 0, epoch, first, gone))
        yield _frame(out, _MARK)

    def close(self) -> None:
        pass


class FullPass(StatefulProcessor):
    """Marks and summaries in; PASSES rows out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getValueState("held", "version long, epoch long, first long, gone long")
        self._summaries = handle.getListState("summaries", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, epoch, first, gone = self._held.get() if self._held.exists() else (0, 0, NEVER, NEVER)
        fresh = []
        for part in rows:
            for r in part.itertuples(index=False):
                if r.kind == "summary":
                    fresh.append(int(r.seq))
                elif int(r.epoch) > epoch:
                    epoch, first, gone = int(r.epoch), int(r.first_pass), int(r.gone)
        if fresh:
            self._summaries.appendList([(s,) for s in fresh])
        self._held.update((version + 1, epoch, first, gone))
        live = first < gone
        seen = (s[0] for s in self._summaries.get()) if live and self._summaries.exists() else ()
        full = min((s for s in seen if first < s < gone), default=None)
        yield _frame([(key[0], version + 1, first if live else None, full)], PASSES)

    def close(self) -> None:
        pass


def two_pass(events: DataFrame) -> DataFrame:
    """PASSES rows of a stream of events (path, seq, stage)."""
    known = events.select("path", "seq", "stage").where("path IS NOT NULL AND seq IS NOT NULL")
    marks = known.groupBy("path").transformWithStateInPandas(TranscriptPass(), _MARK, "Append", "None")
    return marks.groupBy("path").transformWithStateInPandas(FullPass(), PASSES, "Append", "None")


def stale_drop(events: DataFrame) -> DataFrame:
    """Of a stream of events (path, seq, epoch), for each file and epoch (path, epoch, kept, seq): how many events, and the last."""
    known = events.select("path", "seq", "epoch").where("path IS NOT NULL")
    return known.groupBy("path", "epoch").agg(F.count("*").alias("kept"), F.max("seq").alias("seq"))


def _current(rows: DataFrame) -> DataFrame:
    """KEPT: of each file the row of its current epoch, among rows of files and epochs as they were at several times."""
    last = rows.where("seq IS NOT NULL").groupBy("path").agg(F.max(F.struct("seq", "kept")).alias("last"))
    return last.select("path", "last.kept", "last.seq")


def run(spark: SparkSession, answers: DataFrame, out: str) -> DataFrame:
    """Answer all that a stream has now, beside what ``out`` holds from earlier runs; the last answer for each path."""
    stream = answers.writeStream.option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True)
    if "epoch" in answers.columns:
        return _run_filter(spark, stream, f"{out}/answers")
    with rocks(spark):
        stream.format("parquet").option("path", f"{out}/answers").start().awaitTermination()
    told = spark.read.schema(answers.schema).parquet(f"{out}/answers")
    rest = [c for c in told.columns if c not in ("path", "version")]
    return told.groupBy("path").agg(F.max_by(F.struct(*rest), "version").alias("last")).select("path", "last.*")


def _run_filter(spark: SparkSession, stream: DataStreamWriter, folder: str) -> DataFrame:
    """Counts change with each micro-batch: it is written once, under its number."""

    def keep(rows: DataFrame, batch: int) -> None:
        _current(rows).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    spark.createDataFrame([], KEPT).write.mode("overwrite").parquet(f"{folder}/batch=-1")  # a stream may have nothing yet
    with rocks(spark):
        stream.outputMode("update").foreachBatch(keep).start().awaitTermination()
    return _current(spark.read.schema(KEPT).parquet(folder))
