"""A first-in-first-out work queue per key, as a stream of commands with state.

Commands of a queue, in the order of ``seq``:

- ``add`` puts a path at the end; ``remove`` takes the first waiting entry of a path, never the active one.
- ``clear`` drops all that waits and numbers files from 0 again; what is active goes on.
- ``pause`` and ``resume`` hold the worker and let it go.
- ``abort`` marks the active file; the mark is used up by the worker's next step, paused or not.
- ``step`` is the worker at a safe point. With a mark, the active file is given up, and nothing else happens.
  Paused, it waits. Else the active file is done and the first waiting path becomes active, under the next
  file number.

Each command gives one row with what it did. Waiting paths are list state and the rest is value state, kept by
the state store, so a restarted stream goes on where it was. A command whose ``seq`` is not above the queue's
last one is a repeated delivery and changes nothing; unknown commands are ignored but answered.

Defined cases: rows without a queue or a ``seq`` take no part; an ``add`` without a path is refused.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ANSWER = "queue long, seq long, command string, result string, path long, file long, waiting long"
_CONTROL = "last long, paused boolean, marked boolean, files long, active long, active_path long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Queue:
    """State of one queue, and what each command does to it."""

    def __init__(self, waiting: list[int], last: int = -1, paused: bool = False, marked: bool = False, files: int = 0, active: int | None = None, active_path: int | None = None) -> None:
        self.waiting, self.kept = waiting, len(waiting)
        self.last, self.paused, self.marked, self.files, self.active, self.active_path = last, paused, marked, files, active, active_path

    def apply(self, command: str, path: int | None) -> tuple[str, int | None, int | None]:
        """(result, path, file number)."""
        if command == "add":
            if path is None:
                return "refused", None, None
            self.waiting.append(path)
            return "added", path, None
        if command == "remove":
            if path not in self.waiting:
                return "absent", path, None
            at = self.waiting.index(path)
            self.kept = min(self.kept, at)
            del self.waiting[at]
            return "removed", path, None
        if command == "clear":
            self.waiting, self.kept, self.files = [], 0, 0
            return "cleared", None, None
        if command in ("pause", "resume"):
            self.paused = command == "pause"
            return ("paused" if self.paused else "resumed"), None, None
        if command == "abort":
            self.marked = True
            return "marked", None, None
        if command == "step":
            return self._step()
        return "unknown", None, None

    def _step(self) -> tuple[str, int | None, int | None]:
        if self.marked:
            given_up, self.marked, self.active = self.active, False, None
            return "aborted", self.active_path if given_up is not None else None, given_up
        if self.paused:
            return "waits", None, None
        self.active = None
        if not self.waiting:
            return "idle", None, None
        self.active_path, self.active = self.waiting.pop(0), self.files
        self.files, self.kept = self.files + 1, 0
        return "started", self.active_path, self.active


class QueueProcessor(StatefulProcessor):
    """Commands (queue, seq, command, path) in, ANSWER rows out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._waiting = handle.getListState("waiting", "path long")
        self._control = handle.getValueState("control", _CONTROL)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._control.get() if self._control.exists() else ()
        queue = Queue([r[0] for r in self._waiting.get()] if self._waiting.exists() else [], *held)
        before, out = len(queue.waiting), []
        commands = sorted((r for part in rows for r in part[["seq", "command", "path"]].itertuples(index=False)), key=lambda r: r.seq)
        for r in commands:
            if r.seq <= queue.last:
                continue
            queue.last = int(r.seq)
            path = None if pd.isna(r.path) else int(r.path)
            out.append((key[0], queue.last, r.command, *queue.apply(r.command, path), len(queue.waiting)))
        if queue.kept == before:  # nothing but additions at the end
            if len(queue.waiting) > before:
                self._waiting.appendList([(p,) for p in queue.waiting[before:]])
        elif queue.waiting:
            self._waiting.put([(p,) for p in queue.waiting])
        else:
            self._waiting.clear()
        self._control.update((queue.last, queue.paused, queue.marked, queue.files, queue.active, queue.active_path))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ANSWER.split(", ")]).astype({"path": "Int64", "file": "Int64"})

    def close(self) -> None:
        pass


def answers(commands: DataFrame) -> DataFrame:
    """The stream of answers to a stream of commands."""
    columns = commands.select("queue", "seq", "command", "path").where("queue IS NOT NULL AND seq IS NOT NULL")
    return columns.groupBy("queue").transformWithStateInPandas(QueueProcessor(), ANSWER, "Append", "None")


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start in this context keep their state in the store that lists and maps need."""
    kept = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if kept is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, kept)


def run(spark: SparkSession, commands: DataFrame, out: str) -> DataFrame:
    """Answer all commands that a stream has now; what ``out`` holds from earlier runs goes on. Returns all answers there."""
    with rocks(spark):
        answers(commands).writeStream.format("parquet").option("path", f"{out}/answers").option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(ANSWER).parquet(f"{out}/answers")
