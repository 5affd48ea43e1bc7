"""Fold of progress events into the state of each file, as a batch and as a stream with the same result.

An event moves a file's transcript or summary percentage, ends it (the file leaves), or fails it (the
file goes back to the queue with nothing done). Events carry their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATE = "path long, seq long, status string, stt long, summary long"


def from_events(events: DataFrame) -> DataFrame:
    """(path, seq, stage, pct, epoch) of the event table."""
    stage = F.create_map(*[F.lit(x) for x in ("click", "transcribe", "view", "summarize", "purchase", "done", "error", "error", "signup", "queued")])
    return events.select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), F.element_at(stage, F.col("event_type")).alias("stage"), (F.floor("value") % 101).cast("long").alias("pct"), F.get_json_object("props", "$.k").cast("long").alias("epoch"))


def fold_batch(events: DataFrame) -> DataFrame:
    """STATE of files that have not left: percentages since the last end or failure."""
    reset = F.max(F.when(F.col("stage").isin("done", "error"), F.col("seq"))).over(Window.partitionBy("path"))
    since = events.withColumn("reset", F.coalesce(reset, F.lit(-1)))
    live = F.col("seq") > F.col("reset")
    latest = since.groupBy("path").agg(
        F.max("seq").alias("seq"),
        F.max_by("stage", "seq").alias("last"),
        F.max_by("pct", F.when(live & (F.col("stage") == "transcribe"), F.col("seq"))).alias("stt"),
        F.max_by("pct", F.when(live & (F.col("stage") == "summarize"), F.col("seq"))).alias("summary"),
    )
    status = F.when(F.col("last").isin("error", "queued"), "queued").otherwise("running")
    return latest.where("last <> 'done'").select("path", "seq", status.alias("status"), F.coalesce("stt", F.lit(0)).alias("stt"), F.coalesce("summary", F.lit(0)).alias("summary"))


def _step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Apply a micro-batch's events of a file, in order, to its state."""
    seq, status, stt, summary = state.get if state.exists else (-1, "running", 0, 0)
    rows = sorted((r for b in batches for r in b[["seq", "stage", "pct"]].itertuples(index=False)), key=lambda r: r.seq)
    for r in rows:
        if r.seq <= seq:
            continue
        seq = r.seq
        if r.stage in ("done", "error"):
            stt = summary = 0
        elif r.stage == "transcribe":
            stt = r.pct
        elif r.stage == "summarize":
            summary = r.pct
        status = "gone" if r.stage == "done" else "queued" if r.stage in ("error", "queued") else "running"
    new = (int(seq), status, int(stt), int(summary))
    state.update(new)
    yield pd.DataFrame([(key[0], *new)], columns=["path", "seq", "status", "stt", "summary"])


def fold_stream(events: DataFrame) -> DataFrame:
    """Streaming form: one STATE row of each file that a micro-batch touches ('gone' when it left)."""
    return events.groupBy("path").applyInPandasWithState(_step, STATE, "seq long, status string, stt long, summary long", "update", "NoTimeout")


def run_stream(spark: SparkSession, folder: str, pattern: str, schema, out: str) -> DataFrame:
    """Fold what a folder holds, write each micro-batch once under its number, and read the last state of each file."""
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(folder)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/states/batch={batch}")

    query = fold_stream(from_events(source)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.schema(STATE).parquet(f"{out}/states")
    last = states.groupBy("path").agg(F.max_by(F.struct("seq", "status", "stt", "summary"), "seq").alias("s"))
    return last.select("path", "s.*").where("status <> 'gone'")
