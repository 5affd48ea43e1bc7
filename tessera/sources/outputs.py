"""Operations on notes in an output folder, with the files that lie beside them.

``rename`` gives a note and its files another stem, unless that is taken; ``dismiss`` hides the row and leaves the
files; ``delete`` drops both, and counts files that were gone already. All operations of a batch are judged by
what the folder held before it; of two renames to one stem, the one of the lesser id has it. What is accepted can
then be done in any order and again: a renamed note is linked to its new name, which fails if that exists, before
its old name goes.

Defined cases: a note that is not there, an empty stem, and one with folders in it are refused; of several operations
on one note, delete counts before dismiss before rename.

A folder of very many notes can have shelves, folders below it in which notes lie by a hash of their stems, so that no
task lists or changes all of it; one shelf is the folder itself.
"""

from __future__ import annotations

import contextlib
import os
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import mounted
from tessera.sources.tree import tree

#: Endings of the files beside a note.
BESIDE = (".md.json", ".md.diff.json", ".srt")
DONE = "id long, stem string, op string, next string, result string, missing int"


def shelf(stem: Column, shelves: int) -> Column:
    """Path below the folder where the files of a stem lie, up to the stem itself."""
    return stem if shelves == 1 else F.concat((F.crc32(stem.cast("binary")) % shelves).cast("string"), F.lit("/"), stem)


def _shelf(stem: str, shelves: int) -> str:
    return stem if shelves == 1 else f"{zlib.crc32(stem.encode()) % shelves}/{stem}"


def listed(spark: SparkSession, folder: str, shelves: int = 1, content: bool = False) -> DataFrame:
    """(name, content) of the files in a folder, without their shelves."""
    files = tree(spark, folder, depth=int(shelves > 1), content=content)
    return files.select((F.regexp_replace("relative", r"^[^/]*/", "") if shelves > 1 else F.col("relative")).alias("name"), "content")


def stems(spark: SparkSession, folder: str, shelves: int = 1) -> DataFrame:
    """(stem) of the notes in a folder."""
    return listed(spark, folder, shelves).select(F.regexp_extract("name", r"^(.+)\.md$", 1).alias("stem")).where("stem <> ''")


def judged(ops: DataFrame, there: DataFrame) -> DataFrame:
    """(id, stem, op, next, result) of operations (id, stem, op, next): accepted, taken, absent or refused."""
    rank = F.when(F.col("op") == "delete", 0).when(F.col("op") == "dismiss", 1).otherwise(2)
    one = ops.withColumn("next", F.regexp_replace(F.trim(F.coalesce("next", F.lit(""))), r"(\.md)+$", "")).withColumn("place", F.row_number().over(Window.partitionBy("stem").orderBy(rank, "id"))).where("place = 1")
    held = there.select("stem", F.lit(True).alias("there")).distinct()
    known = one.join(held, "stem", "left").join(held.toDF("next", "taken"), "next", "left")
    bad = (F.col("op") == "rename") & ((F.col("next") == "") | F.col("next").rlike(r"[/\\\x00]|^\.\.?$"))
    first = F.row_number().over(Window.partitionBy("next", F.col("op") == "rename", bad).orderBy("id")) == 1
    result = F.when(F.col("there").isNull(), "absent").when(bad, "refused").when((F.col("op") == "rename") & (F.col("taken") | ~first), "taken").otherwise("accepted")
    return known.withColumn("result", result).select("id", "stem", "op", "next", "result")


def do_one(folder: str, stem: str, op: str, next: str, shelves: int = 1) -> int:
    """Carry out an accepted operation; the number of files that were not there."""
    missing = 0
    stem, next = _shelf(stem, shelves), _shelf(next, shelves)
    if op == "rename":
        os.makedirs(os.path.dirname(os.path.join(folder, next)), exist_ok=True)
    for ending in (*BESIDE, ".md"):  # the note itself goes last
        old, new = os.path.join(folder, stem + ending), os.path.join(folder, next + ending)
        if op == "delete":
            try:
                os.remove(old)
            except FileNotFoundError:
                missing += 1
        elif op == "rename" and os.path.exists(old):
            with contextlib.suppress(FileExistsError):
                os.link(old, new)
            if os.path.samefile(old, new):
                os.remove(old)
    return missing


def apply(ops: DataFrame, folder: str, shelves: int = 1) -> DataFrame:
    """DONE rows; missing counts the files of deleted notes that were not there."""
    top = mounted(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            missing = [do_one(top, r.stem, r.op, r.next, shelves) if r.result == "accepted" else 0 for r in rows.itertuples(index=False)]
            yield rows.assign(missing=missing)

    # judged before anything is done: what is listed later would hold renamed notes
    verdicts = judged(ops, stems(ops.sparkSession, folder, shelves))
    # files are work for all tasks, also where the rows are few pieces
    return verdicts.repartition(ops.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, DONE)
