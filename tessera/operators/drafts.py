"""Drafts from the operations on them: open, save, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(ops: DataFrame) -> DataFrame:
    """(id, body, updated_at, saves, lost) of the drafts that are there after all operations (id, seq, op, body).

    ``open`` starts a draft with its body unless it is there; ``save`` replaces the body of one that is there, and is
    lost on one that is not; ``delete`` drops it. Whether a draft is there follows from the last opening and the
    last deletion before an operation, so one window a draft in order of ``seq`` says it. ``saves`` counts since the
    draft was opened, ``lost`` over its whole past.

    Defined cases: operations without an id or ``seq``, and unknown ones, take no part; null bodies are empty.
    """
    known = ops.where(F.col("id").isNotNull() & F.col("seq").isNotNull() & F.col("op").isin("open", "save", "delete"))
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda op: F.coalesce(F.max(F.when(F.col("op") == op, F.col("seq"))).over(before), F.lit(-(2**62)))
    seen = known.select("id", "seq", "op", F.coalesce("body", F.lit("")).alias("body"), last("open").alias("opened"), last("delete").alias("gone"))
    there = F.col("opened") > F.col("gone")
    does = F.when(F.col("op") == "delete", "delete").when((F.col("op") == "open") & ~there, "start").when((F.col("op") == "save") & there, "save").when(F.col("op") == "save", "lost")
    done = seen.select("id", "seq", "body", does.alias("does"))
    end = done.groupBy("id").agg(F.max(F.when(F.col("does") == "delete", F.col("seq"))).alias("deleted"), F.count_if(F.col("does") == "lost").alias("lost"))
    live = done.where(F.col("does").isin("start", "save")).join(end, "id").where(F.col("deleted").isNull() | (F.col("seq") > F.col("deleted")))
    return live.groupBy("id", "lost").agg(F.max_by("body", "seq").alias("body"), F.max("seq").alias("updated_at"), F.count_if(F.col("does") == "save").alias("saves")).select("id", "body", "updated_at", "saves", "lost")
