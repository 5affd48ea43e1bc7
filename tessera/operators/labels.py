"""Day and class of items, from their names, what is remembered of them, and their files' dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def day_and_class(items: DataFrame, memory: DataFrame, dates: DataFrame) -> DataFrame:
    """(id, day, class) of items (id, shown, real): paths as they are shown, and of what is stored.

    The day is read from the shown name without folder and extension; else remembered (memory: shown, day, class);
    else the date of the stored file, else of the shown one (dates: path, date); else Day 1. The class is
    remembered, or the folder of the shown path, or General.

    Defined cases: an item without a shown path has an empty one; of several memories or dates of a path, the
    greatest counts; empty labels are none.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    held = memory.groupBy("shown").agg(F.max(some("day")).alias("m_day"), F.max(some("class")).alias("m_class"))
    date = dates.groupBy("path").agg(F.max("date").cast("string").alias("date"))
    own = items.select("id", F.coalesce("shown", F.lit("")).alias("shown"), "real")
    joined = own.join(held, "shown", "left").join(date.toDF("real", "real_date"), "real", "left").join(date.toDF("shown", "shown_date"), "shown", "left")
    stem = F.coalesce(F.nullif(T.stem(F.col("shown")), F.lit("")), F.col("shown"))
    day = F.coalesce(T.parse_day(stem), "m_day", "real_date", "shown_date", F.lit("Day 1"))
    return joined.select("id", day.alias("day"), F.coalesce("m_class", F.nullif(T.parent_name(F.col("shown")), F.lit("")), F.lit("General")).alias("class"))
