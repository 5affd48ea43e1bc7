"""Line dedup: three-line windows that stand elsewhere before are removed, in DataFrame functions only.

A window is three consecutive lines (split at line feeds, white space at their ends ignored); a text
of one or two lines is one window. Windows without a word do not count. Occurrences are ordered by
(doc_id, row, position); every occurrence but the first has its lines marked, marks are merged, and
marked lines go. Windows are compared by two independent 64-bit hashes.

Defined cases: null text stays null and takes part in nothing; empty text stays empty; each row is a
document of its own, whatever its doc_id: rows that share a doc_id (or have none, which comes last) are
ordered by their place in the table, and of full copies all but the first lose their lines. Other
columns pass through under any name, but n_lines and n_removed, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.staging import with_rows

WINDOW = 3
_WORD = r"[^\x20\x09-\x0D]"


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """row, doc_id, pos, h1, h2 of every window with a word."""
    lines = F.transform(F.split("own.text", "\n", -1), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    split = rows.where("own.text IS NOT NULL").select("row", "own.doc_id", lines.alias("l"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("l") - (window - 1), F.lit(1)))
    cut = split.select("row", "doc_id", "l", F.explode(starts).alias("pos"))
    part = F.array_join(F.slice("l", F.col("pos"), F.lit(window)), "\n")
    found = cut.select("row", "doc_id", (F.col("pos") - 1).alias("pos"), part.alias("p")).where(F.col("p").rlike(_WORD))
    return found.select("row", "doc_id", "pos", F.xxhash64("p").alias("h1"), F.xxhash64(F.lit("second"), "p").alias("h2"))


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """row, pos of every occurrence of a window after its first, for rows (row, own) of ``with_rows``. The least place of
    a hash is pre-aggregated, and a hot one meets its occurrences in a join whose large partitions Spark splits."""
    found = _windows(rows, window)
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc"), F.col("row").alias("row"), F.col("pos").alias("pos"))
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = (F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos"))
    return found.hint("merge").join(first.hint("merge"), ["h1", "h2"]).where(later).select("row", "pos")


def _deduped(docs: DataFrame, window: int) -> DataFrame:
    """own, text without its repeated lines, n_lines, n_removed."""
    rows = with_rows(docs)
    places = repeated_windows(rows, window).groupBy("row").agg(F.collect_list("pos").alias("pos"))
    joined = rows.join(places, "row", "left").select("own", "pos", F.split("own.text", "\n", -1).alias("l"))
    marks = F.array_distinct(F.flatten(F.transform("pos", lambda p: F.sequence(p, p + (window - 1)))))
    keep = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), marks)
    kept = joined.withColumn("keep", F.when(F.col("pos").isNotNull(), keep)).withColumn("left", F.transform("keep", lambda i: F.get("l", i)))
    none = F.col("own.text").isNull()
    return kept.select(
        "own",
        F.when(F.col("left").isNull(), F.col("own.text")).otherwise(F.array_join("left", "\n")).alias("text"),
        F.when(none, 0).otherwise(F.size("l")).cast("long").alias("n_lines"),
        F.when(F.col("left").isNull(), 0).otherwise(F.size("l") - F.size("left")).cast("long").alias("n_removed"),
    )


def _own(name: str) -> Column:
    return F.col("own").getField(name).alias(name)


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with text without its repeated lines, and n_lines, n_removed (long; 0 for null text)."""
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return _deduped(docs, window).select(*map(_own, names), "text", "n_lines", "n_removed")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Pipeline form: the columns of docs; a text whose every line stands elsewhere before goes with its row."""
    left = _deduped(docs, WINDOW).where("n_removed = 0 OR n_removed < n_lines")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return left.select(*[new[c] if c in new else _own(c) for c in docs.columns])
