"""Timed segments: cues, speakers, sentence stamps, chunks and diffs."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import slices


def srt_cues(lines: DataFrame, key: str, order: str, duration: Column, cap: int = 2000) -> DataFrame:
    """(key, idx, start_ms, end_ms, text) of transcript lines (key, order, line).

    Stamped lines that go back in time are dropped with what follows on their own line; lines without
    a stamp join the cue before. A cue ends where the next starts, the last one at the duration."""
    lines = lines.withColumn("line", F.regexp_replace("line", r"[ \t\r]+\z", "")).where("line <> ''")
    whole = Window.partitionBy(key).orderBy(order)
    upto = whole.rowsBetween(Window.unboundedPreceding, -1)
    stamped = lines.withColumn("ms", T.parse_stamp(F.col("line"))).withColumn("top", F.max(F.when(F.col("ms") >= 0, F.col("ms"))).over(upto))
    kept = stamped.where((F.col("ms") < 0) | F.col("top").isNull() | (F.col("ms") >= F.col("top")))
    body = F.when(F.col("ms") >= 0, F.regexp_replace("line", r"^[^\]]*\][ \t]*", "")).otherwise(F.col("line"))
    cued = kept.withColumn("idx", F.sum((F.col("ms") >= 0).cast("long")).over(whole)).where("idx BETWEEN 1 AND 20000").withColumn("body", body)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "body"))), lambda x: x["body"]), " ")
    cues = cued.groupBy(key, "idx").agg(F.max("ms").alias("start_ms"), text.alias("text"), F.first(duration).alias("total"))
    by = Window.partitionBy(key).orderBy("idx")
    end = F.coalesce(F.lead("start_ms").over(by), F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("start_ms") + 4000))
    return cues.select(key, "idx", "start_ms", F.when(end <= F.col("start_ms"), F.col("start_ms") + 1000).otherwise(end).alias("end_ms"), F.when(F.col("text") == "", "(silence)").otherwise(F.left("text", F.lit(cap))).alias("text"))


def speaker(turn_flag: Column, key: str, order: str) -> Column:
    """1 or 2, changing after each flagged row."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (1 + F.coalesce(F.sum(turn_flag.cast("long")).over(before), F.lit(0)) % 2).cast("long")


#: White space between words, as Spark's patterns have it.
_SPACES = re.compile("[ \t\n\x0b\f\r]+")


def pack_words(text: str, target: int) -> list[str]:
    """Chunks of words up to target estimated tokens, one more for each space; a longer word stands alone."""
    starts, size = [], 0
    words = [w for w in _SPACES.split(text) if w]
    for at, word in enumerate(words):
        own = (len(word) if word.isascii() else len(word.encode())) // 4 + 1
        if not at or size + 1 + own > target:
            starts.append(at)
            size = own
        else:
            size += 1 + own
    return [" ".join(words[a:b]) for a, b in zip(starts, [*starts[1:], len(words)], strict=True)] if words else [""]


def chunks(text: Column, target: int) -> Column:
    """Greedy packing of words: where a chunk begins depends on the one before, so a text is packed by one loop. Texts go to it some at a time, not in
    Arrow batches of thousands. Null is an empty text."""
    packed = F.udf(lambda t: pack_words(t or "", target), "array<string>", useArrow=False)
    return packed(F.coalesce(text, F.lit("")))


def sentences(segments: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n, order, sentence) of segments (key, order, text): sentences glued over segments.

    Each mark of . ? ! ends one. The first has the place of the first segment; any other that of the segment in
    which the one before ended, as it starts about there. A rest without a mark is the last sentence."""
    flat = F.regexp_replace("text", r"\s+", " ")
    found = segments.select(key, order, F.posexplode(F.regexp_extract_all(flat, F.lit(r"[^.?!]*[.?!]|[^.?!]+"), F.lit(0))).alias("k", "x"))
    pieces = found.select(key, order, "k", F.trim("x").alias("x"), F.col("x").rlike(r"[.?!]$").alias("ends")).where("x <> ''")
    before = Window.partitionBy(key).orderBy(order, "k").rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.withColumns({"n": F.coalesce(F.sum(F.col("ends").cast("long")).over(before), F.lit(0)), "since": F.max(F.when(F.col("ends"), F.col(order))).over(before)})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "k", "x"))), lambda p: p["x"]), " ")
    return numbered.groupBy(key, "n").agg(F.coalesce(F.max("since"), F.min(order)).alias(order), text.alias("sentence"))


def lines_of(text: str | None) -> list[str]:
    """Lines of a text; a line feed at its end starts no line, and nothing is one empty line."""
    out = (text or "").split("\n")
    return out[:-1] if len(out) > 1 and not out[-1] else out


def _bits(places: list[int], size: int) -> int:
    """A number with ones at these places."""
    found = bytearray(size // 8 + 1)
    for p in places:
        found[p >> 3] |= 1 << (p & 7)
    return int.from_bytes(found, "little")


def lcs_diff(old: list[str], new: list[str], most: int | None = 2000) -> list[tuple[str, str]]:
    """Line diff by the longest common subsequence, removals first; past ``most`` lines, unless it is None, all old ones go and all new ones come.

    A row of the table of lengths is one number: bit p is 0 where taking in the p-th line from the end of ``new``
    makes the subsequence longer. A row follows from the one below it by an addition, and the length at a place is
    the number of zeros up to it. One row in so many is kept, and those between are made again as the walk comes to
    them, so rows are held for the root of the number of old lines only."""
    n, m = len(old), len(new)
    if most is not None and max(n, m) > most:
        return [("-", x) for x in old[:most]] + [("+", x) for x in new[:most]]
    places: dict[str, list[int]] = {}
    for p, line in enumerate(reversed(new)):
        places.setdefault(line, []).append(p)
    # only for lines that stand in many places, which are few
    often = {line: _bits(at, m) for line, at in places.items() if len(at) ** 2 >= m}
    full = (1 << m) - 1

    def above(row: int, line: str) -> int:
        if line not in places:
            return row
        hits = often[line] if line in often else _bits(places[line], m)
        return (row + (row & hits) | row & ~hits) & full

    step = math.isqrt(n) + 1
    kept, row = {n: full}, full
    for i in range(n - 1, -1, -1):
        row = above(row, old[i])
        if not i % step:
            kept[i] = row
    rows: dict[int, int] = {}
    out, i, j, left = [], 0, 0, m - row.bit_count()
    while i < n or j < m:
        if i < n and j < m and old[i] == new[j]:
            out.append((" ", old[i]))
            i, j, left = i + 1, j + 1, left - 1
            continue
        if i < n and j < m and i + 1 not in rows:
            top = min(i // step * step + step, n)
            rows = {top: kept[top]}
            for k in range(top - 1, i, -1):
                rows[k] = above(rows[k + 1], old[k])
        # without the old line, the rest is as long as with it
        if i < n and (j == m or m - j - (rows[i + 1] & ((1 << (m - j)) - 1)).bit_count() == left):
            out.append(("-", old[i]))
            i += 1
        else:
            out.append(("+", new[j]))
            j += 1
    return out


def line_diffs(texts: DataFrame) -> DataFrame:
    """(id, diff) of (id, old, new): the diff of all lines as an array of t, text and chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in slices(batches):
            both = zip(rows["old"], rows["new"], strict=True)
            yield pd.DataFrame({"id": rows["id"].array, "diff": [[{"t": t, "text": x, "chunk": 0} for t, x in lcs_diff(lines_of(a), lines_of(b), None)] for a, b in both]})

    return texts.select("id", "old", "new").mapInPandas(run, "id long, diff array<struct<t: string, text: string, chunk: int>>")
