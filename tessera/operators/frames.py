"""Frames of videos: regular ones by the attention level, and scene cuts that keep their distance from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Period in milliseconds and most regular frames by attention level, most cuts, most frames of a video.
LEVELS = ((67, 1_000, 384), (34, 4_000, 192), (0, 10_000, 96))
MOST_CUTS, MOST_FRAMES = 128, 512


def of_level(attention: Column, place: int) -> Column:
    """Period (place 1) or most regular frames (place 2) of an attention level."""
    out = F.lit(LEVELS[-1][place])
    for level in reversed(LEVELS[:-1]):
        out = F.when(attention >= level[0], F.lit(level[place])).otherwise(out)
    return out


def spaced_cuts(cuts: DataFrame) -> DataFrame:
    """(video, t) of the cuts (video, attention, duration, t; milliseconds) that are kept.

    The first ``MOST_CUTS`` cuts of a video are looked at in order. One nearer than half a period to a regular
    frame, or to a cut that was kept before, goes; and so do all once a video has ``MOST_FRAMES``. Regular frames
    lie at multiples of the period, so the nearest one follows from the time. Which cuts are kept depends on those
    before, so the at most ``MOST_CUTS`` times of a video are folded in one row.

    Defined cases: cuts without a time go; repeated times are one cut.
    """
    period, most = of_level(F.col("attention"), 1), of_level(F.col("attention"), 2)
    seen = cuts.where("t IS NOT NULL").select("video", "attention", "duration", F.col("t").cast("long").alias("t"))
    first = seen.withColumn("k", F.row_number().over(Window.partitionBy("video").orderBy("t"))).where(F.col("k") <= MOST_CUTS)
    regular = F.least(most, F.floor(F.col("duration") / period) + 1)
    nearest = F.least(F.round(F.col("t") / period), regular - 1) * period
    clear = first.where(2 * F.abs(F.col("t") - nearest) >= period).withColumns({"period": period, "room": MOST_FRAMES - regular})
    times = clear.groupBy("video", "period", "room").agg(F.sort_array(F.collect_list("t")).alias("times"))
    none = F.array().cast("array<long>")
    far = lambda kept, t: (F.size(kept) == 0) | (2 * (t - F.element_at(kept, -1)) >= F.col("period"))
    kept = F.aggregate("times", none, lambda kept, t: F.when((F.size(kept) < F.col("room")) & far(kept, t), F.array_append(kept, t)).otherwise(kept))
    return times.select("video", F.explode(kept).alias("t"))
