"""Sampled signals: frames, floors, gates, envelopes and mixes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_rms(frames: DataFrame) -> DataFrame:
    """(take, f, rms) of frames (take, f, samples): root mean square about the take's mean."""
    sums = frames.select("take", "f", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double")).alias("s"), F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")).alias("q"))
    mean = sums.groupBy("take").agg((F.sum("s") / F.sum("n")).alias("m"))
    m, n = F.col("m"), F.col("n")
    return sums.join(mean, "take").select("take", "f", F.sqrt(F.greatest((F.col("q") - 2 * m * F.col("s") + n * m * m) / n, F.lit(0.0))).alias("rms"))


def block_floor(rms: DataFrame, frames_a_block: int = 50) -> DataFrame:
    """(take, block, floor): the element at a tenth of the sorted frames of each block, at least 1e-6."""
    blocks = rms.groupBy("take", F.floor(F.col("f") / frames_a_block).alias("block")).agg(F.sort_array(F.collect_list("rms")).alias("r"))
    return blocks.select("take", "block", F.greatest(F.get("r", F.floor(F.size("r") / 10).cast("int")), F.lit(1e-6)).alias("floor"))


def envelope_at(points: DataFrame, times: DataFrame) -> DataFrame:
    """(take, t, gain): gain of points (take, t, gain) at times (take, t), linear between neighbours, held at the ends, 1 without points."""
    p = points.select("take", F.col("t").alias("at"), F.col("gain").alias("g"), F.lit(0).alias("kind"))
    q = times.select("take", F.col("t").alias("at"), F.lit(None).cast("double").alias("g"), F.lit(1).alias("kind"))
    line = p.unionByName(q)
    point = F.when(F.col("kind") == 0, F.struct("at", "g"))
    before = F.last(point, ignorenulls=True).over(Window.partitionBy("take").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    # the next point is the last one seen when time runs back: a running value, not a frame for each row
    after = F.last(point, ignorenulls=True).over(Window.partitionBy("take").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0))
    seen = line.withColumn("b", before).withColumn("a", after).where("kind = 1")
    share = (F.col("at") - F.col("b.at")) / (F.col("a.at") - F.col("b.at"))
    between = F.when(F.col("a.at") > F.col("b.at"), F.col("b.g") + (F.col("a.g") - F.col("b.g")) * share).otherwise(F.col("b.g"))
    gain = F.when(F.col("b").isNull() & F.col("a").isNull(), 1.0).when(F.col("b").isNull(), F.col("a.g")).when(F.col("a").isNull(), F.col("b.g")).otherwise(between)
    return seen.select("take", F.col("at").alias("t"), gain.alias("gain"))


def mixdown(samples: DataFrame) -> DataFrame:
    """(i, v) of samples (i, v, gain, pan, muted): panned sums at each place, scaled to a peak of 0.99 only if they exceed 1."""
    angle = (F.col("pan") + 1) * (math.pi / 4)
    fold = F.col("gain") * (F.cos(angle) + F.sin(angle)) / math.sqrt(2)
    mixed = samples.where("NOT muted").groupBy("i").agg(F.sum(F.col("v") * fold).alias("v"))
    peak = mixed.agg(F.max(F.abs("v")).alias("peak"))
    return mixed.join(F.broadcast(peak)).select("i", F.when(F.col("peak") > 1, F.col("v") * 0.99 / F.col("peak")).otherwise(F.col("v")).alias("v"))


#: Fixed values of the gate: frames of calibration, the rise that counts as a change (10 dB) and the seconds in which
#: the floor is then learned anew, the floor's drift, attack and release of level and gain, frames that a gate stays
#: open, and knee and slope of the compression.
CALIBRATION, JUMP, RELEARN_SECONDS, DRIFT = 3000, 3.16, 3, 0.05
LEVEL_UP, LEVEL_DOWN, GAIN_UP, GAIN_DOWN, HELD = 0.9, 0.002, 0.05, 0.0008, 10
KNEE, SLOPE = 0.251, 0.5


def tenth(rms: np.ndarray) -> float:
    """The element at a tenth of the sorted frames, at least 1e-6."""
    return max(float(np.sort(rms)[len(rms) // 10]), 1e-6) if len(rms) else 1e-6


def thresholds(rms: np.ndarray, ratio: float, second: int) -> np.ndarray:
    """Level above which each frame is let through: the floor of the room times ratio, halved while a new floor is learned.

    The floor is followed second by second. Two loud seconds in a row start a window whose own floor counts after it."""
    out, floor = np.empty(len(rms)), tenth(rms[:CALIBRATION])
    window, loud_seconds, learned_at = RELEARN_SECONDS * second, 0, -1
    for start in range(0, len(rms), second):
        past = tenth(rms[start - second : start]) if start else floor
        if start and past > JUMP * floor:
            loud_seconds += 1
            if loud_seconds > 1 and learned_at < 0:
                learned_at = start + window - 1
        elif start:
            loud_seconds, floor = 0, floor + DRIFT * (past - floor)
        stop = min(start + second, len(rms))
        out[start:stop] = ratio * floor
        if learned_at >= 0:
            out[start : min(stop, learned_at)] /= 2
            if learned_at < stop:
                floor, loud_seconds, learned_at = tenth(rms[max(0, learned_at - window) : learned_at + 1]), 0, -1
    return out


def follow(values: np.ndarray, up: float, down: float) -> np.ndarray:
    """A level that runs after values, at one speed upwards and another downwards."""
    out, level = np.empty(len(values)), 0.0
    for k, v in enumerate(values.tolist()):
        level += (v - level) * (up if v > level else down)
        out[k] = level
    return out


def gate_gains(rms: np.ndarray, ratio: float = 2.0, second: int = 50) -> np.ndarray:
    """Gain of each frame from the frames' levels."""
    loud = follow(rms, LEVEL_UP, LEVEL_DOWN) > thresholds(rms, ratio, second)
    frame = np.arange(len(rms))
    last_loud = np.maximum.accumulate(np.where(loud, frame, -HELD)) if len(rms) else frame
    return follow((frame - last_loud < HELD).astype(np.float64), GAIN_UP, GAIN_DOWN)


def denoise(pcm: np.ndarray, ratio: float = 2.0, frame: int = 320, second: int = 50) -> np.ndarray:
    """The gate over the samples of one take."""
    x = pcm.astype(np.float64)
    if not len(x):
        return x
    x -= x.mean()
    starts = np.arange(0, len(x), frame)
    sizes = np.diff(np.append(starts, len(x)))
    v = x * np.repeat(gate_gains(np.sqrt(np.add.reduceat(x * x, starts) / sizes), ratio, second), sizes)
    level = np.abs(v)
    return np.where(level > KNEE, np.sign(v) * (KNEE + (level - KNEE) * SLOPE), v)


def gate(frames: DataFrame, ratio: float = 2.0, second: int = 50) -> DataFrame:
    """(take, f, gain, samples) of frames (take, f, samples) after the gate.

    Levels are taken where the frames are. Only they, a number a frame, come together by take, as their gains
    depend on all that went before; samples are scaled and compressed where they are again."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("f")
        return rows[["take", "f"]].assign(gain=gate_gains(rows["rms"].to_numpy(), ratio, second))

    gains = frame_rms(frames).groupBy("take").applyInPandas(run, "take long, f long, gain double")
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double"))
    mean = frames.groupBy("take").agg((F.sum(total) / F.sum(F.size("samples"))).alias("mean"))
    scaled = F.transform("samples", lambda v: (v.cast("double") - F.col("mean")) * F.col("gain"))
    compressed = F.transform(scaled, lambda v: F.when(F.abs(v) > KNEE, F.signum(v) * (KNEE + (F.abs(v) - KNEE) * SLOPE)).otherwise(v))
    return frames.join(mean, "take").join(gains, ["take", "f"]).select("take", "f", "gain", compressed.alias("samples"))
