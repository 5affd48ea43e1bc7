"""Mixes of multi-track projects, with the stored blocks as rows.

A project file is opened in one task, which lists the blocks that are heard, with their samples, and where they
lie in the mix. The blocks are dealt to all tasks, each adds its part to the pieces of the mix that it meets,
and pieces are summed where they come together. A whole mix is never in one place.

Defined cases: a file that cannot be read gives one row with its reason and no samples; pieces without sound are
absent; null contents are unreadable.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpointed, slices
from tessera.sources import audio

#: Places of a piece of a mix.
PIECE = 1 << 16
_FIELDS = [f.name for f in dataclasses.fields(audio.Block)]
_BLOCK = (
    "path string, project_rate double, places long, error string, k int, first long, size long, skip long, ratio double, rate double, gain double, "
    "start long, end long, form int, blob binary, points array<array<double>>"
)


def blocks(files: DataFrame) -> DataFrame:
    """The blocks of (path, content) that are heard; a file without any has one row with the reason."""

    exact = {"double": float, "long": int, "int": int, "binary": bytes, "string": str, "array<array<double>>": lambda v: [[float(x) for x in p] for p in v]}
    types = [exact[x.split()[1]] for x in _BLOCK.split(", ")]

    def listed(path: str, raw: bytes | None) -> list[tuple]:
        try:
            rate, places, found = audio.heard_blocks(bytes(raw or b""))
        except ValueError as e:
            return [(path, None, 0, str(e), *[None] * (len(_FIELDS) + 1))]
        rows = [(path, rate, places, None, k, *[getattr(b, f) for f in _FIELDS]) for k, b in enumerate(found)]
        return [tuple(None if v is None else of(v) for v, of in zip(r, types, strict=True)) for r in rows]

    # files go to Python some at a time: an Arrow batch is thousands of rows, which files are too large for
    rows = F.udf(listed, f"array<struct<{', '.join(': '.join(x.split(' ', 1)) for x in _BLOCK.split(', ')).replace('long', 'bigint')}>>", useArrow=False)
    return files.select(rows("path", "content").alias("x")).select(F.inline("x"))


def mixes(files: DataFrame, piece: int = PIECE) -> DataFrame:
    """(path, rate, places, error, piece, samples): the mono mix of each project in pieces of so many places."""
    listed = checkpointed(blocks(files).repartition(F.xxhash64("path", "k")))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in slices(batches):
            out = []
            for row in rows.to_dict("records"):
                block = audio.Block(**{f: row[f] for f in _FIELDS} | {"points": [tuple(p) for p in row["points"]]})
                at, value = block.mixed()
                for low in range(at // piece * piece, at + len(value), piece):
                    part = value[max(0, low - at) : low + piece - at]
                    out.append((row["path"], low // piece, max(0, at - low), part))
            yield pd.DataFrame(out, columns=["path", "piece", "at", "samples"])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        size = max(a + len(v) for a, v in zip(rows["at"], rows["samples"], strict=True))
        mix = np.zeros(size)
        for a, v in sorted(zip(rows["at"], rows["samples"], strict=True), key=lambda x: (x[0], len(x[1]))):
            mix[a : a + len(v)] += v
        return pd.DataFrame({"path": rows["path"][:1], "piece": rows["piece"][:1], "samples": [mix]})

    parts = listed.where("error IS NULL").mapInPandas(add, "path string, piece long, at long, samples array<double>")
    mixed = checkpointed(parts.groupBy("path", "piece").applyInPandas(summed, "path string, piece long, samples array<double>"))
    peak = mixed.groupBy("path").agg(F.max(F.array_max(F.transform("samples", lambda v: F.abs(v)))).alias("peak"))
    about = listed.groupBy("path").agg(F.max("project_rate").alias("rate"), F.max("places").alias("places"), F.max("error").alias("error"))
    scale = F.when(F.col("peak") > 1, audio.LOUDEST / F.col("peak")).otherwise(1.0)
    levelled = mixed.join(peak, "path").select("path", "piece", F.transform("samples", lambda v: v * scale).alias("samples"))
    return about.join(levelled, "path", "left").select("path", "rate", "places", "error", "piece", "samples")
