"""What becomes of a source once its output is written: kept, deleted, or archived beside the output.

An archived source is ``<title>.src<extension>``; a name that is taken gets `` (2)`` and so on at its end. A copy is
made beside its place and linked into it, which fails if another one was first. A repeated task finds an archive
with the same bytes and makes no second one. Videos are always kept, and unknown settings keep too.
"""

from __future__ import annotations

import filecmp
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.session import mounted

DONE = "source string, action string, archived string"


def archive_extension(path: str) -> str:
    """The source's extension in lower case; that of a wave file where it has none or a long one."""
    name = os.path.basename(path.replace("\\", "/"))
    ext = name[name.rfind(".") :].lower() if "." in name else ""
    return ext if 0 < len(ext) <= 6 else ".wav"


def archive(source: str, folder: str, title: str) -> str:
    """Name of the archived source."""
    os.makedirs(folder, exist_ok=True)
    base = f"{title}.src{archive_extension(source)}"
    own = os.path.join(folder, f".{uuid.uuid4().hex}")
    shutil.copyfile(source, own)
    try:
        n = 1
        while True:
            name = base if n == 1 else f"{base} ({n})"
            place = os.path.join(folder, name)
            if os.path.exists(place) and os.path.samefile(place, source):
                return name
            try:
                os.link(own, place)
                return name
            except FileExistsError:
                if filecmp.cmp(own, place, shallow=False):
                    return name
                n += 1
    finally:
        os.remove(own)


def apply_one(source: str, folder: str, title: str, setting: str, video: bool) -> tuple[str, str | None]:
    if video or setting not in ("delete", "archive"):
        return "keep", None
    if not os.path.isfile(source):
        return "absent", None
    if setting == "archive":
        return "archive", archive(source, folder, title)
    os.remove(source)
    return "delete", None


def apply(rows: DataFrame, sources: str, outputs: str) -> DataFrame:
    """DONE rows for (source, title, setting, video); sources are names below one folder, outputs go to another. Both are mounted on all nodes."""
    old, new = mounted(sources), mounted(outputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(r.source, *apply_one(os.path.join(old, r.source), new, r.title, r.setting, bool(r.video))) for r in batch.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["source", "action", "archived"])

    return rows.select("source", "title", "setting", "video").mapInPandas(run, DONE)
