"""Moves of draft folders between two bases, safe to repeat after a crash at any step.

A folder goes in four steps: its files' digests are written down in a journal; the files are copied beside their
place and compared with the digests; the copy takes its place by a rename; the source is dropped, and the
journal says so. A repeated move looks at what is there: a place that holds what the journal says was reached,
one that holds anything else is left alone, and so is its source. Text is in one of the two places at any time.

Folders are dealt to tasks, each is the work of one. Both bases are folders that all executors mount; a second
attempt of a task finds what the first one did.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import mounted

#: The files of a draft, in the order in which they are copied.
FILES = ("raw.md", "summary.md", "merged.md", "meta.json")
JOURNAL = ".moves"
MOVED = "stem string, result string, files int, bytes long"


def digests(folder: str) -> dict[str, str]:
    """SHA-256 of each file of a draft that is there."""
    out = {}
    for name in FILES:
        if os.path.isfile(path := os.path.join(folder, name)):
            with open(path, "rb") as file:
                out[name] = hashlib.file_digest(file, "sha256").hexdigest()
    return out


def _put(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "w", encoding="utf-8") as file:
        file.write(text)
        file.flush()
        os.fsync(file.fileno())
    os.replace(own, path)


def _noted(path: str) -> dict | None:
    try:
        with open(path, encoding="utf-8") as file:
            return json.load(file)
    except (OSError, ValueError):
        return None


def confined(stem: str) -> bool:
    """Whether a stem names a folder directly below the base."""
    return bool(stem) and stem not in (".", "..", JOURNAL) and not any(ch in stem for ch in "/\\:\0")


def move_one(source: str, target: str, stem: str, at: Callable[[str], None] = lambda step: None) -> tuple[str, int, int]:
    """(result, files, bytes) of moving one draft: moved, absent, taken (something else is in its place), refused or changed (a copy differs)."""
    if not confined(stem):
        return "refused", 0, 0
    old, new, note = os.path.join(source, stem), os.path.join(target, stem), os.path.join(target, JOURNAL, f"{stem}.json")
    entry = _noted(note)
    if os.path.isdir(new):
        if entry is None or digests(new) != entry["files"]:
            return ("taken" if os.path.isdir(old) else "absent"), 0, 0
    else:
        if not os.path.isdir(old):
            return "absent", 0, 0
        entry = {"stem": stem, "files": digests(old), "dropped": False}
        at("noting")
        _put(note, json.dumps(entry))
        at("noted")
        beside = os.path.join(target, JOURNAL, f"{stem}.{uuid.uuid4().hex}")
        os.makedirs(beside)
        for name in entry["files"]:
            shutil.copyfile(os.path.join(old, name), os.path.join(beside, name))
            at(f"copied {name}")
        if digests(beside) != entry["files"]:
            shutil.rmtree(beside)
            return "changed", 0, 0
        at("compared")
        try:
            os.rename(beside, new)
        except OSError:  # another attempt was first
            shutil.rmtree(beside)
            if digests(new) != entry["files"]:
                return "taken", 0, 0
        at("placed")
    # what was written into the source since it was copied is not lost: such a source stays
    if os.path.isdir(old):
        left = digests(old)
        if not left.items() <= entry["files"].items():
            return "changed", 0, 0
        for name in left:
            os.remove(os.path.join(old, name))
            at(f"dropped {name}")
        shutil.rmtree(old)
    at("dropped")
    _put(note, json.dumps(entry | {"dropped": True}))
    return "moved", len(entry["files"]), sum(os.path.getsize(os.path.join(new, n)) for n in entry["files"])


def move_all(stems: DataFrame, source: str, target: str) -> DataFrame:
    """MOVED rows for the drafts (stem) between two base folders."""
    old, new = mounted(source), mounted(target)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(new, exist_ok=True)
        for rows in batches:
            yield pd.DataFrame([(s, *move_one(old, new, s or "")) for s in rows["stem"]], columns=["stem", "result", "files", "bytes"])

    return stems.select("stem").repartition(F.col("stem")).mapInPandas(run, MOVED)
