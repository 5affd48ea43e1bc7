"""Model-backed operators: the dataflow around speech, language and vision models, with stand-ins as defaults.

A model is an object with one method over a batch of inputs, loaded once a task. The language
stand-in returns the first 600 characters of its prompt, the speech stand-in a fixed text, and there is
no vision stand-in: its answer is missing, and the frame is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import cues
from tessera.session import slices


class Generator(Protocol):
    """Texts for prompts; None where the model fails."""

    def generate(self, prompts: list[str]) -> list[str | None]: ...


class Transcriber(Protocol):
    """Texts for windows of samples; None where the model fails."""

    def transcribe(self, windows: list[list[float]]) -> list[str | None]: ...


class Captioner(Protocol):
    """A caption for each frame name; None where the model fails."""

    def caption(self, frames: list[str], detail: int) -> list[str | None]: ...


class HeadOfPrompt:
    def generate(self, prompts: list[str]) -> list[str | None]:
        return [p[:600] for p in prompts]


class FixedText:
    def transcribe(self, windows: list[list[float]]) -> list[str | None]:
        return ["(no speech model is loaded)" for _ in windows]


class NoVision:
    def caption(self, frames: list[str], detail: int) -> list[str | None]:
        return [None for _ in frames]


def with_answers(rows: DataFrame, prompt: str, answer: str, model: Generator) -> DataFrame:
    """rows with a column of the model's answers; failures are null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{answer}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            yield batch.assign(**{answer: model.generate(list(batch[prompt]))})

    return rows.mapInPandas(run, schema)


TIERS = {"recap": "Give the gist in a few lines.", "standard": "Keep every decision, name, number and date.", "detailed": "Keep the order of the material and all of its details."}
DETAILS = {0: "Say in one line what is shown.", 1: "Describe the picture, its text and its people.", 2: "Describe the picture closely: layout, text, numbers, people, actions."}


def map_prompt(tier: Column, video: Column, attention: Column) -> Column:
    """Instruction of the map step; video adds what its attention level asks for."""
    own = F.when(tier == "recap", TIERS["recap"]).when(tier == "detailed", TIERS["detailed"]).otherwise(TIERS["standard"])
    level = F.when(attention < 34, DETAILS[0]).when(attention < 67, DETAILS[1]).otherwise(DETAILS[2])
    return F.when(video, F.concat_ws(" ", own, level)).otherwise(own)


def word_guard(new: Column, old: Column) -> Column:
    """Whether a polished text drifted so far that the old one stays."""
    a, b = T.word_count(old), T.word_count(new)
    return (b == 0) | (F.abs(a - b) > F.greatest(F.floor(a / 20), F.lit(8)))


def polish(docs: DataFrame, model: Generator, target: int = 1000) -> DataFrame:
    """(id, text, kept): each chunk polished, or verbatim where the guard says so; kept counts those."""
    parts = docs.select("id", F.posexplode(cues.chunks(F.col("text"), target)).alias("k", "part"))
    told = with_answers(parts, "part", "new", model)
    stays = F.col("new").isNull() | word_guard(F.col("new"), F.col("part"))
    chosen = told.select("id", "k", F.when(stays, F.col("part")).otherwise(F.col("new")).alias("part"), stays.cast("long").alias("stays"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "\n")
    return chosen.groupBy("id").agg(joined.alias("text"), F.sum("stays").alias("kept"))


def reduce_once(notes: DataFrame, model: Generator) -> DataFrame:
    """(id, notes, summary, verbatim): the model's summary without echoed guides; the notes where it fails."""
    asked = notes.select("id", "notes", F.concat(F.lit("Summarise:\n"), F.col("notes")).alias("prompt"))
    told = with_answers(asked, "prompt", "answer", model)
    failed = F.col("answer").isNull() | (T.trimmed(F.col("answer")) == "")
    return told.select("id", "notes", F.when(failed, F.col("notes")).otherwise(T.strip_guide_echo(F.col("answer"))).alias("summary"), failed.alias("verbatim"))


def map_reduce(docs: DataFrame, model: Generator, target: int = 1000) -> DataFrame:
    """(id, summary, chunks, fallbacks, verbatim): map each chunk (its head where the model fails), join the notes, reduce."""
    parts = docs.select("id", F.posexplode(cues.chunks(F.col("text"), target)).alias("k", "part"))
    told = with_answers(parts, "part", "note", model)
    note = F.coalesce("note", F.concat(F.lit("[chunk "), (F.col("k") + 1).cast("string"), F.lit("] "), F.left("part", F.lit(400))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", note.alias("note")))), lambda x: x["note"]), "\n\n")
    notes = told.groupBy("id").agg(joined.alias("notes"), F.count("*").alias("chunks"), F.sum(F.col("note").isNull().cast("long")).alias("fallbacks"))
    summary = reduce_once(notes.select("id", "notes"), model).select("id", "summary", "verbatim")
    return notes.join(summary, "id").select("id", "summary", "chunks", "fallbacks", "verbatim")


def pick_class(answer: Column, classes: Column, hint: Column) -> Column:
    """The class that the answer names (classes are separated by semicolons), else the hint, else General."""
    own = F.filter(F.transform(F.split(classes, ";"), T.trimmed), lambda x: (x != "") & (F.lower(x) == F.lower(T.trimmed(answer))))
    return F.coalesce(F.get(own, F.lit(0)), F.nullif(hint, F.lit("")), F.lit("General"))


def transcribe(windows: DataFrame, model: Transcriber) -> DataFrame:
    """(take, win, text) of (take, win, samples)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["take", "win"]].assign(text=model.transcribe([list(s) for s in batch["samples"]]))

    return windows.select("take", "win", "samples").mapInPandas(run, "take long, win long, text string")


def transcripts(windows: DataFrame, model: Transcriber) -> DataFrame:
    """(take, text): the windows of a take in order; windows that failed are left out."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("win", "text"))), lambda x: x["text"]), " ")
    return transcribe(windows, model).where("text IS NOT NULL").groupBy("take").agg(text.alias("text"))


def captions(frames: DataFrame, model: Captioner) -> DataFrame:
    """(video, t, caption) of (video, t, file, detail) that got one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [model.caption([f], int(d))[0] for f, d in zip(batch["file"], batch["detail"], strict=True)]
            yield batch[["video", "t"]].assign(caption=pd.Series(out, dtype=object))

    return frames.select("video", "t", "file", "detail").mapInPandas(run, "video long, t long, caption string").where("caption IS NOT NULL")
