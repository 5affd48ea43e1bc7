"""Hierarchical reduction of long notes: split down, reduce the leaves, join siblings on the way up.

Down, level by level: notes over the limit are split near the middle, at a line feed, else a space, up to
``DEEPEST`` times. A level is written once, its leaves apart from what goes on, and each of the two is read
once. Up: siblings meet by their parent's place, are joined under a heading, and polished by the model if
the sum fits the limit. Word targets follow the shares of length; a row carries those of its ancestors.

Defined cases: null notes are empty; where the model fails or answers nothing, a part stays as it is, and
the document counts as verbatim. Cuts go by characters, the limit by estimated tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.models import Generator
from tessera.session import scratch

#: Splits of a text, room for prompt and answer, least limit, and the heading between siblings.
DEEPEST, ROOM, LEAST, HEADING = 6, 2048, 512, "\n\n## Part\n\n"
_PART = "id long, pos string, body string, targets array<long>"


def token_limit(context: int) -> int:
    return context - ROOM if context > ROOM else LEAST


def prompt(body: Column, target: Column) -> Column:
    return F.concat(F.lit("Summarise in about "), target.cast("string"), F.lit(" words:\n"), body)


def halves(parts: DataFrame) -> DataFrame:
    """Both halves of each part; pos grows by 0 or 1, targets by the half's own."""
    size = F.length("body")
    mid = F.floor(size / 2).cast("int")
    feed = F.instr(F.substring(F.col("body"), F.col("mid") + 1, size), "\n")
    early = F.left("body", F.col("mid") + 1)
    space = F.when(early.contains(" "), F.length(F.regexp_extract(early, "(?s)^(.*) ", 1))).otherwise(F.col("mid"))
    near = (feed > 0) & (F.col("mid") + feed - 1 <= F.floor(size * 3 / 4))
    cut = parts.withColumn("mid", mid).withColumn("cut", F.when(near, F.col("mid") + feed - 1).otherwise(space).cast("int"))
    target = F.element_at("targets", -1)
    share = F.floor(target * (F.col("cut") / size)).cast("long")
    both = F.array(
        F.struct(F.lit("0").alias("side"), F.left("body", F.col("cut")).alias("half"), share.alias("own")),
        F.struct(F.lit("1").alias("side"), F.substring(F.col("body"), F.col("cut") + 1, size).alias("half"), (target - share).alias("own")),
    )
    each = cut.select("id", "pos", "targets", F.explode(both).alias("h"))
    return each.select("id", F.concat("pos", "h.side").alias("pos"), F.col("h.half").alias("body"), F.array_append("targets", F.col("h.own")).alias("targets"))


def levels(notes: DataFrame, limit: int, target: int, deepest: int = DEEPEST) -> list[DataFrame]:
    """The leaves of each depth, as (id, pos, body, targets), of notes (id, notes)."""
    spark, out = notes.sparkSession, []
    level = notes.select(F.col("id").cast("long").alias("id"), F.lit("").alias("pos"), F.coalesce("notes", F.lit("")).alias("body"), F.array(F.lit(target).cast("long")).alias("targets"))
    for depth in range(deepest + 1):
        path = scratch(spark, "frontier")
        long = (T.est_tokens(F.col("body")) > limit) if depth < deepest else F.lit(False)
        level.withColumn("long", long.cast("int")).write.partitionBy("long").parquet(path)
        found = spark.read.schema(f"{_PART}, long int").parquet(path)
        out.append(found.where("long = 0").drop("long"))
        more = found.where("long = 1").drop("long")
        if more.isEmpty():
            break
        level = halves(more)
    return out


def _answered(parts: DataFrame, model: Generator) -> DataFrame:
    """(id, pos, body, targets, verbatim): the model's answer in place of body where there is a prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch["prompt"].notna()
            answer = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if asked.any():
                answer[asked] = model.generate(list(batch.loc[asked, "prompt"]))
            yield batch.assign(answer=answer)

    told = parts.mapInPandas(run, f"{_PART}, verbatim boolean, prompt string, answer string")
    failed = F.col("prompt").isNotNull() & (F.col("answer").isNull() | (T.trimmed(F.col("answer")) == ""))
    body = F.when(F.col("prompt").isNull() | failed, F.col("body")).otherwise(T.strip_guide_echo(F.col("answer")))
    return told.select("id", "pos", body.alias("body"), "targets", (F.col("verbatim") | failed).alias("verbatim"))


def reduce_long(notes: DataFrame, model: Generator, context: int = 4096, target: int = 100, deepest: int = DEEPEST) -> DataFrame:
    """(id, summary, parts, depth, verbatim) for notes (id, notes): one row each, with the number of leaves and their greatest depth."""
    limit = token_limit(context)
    found = levels(notes, limit, target, deepest)
    below = None
    for depth in reversed(range(len(found))):
        own = found[depth].select("id", "pos", "body", "targets", F.lit(False).alias("verbatim"), prompt(F.col("body"), F.element_at("targets", -1)).alias("prompt"))
        done = _answered(own, model).withColumns({"parts": F.lit(1).cast("long"), "depth": F.lit(depth).cast("long")})
        if below is not None:
            side = F.right("pos", F.lit(1))
            up = below.groupBy("id", F.left("pos", F.lit(depth)).alias("pos")).agg(
                F.max(F.when(side == "0", F.col("body"))).alias("a"), F.max(F.when(side == "1", F.col("body"))).alias("b"), F.max(F.slice("targets", 1, depth + 1)).alias("targets"),
                F.max("verbatim").alias("verbatim"), F.sum("parts").alias("parts"), F.max("depth").alias("depth"),
            )
            up = up.select("id", "pos", F.concat("a", F.lit(HEADING), "b").alias("body"), "targets", "verbatim", "parts", "depth")
            told = _kept(up, model, limit)
            done = told.unionByName(done)
        below = done
    return below.select("id", F.col("body").alias("summary"), "parts", "depth", "verbatim")


def _kept(joined: DataFrame, model: Generator, limit: int) -> DataFrame:
    """Joined siblings, polished where they fit; ``parts`` and ``depth`` go along inside the list of targets."""
    fits = T.est_tokens(F.col("body")) <= limit
    carried = F.concat("targets", F.array("parts", "depth"))
    asked = joined.select("id", "pos", "body", carried.alias("targets"), "verbatim", F.when(fits, prompt(F.col("body"), F.element_at("targets", -1))).alias("prompt"))
    n = F.size("targets")
    return _answered(asked, model).select("id", "pos", "body", F.slice("targets", F.lit(1), n - 2).alias("targets"), "verbatim", F.element_at("targets", -2).alias("parts"), F.element_at("targets", -1).alias("depth"))
