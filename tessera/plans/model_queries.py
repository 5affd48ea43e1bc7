"""Queries of model-backed operators with their stand-ins, and of what surrounds the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import html as H
from tessera.functions import text as T
from tessera.operators import fetch, models
from tessera.plans.scalar_queries import _docs
from tessera.plans.source_queries import _takes
from tessera.registry import query, table
from tessera.sources import audio

c = F.col


def _case(column: str, of: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in of.items() if k != default) + f" ELSE '{of[default]}' END"


_D = models.DETAILS
_docs(
    "fn_prompts",
    {"tier": "CASE doc_id % 4 WHEN 0 THEN 'recap' WHEN 1 THEN 'detailed' WHEN 2 THEN 'standard' ELSE 'x' END", "video": "doc_id % 2 = 0", "a": "doc_id % 101"},
    {"prompt": lambda: models.map_prompt(c("tier"), c("video"), c("a"))},
    {"prompt": f"CASE WHEN video THEN concat_ws(' ', {_case('tier', models.TIERS, 'standard')}, CASE WHEN a < 34 THEN '{_D[0]}' WHEN a < 67 THEN '{_D[1]}' ELSE '{_D[2]}' END) ELSE {_case('tier', models.TIERS, 'standard')} END"},
)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "text")


@query("mdl_llm_generate", "SELECT doc_id AS id, left(text, 600) AS answer FROM documents")
def mdl_llm_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.with_answers(_texts(spark, sf_dir), "text", "answer", models.HeadOfPrompt()).select("id", "answer")


@query("mdl_polish")
def mdl_polish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.polish(_texts(spark, sf_dir), models.HeadOfPrompt())


@query("mdl_reduce_once", "SELECT doc_id AS id, text AS notes, regexp_replace(left('Summarise:' || chr(10) || text, 600), '\\n+$', '') AS summary, false AS verbatim FROM documents")
def mdl_reduce_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.reduce_once(_texts(spark, sf_dir).withColumnRenamed("text", "notes"), models.HeadOfPrompt()).withColumn("summary", c("summary"))


@query("mdl_map_reduce")
def mdl_map_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.map_reduce(_texts(spark, sf_dir), models.HeadOfPrompt())


@query("mdl_class_pick", "SELECT doc_id, CASE WHEN lower(lang) IN ('en', 'de') THEN upper(lang) WHEN doc_id % 3 = 0 THEN source ELSE 'General' END AS class FROM documents")
def mdl_class_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer is the language; known classes are two of them; the folder is a hint for every third document."""
    hint = F.when(c("doc_id") % 3 == 0, c("source")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", models.pick_class(F.concat(c("lang"), F.lit(" ")), F.lit("EN; DE ;"), hint).alias("class"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(c("label").cast("long").alias("take"), c("vec_id").alias("win"), c("embedding").alias("samples"))


@query("mdl_stt_window", "SELECT CAST(label AS BIGINT) AS take, vec_id AS win, '(no speech model is loaded)' AS text FROM embeddings")
def mdl_stt_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.transcribe(_windows(spark, sf_dir), models.FixedText())


@query("mdl_stt_drive", "SELECT CAST(label AS BIGINT) AS take, string_agg('(no speech model is loaded)', ' ') AS text FROM embeddings GROUP BY label")
def mdl_stt_drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.transcripts(_windows(spark, sf_dir), models.FixedText())


@query("mdl_caption", "SELECT CAST(0 AS BIGINT) AS video, CAST(0 AS BIGINT) AS t, '' AS caption WHERE false")
def mdl_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a vision model every frame is skipped."""
    frames = table(spark, sf_dir, "events").select(c("user_id").alias("video"), c("event_id").alias("t"), F.concat(c("event_id").cast("string"), F.lit(".jpg")).alias("file"), (c("event_id") % 3).alias("detail"))
    return models.captions(frames, models.NoVision())


@query("mdl_validate", "SELECT role, ok, message FROM (VALUES ('stt', true, 'stand-in'), ('llm', true, 'stand-in'), ('vlm', false, 'no vision model')) v(role, ok, message)")
def mdl_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tiny run of each model."""
    got = [("stt", models.FixedText().transcribe([[0.0]])[0]), ("llm", models.HeadOfPrompt().generate(["x"])[0]), ("vlm", models.NoVision().caption(["x"], 0)[0])]
    return spark.createDataFrame([(r, a is not None, "stand-in" if a is not None else "no vision model") for r, a in got], "role string, ok boolean, message string")


@query("src_media_decode")
def src_media_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 kHz mono files pass as they are; other ones need an external decoder, which is not here, and say so."""

    def run(batches):
        import pandas as pd

        for rows in batches:
            out = []
            for path, raw in zip(rows["path"], rows["content"], strict=True):
                try:
                    out.append((path, len(audio.speech(bytes(raw))), None))
                except ValueError as e:
                    out.append((path, None, f"needs a decoder: {e}"))
            yield pd.DataFrame(out, columns=["path", "frames", "error"])

    return _takes(spark, sf_dir).mapInPandas(run, "path string, frames long, error string")


@query("src_web_research")
def src_web_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as if fetched for a search: query terms, allowed address, an excerpt of 1200 characters unless it has under 80."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", H.extract_html(c("html")).alias("body"))
    found = pages.where(T.url_allowed(c("url"))).select("page_id", F.array_join(T.query_terms(c("body"), 6), " ").alias("terms"), F.left("body", F.lit(1200)).alias("excerpt"))
    return found.where(F.length("excerpt") >= 80)


#: What a server answers first and then, and how much of a file is there, by document.
_ANSWERS = {
    "have": "CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN octet // 3 WHEN 2 THEN octet // 2 ELSE CASE WHEN doc_id % 8 = 3 THEN octet ELSE octet + 5 END END",
    "first": "CASE doc_id % 7 WHEN 0 THEN 206 WHEN 1 THEN 206 WHEN 2 THEN 200 WHEN 3 THEN 416 WHEN 4 THEN 404 WHEN 5 THEN 206 ELSE 0 END",
    "second": "CASE doc_id % 5 WHEN 0 THEN 416 WHEN 1 THEN 503 WHEN 2 THEN 206 ELSE 200 END",
}


@query("str_resume_fetch", f"""WITH f AS (SELECT *, CASE WHEN held > octet THEN 0 ELSE held END AS have FROM (SELECT doc_id, text, octet, {_ANSWERS['have']} AS held, {_ANSWERS['first']} AS first, {_ANSWERS['second']} AS second FROM (SELECT doc_id, text, strlen(text) AS octet FROM documents))),
g AS (SELECT *, octet > 0 AND have = octet AS complete, (first = 206 AND have > 0 AND doc_id % 7 = 1) OR first = 416 AS again FROM f),
h AS (SELECT *, CASE WHEN complete THEN NULL WHEN again THEN CASE WHEN second IN (200, 206) THEN NULL WHEN second = 416 THEN 'refused twice' ELSE 'server status ' || second END WHEN first = 0 THEN 'request failed' WHEN first IN (200, 206) THEN NULL ELSE 'server status ' || first END AS failed FROM g)
SELECT doc_id AS id, coalesce(failed, CASE WHEN NOT complete AND NOT again AND doc_id % 7 = 5 AND octet > have THEN 'incomplete' WHEN doc_id % 10 = 9 THEN 'wrong digest' ELSE 'done' END) AS result, CASE WHEN again AND NOT complete THEN 1 ELSE 0 END AS restarts,
CASE WHEN failed IS NULL AND NOT (NOT complete AND NOT again AND doc_id % 7 = 5 AND octet > have) AND doc_id % 10 <> 9 THEN sha256(text) END AS sha256 FROM h""")
def str_resume_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial files of the texts, and answers that go on, go elsewhere, start over, refuse, fail, end early or do not come."""
    docs = table(spark, sf_dir, "documents").select("doc_id", c("text").cast("binary").alias("whole"), F.octet_length("text").cast("long").alias("octet"))
    rows = docs.withColumns({k: F.expr(v.replace("//", "div")) for k, v in _ANSWERS.items()})
    whole, octet, have = c("whole"), c("octet"), F.when(c("have") > c("octet"), 0).otherwise(c("have"))
    cut = lambda start, n: F.substring(whole, (start + 1).cast("int"), n.cast("int"))
    part = F.when(c("have") > octet, F.concat(whole, F.lit("stale").cast("binary"))).otherwise(cut(F.lit(0), c("have")))
    digest = F.when(c("doc_id") % 10 == 9, F.lit("0" * 64)).otherwise(F.upper(F.sha2("whole", 256)))
    parts = rows.select(c("doc_id").alias("id"), part.alias("part"), octet.alias("total"), digest.alias("expected"))
    elsewhere = c("doc_id") % 7 == 1
    rest = cut(have, F.when(c("doc_id") % 7 == 5, F.floor((octet - have) / 2)).otherwise(octet - have))
    first = rows.where("first > 0").select(c("doc_id").alias("id"), F.lit(1).alias("attempt"), c("first").alias("status"), F.when(elsewhere, have + 1).otherwise(have).alias("start"), F.when(c("first") == 206, rest).when(c("first") == 200, whole).alias("body"))
    second = rows.select(c("doc_id").alias("id"), F.lit(2).alias("attempt"), c("second").alias("status"), F.lit(0).cast("long").alias("start"), F.when(c("second").isin(200, 206), whole).alias("body"))
    found = fetch.resumed(parts, first.union(second))
    return found.select("id", "result", "restarts", F.when(c("result") == "done", c("sha256")).alias("sha256"))
