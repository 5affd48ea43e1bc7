"""Queries of binary sources: files are made out of the documents table, then read by the sources."""

from __future__ import annotations

import os
import sqlite3
import struct
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import mixing
from tessera.plans import made_files
from tessera.registry import query, table
from tessera.session import mounted, scratch, slices
from tessera.sources import audio, documents, sinks, tree

c = F.col


def _office(text: str, kind: str, number: int = 0) -> bytes:
    lines = [made_files.clean(x) for x in text.split("\n")]
    if kind == "docx":
        return made_files.archive({"word/document.xml": "<w:document xmlns:w='w'><w:body>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines) + "</w:body></w:document>"})
    if kind == "pptx":
        return made_files.archive({f"ppt/slides/slide{i + 1}.xml": f"<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:r><a:t>{x}</a:t></a:r></a:p></p:sld>" for i, x in enumerate(lines)})
    if kind == "odt":
        return made_files.archive({"content.xml": "<o:c xmlns:o='o' xmlns:text='t'><text:h>Head</text:h>" + "".join(f"<text:p>{x}</text:p>" for x in lines) + "</o:c>"})
    if kind == "epub":
        return made_files.archive({"nav.xhtml": "<p>skip</p>"} | {f"c{i}.xhtml": f"<html><body><p>{x}</p></body></html>" for i, x in enumerate(lines)})
    if kind in ("xlsx", "ods", "xls"):
        return getattr(made_files, kind)(made_files.sheet_rows(text))
    if kind == "rtf":
        body = "\\par ".join(x.replace("\\", "").replace("{", "").replace("}", "") for x in text.split("\n"))
        return ("{\\rtf1{\\fonttbl{\\f0 Arial;}}" + "".join(ch if ch < "\x80" else "\\'" + ch.encode("cp1252", "replace").hex() for ch in body) + "}").encode("latin1", "replace")
    if kind == "doc":
        return b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0\0" * 40 + text.encode("utf-16-le") + b"\0\0" * 10
    if kind == "pdf":
        return made_files.pdf(text, number % 3)
    return (b"\xef\xbb\xbf" if len(text) % 3 == 0 else b"") + text.encode("utf-8" if len(text) % 3 < 2 else "cp1252", "replace")


def _files(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    """(path, content) with a file of each kind for each document."""

    def run(batches):
        for rows in slices(batches):
            for kind in kinds:
                made = [_office(t or "", kind, i) for i, t in zip(rows["doc_id"], rows["text"], strict=True)]
                yield pd.DataFrame({"path": [f"d{i}.{kind}" for i in rows["doc_id"]], "content": made})

    # a small table is one piece; its files are work for all tasks
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism)
    return texts.mapInPandas(run, "path string, content binary")


def _extracted(*kinds: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = documents.extract_files(_files(spark, sf_dir, kinds))
        return found.select("path", "kind", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"), "pages", "error")

    return run


_LINES = "SELECT doc_id, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS k FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_BARE = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"


def _comes_back(kinds: str, made: str) -> str:
    """What must come back of (doc_id, t, pages) after white space is normalised."""
    tidy = r"regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f]+(\n|$)', '\1', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
    return f"""WITH made AS ({made}), tidy AS (SELECT doc_id, kind, {tidy} AS t, pages FROM made, (SELECT unnest({kinds}) AS kind))
SELECT 'd' || doc_id || '.' || kind AS path, kind, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS digest, CAST(CASE WHEN t = '' THEN 0 ELSE pages END AS INTEGER) AS pages, CASE WHEN t = '' THEN 'no text' END AS error FROM tidy"""


_PARAGRAPHS = f"SELECT doc_id, coalesce(string_agg({_BARE}, chr(10) ORDER BY k) FILTER (WHERE {_BARE} <> ''), '') AS t, greatest(1, count(*) FILTER (WHERE {_BARE} <> '')) AS pages FROM ({_LINES}) GROUP BY doc_id"
_HEADED = f"SELECT doc_id, 'Head' || chr(10) || t AS t, 1 AS pages FROM ({_PARAGRAPHS})"
_SLIDES = f"SELECT doc_id, string_agg(chr(10) || '--- Slide ' || i || ' (' || n || ') ---' || chr(10) || {_BARE} || chr(10), '' ORDER BY i) AS t, count(*) AS pages FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM (SELECT *, 'ppt/slides/slide' || (k + 1) || '.xml' AS n FROM ({_LINES}))) GROUP BY doc_id"
_CHAPTERS = f"SELECT doc_id, string_agg(chr(10) || '--- ' || n || ' ---' || chr(10) || chr(10) || x || chr(10) || chr(10), '' ORDER BY n) AS t, count(*) AS pages FROM (SELECT *, 'c' || k || '.xhtml' AS n FROM ({_LINES})) GROUP BY doc_id"
_PDF_LINES = rf"SELECT doc_id, coalesce(string_agg(CASE doc_id % 3 WHEN 2 THEN regexp_replace({_BARE}, '\s+', ' ', 'g') ELSE x END, chr(10) ORDER BY k), '') AS t, greatest(1, ceil(count(*) / 40)) AS pages FROM ({_LINES}) WHERE {_BARE} <> '' GROUP BY doc_id"
_PDF_TEXTS = f"SELECT doc_id, coalesce(t, '') AS t, coalesce(pages, 1) AS pages FROM documents LEFT JOIN ({_PDF_LINES}) USING (doc_id)"
#: The used area starts at the second column where all lines are empty.
_GRID = f"""SELECT doc_id, '## Sheet: S1' || chr(10) || string_agg('| ' || CASE WHEN blank THEN '' ELSE left(x, 32767) || ' | ' END || n || ' | ' || (n % 2 = 0) || CASE WHEN n % 3 = 0 THEN ' |  | ' || CASE WHEN n % 8 = 0 THEN CAST(n // 8 AS VARCHAR) ELSE CAST(n / 8 AS VARCHAR) END ELSE '' END || ' |', chr(10) ORDER BY k) AS t, 1 AS pages
FROM (SELECT *, length(x) AS n, bool_and(x = '') OVER (PARTITION BY doc_id) AS blank FROM ({_LINES})) WHERE k < 500 GROUP BY doc_id"""

for _name, _kinds, _made in (
    ("src_plain_decode", ("txt",), None), ("src_docx", ("docx",), _PARAGRAPHS), ("src_pptx", ("pptx",), _SLIDES), ("src_odf", ("odt",), _HEADED), ("src_epub", ("epub",), _CHAPTERS),
    ("src_spreadsheet", ("xlsx", "ods", "xls"), _GRID), ("src_rtf", ("rtf",), None), ("src_legacy_ole", ("doc",), None), ("src_pdf", ("pdf",), _PDF_TEXTS),
):
    query(_name, _made and _comes_back(str(list(_kinds)), _made))(_extracted(*_kinds))


def _takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of a 24-bit take for each vector; every fifth as a crash leaves it."""

    def run(batches):
        import numpy as np

        for rows in batches:
            made = [audio.rf64(np.round(np.asarray(e, np.float64) * (1 << 22)).astype(np.int64)[:, None], 16000, i % 5 != 0) for i, e in zip(rows["vec_id"], rows["embedding"], strict=True)]
            yield pd.DataFrame({"path": [f"v{i}.wav" for i in rows["vec_id"]], "content": made})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "path string, content binary")


def _over(files: DataFrame, f, schema: str) -> DataFrame:
    def run(batches):
        for rows in batches:
            yield pd.DataFrame([f(p, bytes(r)) for p, r in zip(rows["path"], rows["content"], strict=True)], columns=[x.split()[0] for x in schema.split(", ")])

    return files.mapInPandas(run, schema)


@query("src_wav_header")
def src_wav_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(path: str, raw: bytes) -> tuple:
        h = audio.header(raw)
        return path, h.rate, h.channels, h.bits, h.format, h.data_bytes, h.frames, h.offset

    return _over(_takes(spark, sf_dir), one, "path string, rate int, channels int, bits int, format int, data_bytes long, frames long, offset long")


@query("src_wav_pcm", "SELECT 'v' || CAST(vec_id AS VARCHAR) || '.wav' AS path, CAST(len(embedding) AS BIGINT) AS frames, round(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 2, 4) AS peak FROM embeddings")
def src_wav_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each take come back as they were written (at half scale)."""

    def one(path: str, raw: bytes) -> tuple:
        pcm = audio.speech(raw)
        return path, len(pcm), round(float(abs(pcm).max()), 4)

    return _over(_takes(spark, sf_dir), one, "path string, frames long, peak double")


@query("src_take_frames")
def src_take_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten frames after the first twenty of each take."""
    return _over(_takes(spark, sf_dir), lambda p, r: (p, [round(float(x), 6) for x in audio.samples(r, 20, 10, 0)[:, 0]]), "path string, samples array<double>")


@query("sink_wav_rf64")
def sink_wav_rf64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired takes: sizes follow from the end of the file."""

    def one(path: str, raw: bytes) -> tuple:
        fixed = audio.repair(raw)
        return path, len(fixed), struct.unpack_from("<Q", fixed, 28)[0]

    return _over(_takes(spark, sf_dir), one, "path string, size long, data_bytes long")


@dataclass
class MadeTrack:
    """A track of a made project: one clip, in blocks of some samples."""

    samples: list[float]
    mute: bool = False
    solo: bool = False
    gain: float = 1.0
    pan: float = 0.0
    rate: float = 8000.0
    offset: float = 0.0
    trims: tuple[float, float] = (0.0, 0.0)
    points: tuple[tuple[float, float], ...] = ()
    block: int = 1 << 18


def made_project(tracks: list[MadeTrack], rate: float = 8000.0) -> bytes:
    """Bytes of a project database."""
    names = ["project", "rate", "wavetrack", "mute", "solo", "gain", "pan", "waveclip", "offset", "trimLeft", "trimRight", "sequence", "numsamples", "waveblock", "start", "blockid", "envelope", "controlpoint", "t", "val"]
    of = {n: i for i, n in enumerate(names)}
    head = struct.pack("<BB", audio.CHAR_SIZE, 1) + b"".join(struct.pack("<BHH", audio.NAME, i, len(n)) + n.encode() for n, i in of.items())

    def tag(name: str, attrs: dict[str, float | int], inner: bytes = b"") -> bytes:
        fields = b"".join(struct.pack("<BHq", audio.LONGLONG, of[k], v) if isinstance(v, int) else struct.pack("<BHdi", audio.DOUBLE, of[k], v, 9) for k, v in attrs.items())
        return struct.pack("<BH", audio.START, of[name]) + fields + inner + struct.pack("<BH", audio.END, of[name])

    with sqlite3.connect(":memory:") as db:
        db.executescript(f"PRAGMA application_id={int.from_bytes(b'AUDY', 'big')}; CREATE TABLE project(id, dict, doc); CREATE TABLE autosave(id, dict, doc); CREATE TABLE sampleblocks(blockid INTEGER, sampleformat INTEGER, samples BLOB);")
        body, number = b"", 0
        for track in tracks:
            held = b""
            for at in range(0, len(track.samples), track.block):
                part, number = track.samples[at : at + track.block], number + 1
                db.execute("INSERT INTO sampleblocks VALUES (?, ?, ?)", (number, audio.FLOAT32, struct.pack(f"<{len(part)}f", *part)))
                held += tag("waveblock", {"start": at, "blockid": number})
            points = b"".join(tag("controlpoint", {"t": float(t), "val": float(v)}) for t, v in track.points)
            clip = tag("waveclip", {"offset": track.offset, "trimLeft": track.trims[0], "trimRight": track.trims[1]}, tag("sequence", {"numsamples": len(track.samples)}, held) + tag("envelope", {}, points))
            body += tag("wavetrack", {"mute": int(track.mute), "solo": int(track.solo), "gain": track.gain, "pan": track.pan, "rate": track.rate}, clip)
        db.execute("INSERT INTO project VALUES (1, ?, ?)", (head, tag("project", {"rate": rate}, body)))
        db.commit()
        return db.serialize()


def make_project(value: list[float], mute: bool) -> bytes:
    """A small project: one sounding track and one that may be muted."""
    return made_project([MadeTrack(value, gain=0.5), MadeTrack(value, mute=mute)])


#: The second track's rate, by the vector's number, and its trims in seconds.
_RATES, _TRIMS = (8000.0, 4000.0, 11025.0), (0.0005, 0.00025)
_MIXES = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, len(embedding) AS n, ({list(_RATES)})[vec_id % 3 + 1] AS own, round(vec_id % 5 * 8) AS first, (vec_id % 7 - 3) / 3 AS pan FROM embeddings),
c AS (SELECT *, CAST(floor({_TRIMS[0]} * own + 0.5) AS BIGINT) AS skip, CAST(floor((n - floor({_TRIMS[1]} * own + 0.5) - floor({_TRIMS[0]} * own + 0.5)) / own * 8000 + 0.5) AS BIGINT) AS size FROM e),
b AS (SELECT vec_id, unnest(range(n)) AS i, 0.5 * unnest(e) AS v FROM e UNION ALL
SELECT vec_id, first + s, v * (CASE WHEN s / 8000 >= 0.004 THEN 0.25 ELSE 1 - 0.75 * (s / 8000) / 0.004 END) * (cos((pan + 1) * pi() / 4) + sin((pan + 1) * pi() / 4)) / sqrt(2)
FROM (SELECT *, e[w + 1] * (1 - p) + CASE WHEN w = 39 OR w + 1 >= n THEN 0 ELSE e[w + 2] END * p AS v FROM (SELECT *, CAST(floor(spot) AS BIGINT) AS w, spot - floor(spot) AS p FROM (SELECT *, skip + s * (own / 8000) AS spot FROM (SELECT *, unnest(range(size)) AS s FROM c WHERE vec_id % 2 = 1))) WHERE w < n)),
m AS (SELECT vec_id, CAST(i AS BIGINT) AS i, sum(v) AS v FROM b GROUP BY ALL), p AS (SELECT vec_id, max(abs(v)) AS peak FROM m GROUP BY vec_id)
SELECT 'p' || vec_id || '.aup3' AS path, 8000.0::DOUBLE AS rate, greatest(n, CASE WHEN vec_id % 2 = 1 THEN CAST(first AS BIGINT) + size ELSE 0 END) AS places, i, round(CASE WHEN peak > 1 THEN v * 0.99 / peak ELSE v END, 6) AS v FROM m JOIN p USING (vec_id) JOIN c USING (vec_id)"""


@query("src_audacity", _MIXES)
def src_audacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects made from the vectors, mixed: the second track has a rate, place, pan, trims and envelope of its own."""

    def made(i: int, vector: list[float]) -> bytes:
        second = MadeTrack(vector, mute=i % 2 == 0, pan=(i % 7 - 3) / 3, rate=_RATES[i % 3], offset=i % 5 / 1000, trims=_TRIMS, points=((0.0, 1.0), (0.004, 0.25)), block=40)
        return made_project([MadeTrack(vector, gain=0.5), second])

    def make(batches):
        for rows in slices(batches):
            yield pd.DataFrame({"path": [f"p{i}.aup3" for i in rows["vec_id"]], "content": [made(i, [float(x) for x in e]) for i, e in zip(rows["vec_id"], rows["embedding"], strict=True)]})

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(spark.sparkContext.defaultParallelism)
    files = vectors.mapInPandas(make, "path string, content binary")
    found = mixing.mixes(files)
    return found.select("path", "rate", "places", "piece", F.posexplode("samples").alias("k", "v")).select("path", "rate", "places", (c("piece") * mixing.PIECE + c("k")).alias("i"), T.rounded(c("v"), 6).alias("v"))


#: Files of a drop: folders in folders, and names that sort before and after them.
_DROPPED = "concat(CASE doc_id % 3 WHEN 0 THEN 'a/' WHEN 1 THEN concat('b/', lang, '/') ELSE concat('b/', source, '/', lang, '/x/') END, 'f', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '' END)"


@query("src_dir_expand", f"SELECT p AS name, CAST(strlen(text) AS BIGINT) AS length FROM (SELECT *, {_DROPPED} AS p FROM documents) ORDER BY (p LIKE 'b/%') DESC, string_split(p, '/') DESC LIMIT 256")
def src_dir_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dropped folders, of which one holds links to itself and to the other, as an intake by hand takes them."""
    folder = scratch(spark, "drop")
    sinks.write_files(table(spark, sf_dir, "documents").select(F.expr(_DROPPED).alias("name"), F.coalesce("text", F.lit("")).alias("body")), folder, "name", "body")
    top = mounted(folder)
    os.symlink(f"{top}/b", f"{top}/b/again")
    os.symlink(f"{top}/a", f"{top}/b/zz")
    taken = tree.expand(spark, [f"{folder}/a", f"{folder}/b", f"{folder}/nothing"])
    return taken.select(F.substring(c("path"), len(top) + 2, F.length("path")).alias("name"), c("size").alias("length"))


@query("src_notes_dir", "SELECT lang || '.md' AS name, lang AS head FROM (SELECT DISTINCT lang FROM documents)")
def src_notes_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes written one a language, then listed."""
    path = scratch(spark, "notes")
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    langs.select(F.concat(F.lit("# "), "lang").alias("value"), "lang").write.partitionBy("lang").text(path)
    found = spark.read.text(path, wholetext=True).select(F.concat("lang", F.lit(".md")).alias("name"), F.regexp_extract("value", r"# (\w+)", 1).alias("head"))
    return found


@query("src_catalog", "SELECT p_partkey AS id, p_name AS name FROM part")
def src_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in catalog, as none lies beside the tables."""
    built_in = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_name").alias("name"))
    return documents.catalog(spark, f"{sf_dir}/models.json", built_in)
