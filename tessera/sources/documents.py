"""Text of document files: one function per format over bytes, and a Spark source over binary files.

Errors are values: a file that cannot be read gives its reason in ``error`` and empty text.
"""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import pdf, sheets

SCHEMA = "path string, kind string, text string, pages int, error string"
PLAIN = ("txt", "md", "markdown", "log", "csv", "tsv", "json", "xml", "yaml", "yml", "toml", "ini", "lrc")


class Unreadable(Exception):
    """Why a file has no text."""


#: What the readers of a broken file may end with.
BROKEN = (Unreadable, LookupError, ValueError, TypeError, AttributeError, RecursionError, struct.error, zlib.error, zipfile.BadZipFile, ET.ParseError)


def decode(raw: bytes) -> str:
    """UTF-8 or UTF-16 by byte-order mark, else valid UTF-8, else Windows-1252."""
    for mark, charset in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(charset, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def _archive(raw: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise Unreadable(f"not a valid archive: {e}") from None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _paragraphs(xml: bytes, runs: tuple[str, ...], breaks: tuple[str, ...]) -> str:
    """Text of the run elements; every break element that holds some is a line."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        raise Unreadable(f"bad xml: {e}") from None
    lines = []
    for block in root.iter():
        if _local(block.tag) in breaks:
            text = "".join(block.itertext()) if _local(block.tag) in runs else "".join(x.text or "" for x in block.iter() if _local(x.tag) in runs)
            if text.strip():
                lines.append(text.strip())
    return "\n".join(lines)


def docx(raw: bytes) -> tuple[str, int]:
    with _archive(raw) as z:
        if "word/document.xml" not in z.namelist():
            raise Unreadable("no word/document.xml")
        text = _paragraphs(z.read("word/document.xml"), ("t",), ("p",))
    return text, max(1, text.count("\n") + 1)


def pptx(raw: bytes) -> tuple[str, int]:
    with _archive(raw) as z:
        names = sorted(n for n in z.namelist() if re.match(r"ppt/(slides/slide|notesSlides/notesSlide).*\.xml$", n))
        if not names:
            raise Unreadable("no slides")
        return "".join(f"\n--- Slide {i} ({n}) ---\n{_paragraphs(z.read(n), ('t',), ('p',))}\n" for i, n in enumerate(names, 1)), len(names)


def odf(raw: bytes) -> tuple[str, int]:
    with _archive(raw) as z:
        if "content.xml" not in z.namelist():
            raise Unreadable("no content.xml")
        return _paragraphs(z.read("content.xml"), ("p", "h"), ("p", "h")), 1


def _plain_html(html: str) -> str:
    html = re.sub(r"(?is)<(script|style)\b.*?(</\1\s*>|\Z)", "", html)
    html = re.sub(r"(?i)</?(p|br|div|li|tr|h[1-6])\b[^>]*>", "\n", html)
    html = re.sub(r"<[^>]*>|<[^>]*\Z", "", html)
    for entity, plain in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'")):
        html = html.replace(f"&{entity};", plain)
    return html


def epub(raw: bytes) -> tuple[str, int]:
    with _archive(raw) as z:
        names = sorted(n for n in z.namelist() if re.search(r"(?i)\.(xhtml|html?)$", n) and "nav" not in n.lower())
        if not names:
            raise Unreadable("no readable chapters")
        return "".join(f"\n--- {n} ---\n{_plain_html(decode(z.read(n)))}\n" for n in names), len(names)


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}]+)", re.S)
#: Groups without text of the document.
RTF_HIDDEN = ("fonttbl", "colortbl", "stylesheet", "info")


def rtf(raw: bytes) -> tuple[str, int]:
    """Text of visible groups; paragraph and tab words become white space, hex escapes are Windows-1252."""
    out, hidden, fresh = [], [False], False
    for m in _RTF.finditer(decode(raw)):
        escape, word, _, sign, brace, plain = m.groups()
        if brace == "{":
            hidden.append(hidden[-1])
        elif brace == "}":
            if len(hidden) > 1:
                hidden.pop()
        elif (sign == "*" or word in RTF_HIDDEN) and fresh:
            hidden[-1] = True
        elif len(hidden) > 1 and not hidden[-1]:
            if escape:
                out.append(bytes.fromhex(escape).decode("cp1252", "replace"))
            elif word in ("par", "line", "pard"):
                out.append("\n" if word != "pard" else "")
            elif word == "tab":
                out.append("\t")
            elif sign in ("\\", "{", "}"):
                out.append(sign)
            elif plain:
                out.append(plain.replace("\r", "").replace("\n", ""))
        fresh = brace == "{"
    return "".join(out), 1


_PRINTABLE = re.compile("[ -~¡-ۿ‐-鿿\n\r\t]{4,}")


def ole(raw: bytes) -> tuple[str, int]:
    """Runs of printable UTF-16 in a legacy file that read like text."""
    if not raw.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        raise Unreadable("not a legacy Office file")
    runs = [" ".join(r.split()) for r in _PRINTABLE.findall(raw[: len(raw) // 2 * 2].decode("utf-16-le", "replace").replace("�", "\0"))]
    kept = [r for r in runs if len(r.split()) >= 2 and any(ch.isalpha() for ch in r)]
    if len(" ".join(kept)) < 50:
        raise Unreadable("only binary content found")
    return "\n".join(kept), 1


READERS: dict[str, Callable[[bytes], tuple[str, int]]] = (
    {ext: (lambda raw: (decode(raw), 1)) for ext in PLAIN}
    | {ext: (lambda raw: (_plain_html(decode(raw)), 1)) for ext in ("html", "htm", "xhtml", "mhtml")}
    | {"docx": docx, "pptx": pptx, "odt": odf, "ods": sheets.ods, "odp": odf, "epub": epub, "xlsx": sheets.xlsx, "xlsm": sheets.xlsx, "xls": sheets.xls, "rtf": rtf, "doc": ole, "ppt": ole, "pdf": pdf.read}
)


def extract(path: str, raw: bytes, most: int = 500_000) -> tuple[str, str, str, int, str | None]:
    """(path, kind, text, pages, error) of one file; white space is normalised, long text is cut with a note."""
    ext = path.rpartition(".")[2].lower()
    reader = READERS.get(ext)
    try:
        if reader is None:
            raise Unreadable(f"unsupported: .{ext}")
        text, pages = reader(raw)
        text = re.sub(r"\n{4,}", "\n\n\n", re.sub(r"[ \t\r\f]+(\n|\Z)", r"\1", text)).strip()
        if not text:
            raise Unreadable("no text")
        if most and len(text) > most:
            text = text[:most] + "\n\n[…truncated at document cap…]"
        return path, ext, text, pages, None
    except BROKEN as e:
        return path, ext, "", 0, str(e) or type(e).__name__


def extract_files(files: DataFrame, most: int = 500_000) -> DataFrame:
    """SCHEMA rows of (path, content).

    Files go to Python some at a time: an Arrow batch is thousands of rows, which files are too large for."""
    read = F.udf(lambda path, content: extract(path, bytes(content), most), SCHEMA, useArrow=False)
    return files.select(read("path", "content").alias("x")).select("x.*")


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, md) of the notes in a folder."""
    found = spark.read.text(f"{folder}/*.md", wholetext=True)
    return found.select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("name"), F.col("value").alias("md"))


def catalog(spark: SparkSession, path: str, built_in: DataFrame) -> DataFrame:
    """Rows of a JSON catalog beside the data; the built-in ones where there is none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return built_in
    return spark.read.schema(built_in.schema).json(path, multiLine=True)
