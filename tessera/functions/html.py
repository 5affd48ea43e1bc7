"""HTML to text by column functions: tags become single marks, then regions between marks go."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import trimmed

OPEN, CLOSE, BREAK, OPEN_STYLE, CLOSE_STYLE = "\x01", "\x02", "\x03", "\x04", "\x05"
BLOCKS_DOC = "p|br|div|li|tr|h1|h2|h3|h4|h5|h6"
BLOCKS_WEB = "p|br|div|li|h1|h2|h3|h4|tr|article|section"
BLOCKS_WEB_CLOSED = "p|div|li|h1|h2|h3|h4|tr|article|section"


def _tag(names: str, slash: str) -> str:
    return rf"(?is)^<{slash}(?:{names})(?:[\s/].*)?>$"


def strip_html(html: Column) -> Column:
    """For documents: script and style bodies go, block tags break lines (inside such bodies too), entities are replaced one after the other, and an unmatched < cuts the rest."""
    parts = F.regexp_extract_all(F.regexp_replace(html, r"(?s)<[^>]*\z", ""), F.lit(r"(?s)<[^>]*>|[^<]+"), F.lit(0))
    marked = F.transform(
        parts,
        lambda x: F.when(~F.startswith(x, F.lit("<")), F.regexp_replace(x, "[\x01-\x03]", ""))
        .when(x.rlike(_tag("script|style", "")), OPEN)
        .when(x.rlike(_tag("script|style", "/+")), CLOSE)
        .when(x.rlike(_tag(BLOCKS_DOC, "/*")), BREAK)
        .otherwise(""),
    )
    regions = F.split(F.array_join(marked, ""), OPEN)
    inside = lambda x: F.concat(F.regexp_replace(F.regexp_extract(x, "(?s)^([^\x02]*)", 1), "[^\x03]", ""), F.regexp_replace(F.regexp_extract(x, "(?s)^[^\x02]*\x02(.*)\\z", 1), CLOSE, ""))
    kept = F.transform(regions, lambda x, i: F.when(i == 0, F.regexp_replace(x, CLOSE, "")).otherwise(inside(x)))
    text = F.regexp_replace(F.array_join(kept, ""), BREAK, "\n")
    for entity, plain in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'")):
        text = F.replace(text, F.lit(f"&{entity};"), F.lit(plain))
    return text


def extract_html(html: Column) -> Column:
    """For web pages: comments, script and style go with their content, entities are replaced once, white space collapses and blank lines do not repeat."""
    whole = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", ""), r"(?s)<[^>]*\z", "")
    parts = F.regexp_extract_all(whole, F.lit(r"(?s)<[^>]*>|[^<]+"), F.lit(0))
    marked = F.transform(
        parts,
        lambda x: F.when(~F.startswith(x, F.lit("<")), F.regexp_replace(x, "[\x01-\x05]", ""))
        .when(x.rlike(_tag("script", "")), OPEN)
        .when(x.rlike(_tag("script", "/+")), CLOSE)
        .when(x.rlike(_tag("style", "")), OPEN_STYLE)
        .when(x.rlike(_tag("style", "/+")), CLOSE_STYLE)
        .when(x.rlike(_tag(BLOCKS_WEB, "")) | x.rlike(_tag(BLOCKS_WEB_CLOSED, "/+")), "\n")
        .otherwise(""),
    )
    text = F.regexp_replace(F.array_join(marked, ""), "(?s)\x01[^\x02]*(?:\x02|\\z)|\x04[^\x05]*(?:\x05|\\z)", "")
    text = F.regexp_replace(text, "[\x02\x05]", "")
    for entity, plain in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{entity};"), F.lit(plain))
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^ | \z", ""))
    return trimmed(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def strip_subtitles(text: Column) -> Column:
    """Without blank, timing, bracketed, header and note lines, and without lines that repeat the one before."""
    lines = F.transform(F.split(text, "\r?\n"), trimmed)
    timing = r"-->|^\d+$|^\d+(?:[:,.]\d+){1,3}$|^\[.*\]$|^WEBVTT$|^NOTE"
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(timing))
    before = F.concat(F.array(F.lit(None).cast("string")), kept)
    return F.array_join(F.transform(F.filter(F.arrays_zip(kept.alias("k"), F.slice(before, F.lit(1), F.size(kept)).alias("b")), lambda p: ~p["k"].eqNullSafe(p["b"])), lambda p: p["k"]), "\n")
