"""Queries over web pages and captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import html as H
from tessera.functions import text as T
from tessera.plans.scalar_queries import ALLOWED, TRIM, scalar
from tessera.registry import SQL

c = F.col
_M = ["chr(1)", "chr(2)", "chr(3)", "chr(4)", "chr(5)"]


def _tag(names: str, slash: str) -> str:
    return rf"regexp_matches(x, '(?is)^<{slash}(?:{names})(?:[\s/].*)?>$')"


def _entities(sql: str, order: tuple[tuple[str, str], ...]) -> str:
    for entity, plain in order:
        sql = f"replace({sql}, '&{entity};', {plain})"
    return sql


_Q, _A = "chr(34)", "chr(39)"
_MARKED_DOC = (
    r"array_to_string(list_transform(regexp_extract_all(regexp_replace(h, '(?s)<[^>]*$', ''), '(?s)<[^>]*>|[^<]+'), lambda x: CASE WHEN NOT starts_with(x, '<') THEN x"
    f" WHEN {_tag('script|style', '')} THEN chr(1) WHEN {_tag('script|style', '/+')} THEN chr(2) WHEN {_tag(H.BLOCKS_DOC, '/*')} THEN chr(3) ELSE '' END), '')"
)
_REGIONS = f"string_split({_MARKED_DOC}, chr(1))"
_INSIDE = r"regexp_replace(regexp_extract(r, '(?s)^([^\x02]*)', 1), '[^\x03]', '', 'g') || replace(regexp_extract(r, '(?s)^[^\x02]*\x02(.*)$', 1), chr(2), '')"
_KEPT = f"replace({_REGIONS}[1], chr(2), '') || coalesce(array_to_string(list_transform({_REGIONS}[2:], lambda r: {_INSIDE}), ''), '')"
DOC_SQL = _entities(f"replace({_KEPT}, chr(3), chr(10))", (("nbsp", "' '"), ("amp", "'&'"), ("lt", "'<'"), ("gt", "'>'"), ("quot", _Q), ("#39", _A), ("apos", _A)))
_MARKED_WEB = (
    r"array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(h, '(?s)<!--.*?(?:-->|$)', '', 'g'), '(?s)<[^>]*$', ''), '(?s)<[^>]*>|[^<]+'), lambda x: CASE WHEN NOT starts_with(x, '<') THEN x"
    f" WHEN {_tag('script', '')} THEN chr(1) WHEN {_tag('script', '/+')} THEN chr(2) WHEN {_tag('style', '')} THEN chr(4) WHEN {_tag('style', '/+')} THEN chr(5)"
    f" WHEN {_tag(H.BLOCKS_WEB, '')} OR {_tag(H.BLOCKS_WEB_CLOSED, '/+')} THEN chr(10) ELSE '' END), '')"
)
_WEB = rf"regexp_replace(regexp_replace({_MARKED_WEB}, '(?s)\x01[^\x02]*(?:\x02|$)|\x04[^\x05]*(?:\x05|$)', '', 'g'), '[\x02\x05]', '', 'g')"
_WEB = _entities(_WEB, (("lt", "'<'"), ("gt", "'>'"), ("quot", _Q), ("apos", _A), ("#39", _A), ("nbsp", "' '"), ("amp", "'&'")))
_LINES = rf"array_to_string(list_transform(string_split({_WEB}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^ | $', '', 'g')), chr(10))"
WEB_SQL = TRIM.format(rf"regexp_replace({_LINES}, '\n{{3,}}', chr(10) || chr(10), 'g')")
_RICH = "'<div>Fish &amp;lt; chips' || html || '<style>p{}</style><!-- <p>gone</p> --><h2>End &#39;q&#39;</h2><br/>tail <unclosed'"

scalar("fn_strip_html", "pages", "page_id", {"h": _RICH}, {"body": lambda: H.strip_html(c("h"))}, {"body": DOC_SQL})
scalar("fn_extract_html", "pages", "page_id", {"h": _RICH}, {"body": lambda: H.extract_html(c("h"))}, {"body": WEB_SQL})
_HREFS = "'<a href=\"https://duck/l/?uddg=https%3A%2F%2Fexample.com%2Ffilm' || CAST(page_id AS STRING) || '&rut=1\">x</a><a href=\"' || url || '\">y</a><a href=\"javascript:z\">z</a><a href=\"https://other.org/a&b=1\">w</a>' || html"
_RAW = "regexp_extract_all(h, 'href=\"([^\"]*)\"', 1)"
_LINKS = f"list_filter(list_transform({_RAW}, lambda x: split_part(CASE WHEN contains(x, 'uddg=') THEN url_decode(regexp_extract(x, 'uddg=([^&]*)', 1)) ELSE x END, '&', 1)), lambda u: regexp_matches(u, '{ALLOWED}'))"
_FIRST = f"list_transform(list_filter(list_zip({_LINKS}, range(len({_LINKS}))), lambda z: list_position({_LINKS}, z[1]) = z[2] + 1), lambda z: z[1])"
scalar("fn_result_links", "pages", "page_id", {"h": _HREFS}, {"links": lambda: F.array_join(T.result_links(c("h"), 5), " ")}, {"links": f"array_to_string({_FIRST}[1:5], ' ')"})
scalar("set_distinct_links", "pages", "page_id", {"h": "html || '<a href=\"' || url || '\">1</a><a href=\"' || url || '\">2</a>'"}, {"n": lambda: F.size(T.result_links(c("h"), 1000)).cast("long")}, {"n": f"CAST(len(list_distinct({_LINKS})) AS BIGINT)"})
_CAPTIONS = "'WEBVTT' || chr(10) || 'NOTE x' || chr(10) || '1' || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || text || chr(10) || text || chr(10) || '[music]' || chr(10) || '00:01' || chr(10) || '123 go' || chr(10) || chr(10) || '123 go'"
_L = f"list_filter(list_transform(string_split(t, chr(10)), lambda x: {TRIM.format('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '" + r"-->|^\d+$|^\d+(?:[:,.]\d+){1,3}$|^\[.*\]$|^WEBVTT$|^NOTE" + "'))"
_SUBTITLES = f"array_to_string(list_transform(list_filter(list_zip({_L}, list_concat([NULL], {_L})[1:len({_L})]), lambda z: z[1] IS DISTINCT FROM z[2]), lambda z: z[1]), chr(10))"
scalar("fn_strip_subtitles", "conversations", "conv_id, turn", {"t": _CAPTIONS}, {"body": lambda: H.strip_subtitles(c("t"))}, {"body": _SUBTITLES})

#: What stands behind a text that was cut, and the default cap.
CAP, CUT = 500_000, "[…truncated at document cap…]"
_KIND = "CASE doc_id % 6 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'srt' WHEN 3 THEN 'html' WHEN 4 THEN 'exe' ELSE '' END"
_NORMAL = TRIM.format(r"""regexp_replace(regexp_replace(replace(b, chr(13) || chr(10), chr(10)), '[ \t\r\f]+(\n|$)', '\1', 'g'), '\n{4,}', repeat(chr(10), 3), 'g')""")


def _extracted(field: str):
    """Text of a file by its kind, with white space in order, cut at the cap; or the reason why there is none."""
    raw = F.when(c("kind") == "html", H.strip_html(c("t"))).when(c("kind") == "srt", H.strip_subtitles(c("t"))).otherwise(c("t"))
    body = T.normalize_ws(raw)
    error = (
        F.when(c("kind") == "", "no file extension — rename with .txt/.md/.pdf/etc.")
        .when(~c("kind").isin("txt", "md", "srt", "html"), F.concat(F.lit("unsupported document ."), "kind"))
        .when(body == "", F.concat(F.lit("no extractable text in ."), c("kind"), F.lit(" (empty or image-only)")))
    )
    whole = F.when(F.length(body) > CAP, F.concat(F.left(body, F.lit(CAP)), F.lit("\n\n" + CUT))).otherwise(body)
    return {"error": error, "body": F.when(error.isNull(), whole), "truncated": F.coalesce(error.isNull() & (F.length(body) > CAP), F.lit(False))}[field]


scalar("src_extract_text", "documents", "doc_id", {"t": "text", "kind": _KIND}, {f: (lambda f=f: _extracted(f)) for f in ("error", "body", "truncated")}, {"error": "t"})
SQL["src_extract_text"] = (
    f"SELECT doc_id, error, CASE WHEN error IS NULL THEN CASE WHEN length(n) > {CAP} THEN left(n, {CAP}) || chr(10) || chr(10) || '{CUT}' ELSE n END END AS body, error IS NULL AND length(n) > {CAP} AS truncated FROM ("
    "SELECT doc_id, n, CASE WHEN kind = '' THEN 'no file extension — rename with .txt/.md/.pdf/etc.' WHEN kind = 'exe' THEN 'unsupported document .exe' WHEN n = '' THEN 'no extractable text in .' || kind || ' (empty or image-only)' END AS error FROM ("
    f"SELECT doc_id, kind, {_NORMAL} AS n FROM (SELECT doc_id, kind, CASE kind WHEN 'html' THEN {DOC_SQL} WHEN 'srt' THEN {_SUBTITLES} ELSE t END AS b FROM (SELECT doc_id, text AS t, text AS h, {_KIND} AS kind FROM documents))))"
)
