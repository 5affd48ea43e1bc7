"""Queries of the scalar functions over columns made from the documents, pages, events and part tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.registry import QUERIES, SQL, table

#: Expressions that both engines read alike.
PATHS = (
    "CASE doc_id % 8 WHEN 0 THEN 'Biology/lec' || CAST(doc_id % 40 AS STRING) || '_intro.mp3'"
    " WHEN 1 THEN 'lib/' || source || '/Bio - Day ' || CAST(doc_id % 30 AS STRING) || ' - mitosis.wav'"
    " WHEN 2 THEN 'notes\\2024-03-' || lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') || ' lecture.docx'"
    " WHEN 3 THEN source || '/0' || CAST(doc_id % 9 AS STRING) || ' - sacred sites.PDF'"
    " WHEN 4 THEN 'no tokens here xyz' WHEN 5 THEN 'a/b/Monday ' || CAST(doc_id % 7 AS STRING) || '.tar.gz'"
    " WHEN 6 THEN 'x/Lecture ' || CAST(doc_id % 50 AS STRING) || ' - atman.mp4' ELSE 'Class/.hidden' || CAST(doc_id AS STRING) END"
)
TITLES = "CASE doc_id % 5 WHEN 0 THEN '## Summary: ' || text WHEN 1 THEN '  * - Overview, \"' || text || '\"' WHEN 2 THEN '[12:03] a:b/c?' || text || '. .' WHEN 3 THEN '…TL;DR: ' || text ELSE '<<' || source || '>> | x--y ---' END"


def scalar(name: str, source: str, key: str, inputs: dict[str, str], outputs: dict[str, Callable[[], Column]], sql: dict[str, str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = key.split(", ")
        rows = table(spark, sf_dir, source).selectExpr(*keys, *[f"{e.replace(chr(92), chr(92) * 2)} AS {n}" for n, e in inputs.items()])
        return rows.select(*keys, *[f().alias(n) for n, f in outputs.items()])

    QUERIES[name] = run
    columns = ", ".join(f"{e} AS {n}" for n, e in sql.items())
    own = ", ".join(f"{e} AS {n}" for n, e in inputs.items())
    SQL[name] = f"SELECT {key}, {columns} FROM (SELECT {key}, {own} FROM {source})"


def _docs(name: str, inputs: dict[str, str], outputs: dict[str, Callable[[], Column]], sql: dict[str, str]) -> None:
    scalar(name, "documents", "doc_id", inputs, outputs, sql)


c = F.col
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _or(sql: str, default: str) -> str:
    return f"coalesce(nullif({sql}, ''), '{default}')"


SAN = _or(r"""regexp_replace(regexp_replace(t, '[<>:"/\\|?*]', '-', 'g'), '[ .]+$', '')""", "Untitled")
CTRL = r"""regexp_replace(t, '[<>:"/\\|?*\x00-\x1F\x7F]', '-', 'g')"""
BASE = r"regexp_extract(p, '([^/\\]*)$', 1)"
STEM = rf"regexp_replace({BASE}, '(.)\.[^.]*$', '\1')"
PARENT = r"regexp_extract(p, '([^/\\]+)[/\\][^/\\]*$', 1)"
DAY = (
    r"CASE WHEN regexp_matches(p, '(?i)day[\s_-]*(\d{1,3})') THEN 'Day ' || regexp_extract(p, '(?i)day[\s_-]*(\d{1,3})', 1)"
    r" WHEN regexp_matches(p, '(?i)lec(?:ture)?[\s_-]*(\d{1,3})') THEN 'Day ' || regexp_extract(p, '(?i)lec(?:ture)?[\s_-]*(\d{1,3})', 1)"
    r" WHEN regexp_matches(p, '(\d{4}-\d{2}-\d{2})') THEN regexp_extract(p, '(\d{4}-\d{2}-\d{2})', 1)"
    r" WHEN regexp_matches(p, '(?:^|[\s_\-\[(])(\d{1,3})(?:[\s_\-\])]|$)') THEN 'Day ' || regexp_extract(p, '(?:^|[\s_\-\[(])(\d{1,3})(?:[\s_\-\])]|$)', 1) END"
)

_docs("fn_sanitize_filename", {"t": TITLES}, {"name": lambda: T.sanitize_filename(c("t"))}, {"name": SAN})
_docs("fn_sanitize_stem", {"t": TITLES}, {"stem": lambda: T.sanitize_stem(c("t"))}, {"stem": f"left(regexp_replace({TRIM.format(rf'''regexp_replace({TRIM.format(CTRL)}, '^\.+|\.+$', '', 'g')''')}, '-{{2,}}', '-', 'g'), 80)"})
_docs("fn_research_stem", {"t": TITLES}, {"stem": lambda: T.research_stem(c("t"))}, {"stem": _or(f"left({TRIM.format(CTRL)}, 60)", "research")})
_docs("fn_path_parts", {"p": PATHS}, {"base": lambda: T.basename(c("p")), "stem": lambda: T.stem(c("p")), "parent": lambda: T.parent_name(c("p"))}, {"base": BASE, "stem": STEM, "parent": PARENT})
_docs("fn_parse_day", {"p": PATHS}, {"day": lambda: T.parse_day(c("p"))}, {"day": DAY})

_TOK = r"list_filter(string_split_regex(lower(p), '[^a-z0-9]+'), lambda t: t <> '')"
_NUM = rf"list_filter(list_transform(list_zip({_TOK}, list_append({_TOK}[2:], '')), lambda z: CASE WHEN z[1] IN ('day', 'lec', 'lecture') AND regexp_matches(z[2], '^\d{{1,3}}$') THEN z[2] WHEN regexp_matches(z[1], '^(day|lec|lecture)\d{{1,3}}$') AND NOT regexp_matches(z[1], '[a-z]1$') THEN regexp_extract(z[1], '(\d+)$', 1) ELSE '' END), lambda x: x <> '')"
SQL_NAME = rf"""SELECT doc_id, concat_ws(' - ', {_or('parent', 'General')}, day, CASE WHEN starts_with(lower(topic), lower(day)) THEN regexp_replace(topic[length(day) + 1:], '^[- ]+', '') ELSE topic END) AS name
FROM (SELECT doc_id, {PARENT} AS parent, 'Day ' || coalesce({_NUM}[1], '1') AS day, left({STEM}, 40) AS topic FROM (SELECT doc_id, {PATHS} AS p FROM documents))"""
_docs("fn_heuristic_name", {"p": PATHS}, {"name": lambda: T.heuristic_name(c("p"))}, {"name": "p"})
SQL["fn_heuristic_name"] = SQL_NAME

_CLEAN = r"regexp_replace(regexp_replace(t, '[\x00-\x20\x7F]+', ' ', 'g'), '^ +| +$', '', 'g')"
_docs("fn_clean_label", {"t": "text"}, {"label": lambda: T.clean_label(c("t"))}, {"label": _or(rf"CASE WHEN length({_CLEAN}) > 80 THEN coalesce(nullif(regexp_extract({_CLEAN}, '^(.{{0,80}}) ', 1), ''), left({_CLEAN}, 80)) ELSE {_CLEAN} END", "Untitled")})
_LEADS = "|".join(x.replace(".", r"\.") for x in T.LEADS)
# RE2 has no lookahead: a space or end after what must be followed by one is put in, then taken out again
_docs("fn_strip_bracketed", {"t": TITLES}, {"topic": lambda: T.strip_bracketed(c("t"))}, {"topic": r"regexp_replace(t, '\[[^\]]{0,23}\]', '', 'g')"})
_docs("fn_strip_topic_lead", {"t": TITLES}, {"topic": lambda: T.strip_topic_lead(c("t"))}, {"topic": "t"})
del SQL["fn_strip_topic_lead"]
CAP = _or(r"regexp_replace(left(t, 40 + doc_id % 30), '[ .\-]+$', '')", "Untitled")
_docs("fn_cap_title", {"t": TITLES}, {"title": lambda: T.cap_title(c("t"), c("doc_id").cast("int") % 30 + 40)}, {"title": CAP})
_COMPOSED = r"""regexp_replace(regexp_replace('General - Day ' || CAST(doc_id % 9 AS STRING) || CASE WHEN t <> '' THEN ' - ' || t ELSE '' END, '[<>:"/\\|?*]', '-', 'g'), '[ .]+$', '')"""
_docs("fn_compose_title", {"t": TITLES}, {"title": lambda: T.compose_title(F.lit("General"), F.concat(F.lit("Day "), (c("doc_id") % 9).cast("string")), c("t"))}, {"title": _or(rf"regexp_replace(left({_or(_COMPOSED, 'Untitled')}, 100), '[ .\-]+$', '')", "Untitled")})
_docs("fn_head_tail", {"t": "text"}, {"sample": lambda: T.head_tail(c("t"), 300, 200)}, {"sample": "CASE WHEN length(t) > 500 THEN left(t, 300) || chr(10) || '[…]' || chr(10) || right(t, 200) ELSE t END"})
_docs("fn_head_chars", {"t": "text"}, {"head": lambda: F.left(c("t"), F.lit(120))}, {"head": "left(t, 120)"})
_S = "CAST(greatest(s, 0) AS BIGINT)"
_docs("fn_fmt_time", {"s": "n_chars * 3 - 900"}, {"shown": lambda: T.fmt_time(c("s"))}, {"shown": f"CASE WHEN {_S} >= 3600 THEN CAST({_S} // 3600 AS STRING) || ':' || lpad(CAST({_S} % 3600 // 60 AS STRING), 2, '0') || ':' || lpad(CAST({_S} % 60 AS STRING), 2, '0') ELSE lpad(CAST({_S} // 60 AS STRING), 2, '0') || ':' || lpad(CAST({_S} % 60 AS STRING), 2, '0') END"})
_M = "CAST(greatest(ms, 0) AS BIGINT)"
_docs("fn_fmt_srt_ts", {"ms": "n_chars * 1237 - 400000"}, {"stamp": lambda: T.fmt_srt(c("ms"))}, {"stamp": f"lpad(CAST({_M} // 3600000 AS STRING), CAST(greatest(2, length(CAST({_M} // 3600000 AS STRING))) AS INTEGER), '0') || ':' || lpad(CAST({_M} % 3600000 // 60000 AS STRING), 2, '0') || ':' || lpad(CAST({_M} % 60000 // 1000 AS STRING), 2, '0') || ',' || lpad(CAST({_M} % 1000 AS STRING), 3, '0')"})
_LINE = "CASE doc_id % 5 WHEN 0 THEN '[' || CAST(doc_id % 70 AS STRING) || ':' || CAST(doc_id % 61 AS STRING) || '] hi' WHEN 1 THEN 'x [1:' || lpad(CAST(doc_id % 60 AS STRING), 2, '0') || ':03] y' WHEN 2 THEN '[ab:cd]' WHEN 3 THEN 'no stamp' ELSE '[1:2:3:4] [00:01]' END"
_FIRST = r"regexp_extract(l, '^[^\[]*\[([^\]]*)\]', 1)"
_PART = f"list_transform(string_split({_FIRST}, ':'), lambda x: try_cast(x AS BIGINT))"
_docs("fn_parse_stamp", {"l": _LINE}, {"ms": lambda: T.parse_stamp(c("l"))}, {"ms": rf"CASE WHEN regexp_matches({_FIRST}, '^\d+:\d+(:\d+)?$') AND length({_FIRST}) <= 15 AND {_PART}[-2] < 60 AND {_PART}[-1] < 60 THEN CAST(((CASE WHEN len({_PART}) = 3 THEN {_PART}[1] ELSE 0 END) * 3600 + {_PART}[-2] * 60 + {_PART}[-1]) * 1000 AS BIGINT) ELSE CAST(-1 AS BIGINT) END"})
_docs("fn_fmt_size", {"b": "CASE doc_id % 4 WHEN 0 THEN doc_id ELSE n_chars * n_chars * (doc_id + 1) END"}, {"shown": lambda: T.fmt_size(c("b"))}, {"shown": "CASE WHEN b >= 1073741824 THEN format('{:.1f} GB', b / 1073741824.0) WHEN b >= 1048576 THEN format('{:.1f} MB', b / 1048576.0) WHEN b >= 1024 THEN format('{:.1f} KB', b / 1024.0) ELSE CAST(b AS STRING) || ' B' END"})
_docs("fn_civil_date", {"d": "doc_id * 37 - 4000"}, {"day": lambda: T.civil_date(c("d"))}, {"day": "strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d')"})
_docs("fn_word_count", {"t": "text"}, {"words": lambda: T.word_count(c("t"))}, {"words": r"CAST(len(list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS BIGINT)"})
_docs("fn_alpha_words", {"t": "text"}, {"words": lambda: T.alpha_words(c("t"))}, {"words": "CAST(len(regexp_extract_all(t, '[A-Za-z0-9]+')) AS BIGINT)"})
_docs("fn_est_tokens", {"t": "text"}, {"tokens": lambda: T.est_tokens(c("t"))}, {"tokens": "CAST(strlen(t) // 4 + 1 AS BIGINT)"})
_docs("fn_normalize_ws", {"t": "'  ' || replace(text, ' the ', '  ' || chr(10) || chr(10) || chr(10) || chr(10) || ' ') || ' ' || chr(10)"}, {"clean": lambda: T.normalize_ws(c("t"))}, {"clean": TRIM.format(r"regexp_replace(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '[ \t\r\f]+(\n|$)', '\1', 'g'), '\n{4,}', repeat(chr(10), 3), 'g')")})
_STOP = ", ".join(f"'{w}'" for w in T.STOP)
_TERMS = rf"list_filter(string_split_regex(lower(t), '[^\p{{L}}\p{{N}}]+'), lambda w: strlen(w) >= 3 AND w NOT IN ({_STOP}))"
_docs("fn_query_terms", {"t": "text"}, {"terms": lambda: F.array_join(T.query_terms(c("t"), 6), " ")}, {"terms": f"array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({_TERMS}, lambda z: [z])), lambda found, z: CASE WHEN len(found) >= 6 OR list_contains(found, z[1]) THEN found ELSE list_concat(found, z) END), ' ')"})
_URLS = "CASE doc_id % 9 WHEN 0 THEN 'https://ex.org/' || source WHEN 1 THEN 'HTTP://a.b?q=1' WHEN 2 THEN 'file:///x' WHEN 3 THEN 'https://' WHEN 4 THEN 'https://u@h/x' WHEN 5 THEN 'https://a b/c' WHEN 6 THEN 'javascript:x' WHEN 7 THEN 'C:\\x' ELSE 'http://h/a@b' END"
ALLOWED = r"(?i)^https?://[^/?#@\\\s][^/?#\\\s@]*(?:[/?#][^@]*)?$"
_docs("fn_url_allowed", {"u": _URLS}, {"allowed": lambda: T.url_allowed(c("u"))}, {"allowed": f"regexp_matches(u, '{ALLOWED}')"})
_ECHO = "text || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'see agents.MD now' || chr(10) || 'tail' WHEN 1 THEN chr(10) || 'a [Program Behavior] b' ELSE '' END"
_docs("fn_strip_guide_echo", {"t": _ECHO}, {"clean": lambda: T.strip_guide_echo(c("t"))}, {"clean": r"coalesce(nullif(regexp_replace(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '(?i)AGENTS\.md|behavior supplement|MAP \(excerpt\)|REDUCE \(summary\)|\[Program behavior\]')), chr(10)), '\n+$', ''), ''), t)"})
_SIDE = """CASE doc_id % 4 WHEN 0 THEN '{"chunks": ' || CAST(n_chars AS STRING) || ',"x":1}' WHEN 1 THEN '{"chunks":-' || CAST(doc_id AS STRING) || '}' WHEN 2 THEN 'not json' ELSE '{"chunks":"a"}' END"""
_docs("fn_sidecar_int", {"t": _SIDE}, {"chunks": lambda: T.sidecar_int(c("t"), "chunks")}, {"chunks": r"""try_cast(regexp_extract(t, '"chunks":\s*(-?\d+)', 1) AS BIGINT)"""})
NOTE = (
    "CASE doc_id % 3 WHEN 0 THEN '# T' || chr(10) || chr(10) || '## Summary' || chr(10) || text || chr(10) || chr(10) || '## Raw Transcript' || chr(10) || text || chr(10) || '## Audio' || chr(10) || 'a.wav'"
    f" WHEN 1 THEN '# T' || chr(10) || '## Summary' || chr(10) || '{T.SKIP_MARK}' || chr(10) || '## Raw Transcript' || chr(10) || text"
    " ELSE '#T' || chr(10) || '## Sources' || chr(10) || '- a' || chr(10) || '## Summary' || chr(10) || text || chr(10) || '## Source Texts' || chr(10) || text END"
)
_MARK = "CASE WHEN contains(t, '## Source Texts') THEN '## Source Texts' ELSE '## Raw Transcript' END"
_SUMMARY = TRIM.format(f"coalesce(string_split(string_split(t, {_MARK})[1], '## Summary')[2], '')")
_RAW = TRIM.format(f"string_split({TRIM.format(f'''coalesce(string_split(t, {_MARK})[2], '')''')}, chr(10) || '## Audio')[1]")
_docs(
    "fn_parse_md",
    {"t": NOTE},
    {"raw": lambda: T.parse_md(c("t"))["raw"], "summary": lambda: T.parse_md(c("t"))["summary"], "skipped": lambda: T.parse_md(c("t"))["skipped"]},
    {"raw": _RAW, "summary": f"CASE WHEN contains({_SUMMARY}, '{T.SKIP_MARK}') THEN '' ELSE {_SUMMARY} END", "skipped": f"contains({_SUMMARY}, '{T.SKIP_MARK}')"},
)
_docs("fn_section_head", {"t": NOTE}, {"head": lambda: T.section_head(c("t"))}, {"head": "substr(t, greatest(instr(t, '## Summary'), 1), 800)"})
_NAMES = "CASE doc_id % 9 WHEN 0 THEN 'sub/y.md' WHEN 1 THEN 'Y.MD' WHEN 2 THEN '/etc/x.md' WHEN 3 THEN 'C:x.md' WHEN 4 THEN '../x.md' WHEN 5 THEN 'a/../b.json' WHEN 6 THEN 'x.md:s' WHEN 7 THEN 'x.exe' ELSE source || '.json' END"
_docs("fn_confine", {"t": _NAMES}, {"allowed": lambda: T.confined(c("t"))}, {"allowed": r"NOT regexp_matches(t, '^[/\\]') AND NOT contains(t, ':') AND NOT regexp_matches(t, '(^|[/\\])\.\.([/\\]|$)') AND regexp_matches(t, '(?i)[^/\\]\.(md|json)$')"})
_DIRS = r"CASE doc_id % 10 WHEN 0 THEN 'C:\rec\x' WHEN 1 THEN '\\srv\share' WHEN 2 THEN 'rel/x' WHEN 3 THEN 'D:\a\b:s' WHEN 4 THEN '  ' WHEN 5 THEN 'C:\Users\OneDrive\x' WHEN 6 THEN '/mnt/y' WHEN 7 THEN '//srv/z' WHEN 8 THEN 'E:/usb' ELSE 'F:\Dropbox' END"
_KIND = "CASE floor(doc_id / 10) % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'removable' WHEN 2 THEN 'remote' ELSE 'unknown' END"
_P = TRIM.format("p")
_docs(
    "fn_path_policy",
    {"p": _DIRS, "kind": _KIND, "capture": "doc_id % 3 = 0"},
    {"decision": lambda: T.path_policy(c("p"), c("capture"), c("kind"))},
    {"decision": rf"CASE WHEN {_P} = '' THEN 'empty' WHEN regexp_matches(regexp_replace({_P}, '^.:', ''), '[/\\].*:') THEN 'stream' WHEN NOT regexp_matches({_P}, '^([A-Za-z]:[/\\]|[/\\])') THEN 'relative' WHEN regexp_matches({_P}, '^(\\\\|//)') AND capture THEN 'network' WHEN regexp_matches({_P}, '^(\\\\|//)') THEN 'warn network' WHEN kind IN ('remote', 'unknown') AND capture THEN 'network' WHEN kind = 'removable' AND capture THEN 'removable' WHEN kind = 'removable' AND regexp_matches(lower({_P}), 'onedrive|dropbox') THEN 'warn removable cloud' WHEN kind = 'removable' THEN 'warn removable' WHEN regexp_matches(lower({_P}), 'onedrive|dropbox') THEN 'warn cloud' ELSE 'ok' END"},
)
_VER = "CASE {0} % 6 WHEN 0 THEN 'v' || CAST({0} % 3 AS STRING) || '.' || CAST({0} % 11 AS STRING) WHEN 1 THEN CAST({0} % 3 AS STRING) || '.10.0-rc1' WHEN 2 THEN '0.' || CAST({0} % 12 AS STRING) || '.1' WHEN 3 THEN 'x.1' WHEN 4 THEN '1' ELSE '0.9' END"


def _version(v: str) -> str:
    return rf"(list_concat(list_transform(string_split(regexp_replace({TRIM.format(v)}, '^v+', ''), '.'), lambda x: coalesce(try_cast(regexp_extract(x, '^(\d+)', 1) AS BIGINT), 0)), [0, 0, 0, 0, 0, 0, 0, 0])[1:8])"


_docs("fn_version_newer", {"cur": _VER.format("doc_id"), "new": _VER.format("(doc_id * 7 + 3)")}, {"newer": lambda: T.version_newer(c("cur"), c("new"))}, {"newer": f"{_version('cur')} < {_version('new')}"})
_FEED = """'{"tag_name":"v1","assets":[{"name":"App' || CAST(doc_id AS STRING) || CASE doc_id % 3 WHEN 0 THEN '.exe' WHEN 1 THEN '.zip' ELSE '.MSI' END || '","browser_download_url":"https://x/1"},{"name":"setup.msi","browser_download_url":"https://x/' || source || '"},{"name":"sha256sums","browser_download_url":"https://x/s"}]}'"""
_ASSETS = "array<struct<name:string,browser_download_url:string>>"


def _asset(pattern: str, field: str) -> Column:
    assets = F.from_json(F.get_json_object("t", "$.assets"), _ASSETS)
    return F.get(F.filter(assets, lambda a: F.lower(a["name"]).rlike(pattern)), F.lit(0))[field]


_DA = """from_json(json_extract(t, '$.assets'), '[{"name":"VARCHAR","browser_download_url":"VARCHAR"}]')"""


def _duck_asset(pattern: str, field: str) -> str:
    return f"list_filter({_DA}, lambda a: regexp_matches(lower(a.name), '{pattern}'))[1].{field}"


_docs(
    "fn_pick_asset",
    {"t": _FEED},
    {"name": lambda: F.coalesce(_asset(r"\.msi$", "name"), _asset(r"\.exe$", "name")), "url": lambda: F.coalesce(_asset(r"\.msi$", "browser_download_url"), _asset(r"\.exe$", "browser_download_url")), "sums": lambda: _asset("^sha256sums$", "browser_download_url")},
    {"name": f"coalesce({_duck_asset(chr(92) + '.msi$', 'name')}, {_duck_asset(chr(92) + '.exe$', 'name')})", "url": f"coalesce({_duck_asset(chr(92) + '.msi$', 'browser_download_url')}, {_duck_asset(chr(92) + '.exe$', 'browser_download_url')})", "sums": _duck_asset("^sha256sums$", "browser_download_url")},
)
_docs("fn_sha256", {"t": "text"}, {"digest": lambda: F.sha2(c("t").cast("binary"), 256)}, {"digest": "sha256(t)"})
#: Bytes of a number, and the hash itself in numbers of 128 bits.
_LE = "list_transform(range(8), lambda i: ({0} >> (8 * i)) & 255)"
_FNV = f"list_reduce(list_concat({_LE.format('size')}, {_LE.format('stamp')}, list_transform(string_split(p, ''), lambda x: ord(x))), lambda h, b: (xor(CAST(h AS HUGEINT), CAST(b AS HUGEINT)) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 1469598103934665603::HUGEINT)"
_docs(
    "fn_fnv_cache_key",
    {"p": PATHS, "size": "CAST(n_chars AS BIGINT)", "stamp": "CAST(doc_id * 1000003 AS BIGINT)"},
    {"key": lambda: T.fnv(F.concat(T.long_bytes(c("size")), T.long_bytes(c("stamp")), T.bytes_of(c("p"))))},
    {"key": f"lpad(lower(hex(CAST({_FNV} AS UBIGINT))), 16, '0')"},
)
_docs("fn_peak_db", {"v": "CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE (doc_id % 997 + 1) / 1000.0 END"}, {"shown": lambda: T.peak_db(c("v").cast("double"))}, {"shown": "CASE WHEN v <= 0 THEN '-inf dB' ELSE CAST(CAST(round(20 * log10(CAST(v AS DOUBLE))) AS BIGINT) AS STRING) || ' dB' END"})
#: Names of modes with their defaults, bounds of settings.
MODES = {
    "theme": (("light", "gruvbox_dark", "gruvbox_light", "coffee_dark", "coffee_light"), "dark"), "nav": (("sidebar",), "tabs"), "compute": (("cpu",), "auto"),
    "tier": (("lite", "full"), "standard"), "merge": (("executive", "long"), "ask"), "pdf": (("shell",), "warn"), "retention": (("delete", "archive"), "keep"),
    "denoise": (("off", "aggressive"), "recommended"), "summary": (("recap", "detailed"), "standard"),
}
CLAMPS = {"window": (10, 60), "vram": (50, 95), "doc_cap": (10_000, 2_000_000)}
_WORDS = "CASE doc_id % 12 WHEN 0 THEN 'light' WHEN 1 THEN 'sidebar' WHEN 2 THEN 'cpu' WHEN 3 THEN 'lite' WHEN 4 THEN 'executive' WHEN 5 THEN 'shell' WHEN 6 THEN 'delete' WHEN 7 THEN 'off' WHEN 8 THEN 'detailed' WHEN 9 THEN 'full' WHEN 10 THEN 'recap' ELSE '' END"
_docs(
    "fn_normalizers",
    {"w": _WORDS, "n": "n_chars - 300"},
    {k: (lambda v=v: T.canonical(c("w"), *v)) for k, v in MODES.items()} | {k: (lambda v=v: F.least(F.greatest(c("n"), F.lit(v[0])), F.lit(v[1])).cast("long")) for k, v in CLAMPS.items()},
    {k: f"CASE WHEN w IN ({', '.join(repr(x) for x in v[0])}) THEN w ELSE '{v[1]}' END" for k, v in MODES.items()} | {k: f"CAST(least(greatest(n, {v[0]}), {v[1]}) AS BIGINT)" for k, v in CLAMPS.items()},
)
#: What each tier, attention level and size of memory stands for, in the two queries below.
_TIER = "CASE doc_id % 4 WHEN 0 THEN 'recap' WHEN 1 THEN 'detailed' WHEN 2 THEN 'standard' ELSE 'x' END"
_docs(
    "fn_tier_lookup",
    {"tier": _TIER, "a": "doc_id % 101"},
    {
        "ratio": lambda: F.when(c("tier") == "recap", 25).when(c("tier") == "detailed", 75).otherwise(50).cast("long"),
        "chunk": lambda: F.when(c("tier") == "recap", 1000).when(c("tier") == "detailed", 8000).otherwise(4000).cast("long"),
        "label": lambda: F.when(c("a") < 34, "Overview").when(c("a") < 67, "Balanced").otherwise("Academic"),
        "budget": lambda: F.when(c("a") < 34, 3).when(c("a") < 67, 5).otherwise(10).cast("long"),
        "frames": lambda: F.when(c("a") < 34, 96).when(c("a") < 67, 192).otherwise(384).cast("long"),
    },
    {
        "ratio": "CAST(CASE tier WHEN 'recap' THEN 25 WHEN 'detailed' THEN 75 ELSE 50 END AS BIGINT)", "chunk": "CAST(CASE tier WHEN 'recap' THEN 1000 WHEN 'detailed' THEN 8000 ELSE 4000 END AS BIGINT)",
        "label": "CASE WHEN a < 34 THEN 'Overview' WHEN a < 67 THEN 'Balanced' ELSE 'Academic' END", "budget": "CAST(CASE WHEN a < 34 THEN 3 WHEN a < 67 THEN 5 ELSE 10 END AS BIGINT)", "frames": "CAST(CASE WHEN a < 34 THEN 96 WHEN a < 67 THEN 192 ELSE 384 END AS BIGINT)",
    },
)
_docs(
    "fn_pick_tier",
    {"vram": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 17 END", "ram": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 23 END"},
    {"tier": lambda: F.when(c("vram").isNull() & c("ram").isNull(), "standard").when((c("vram") >= 12) & (c("ram").isNull() | (c("ram") >= 12)), "full").when((c("vram") >= 6) & (c("ram").isNull() | (c("ram") >= 12)), "standard").otherwise("lite")},
    {"tier": "CASE WHEN vram IS NULL AND ram IS NULL THEN 'standard' WHEN vram >= 12 AND (ram IS NULL OR ram >= 12) THEN 'full' WHEN vram >= 6 AND (ram IS NULL OR ram >= 12) THEN 'standard' ELSE 'lite' END"},
)
_docs("fn_json_escape", {"t": "text || chr(9) || '\"' || source"}, {"json": lambda: F.to_json(F.struct(c("t").alias("t")))}, {"json": "CAST(to_json({'t': t}) AS VARCHAR)"})
_docs(
    "fn_fit_predict",
    {"n": "n_chars", "want": "doc_id % 900"},
    {"room": lambda: F.when(F.least(8192 - c("n"), 10240 - c("n")) < 8, -1).otherwise(F.least(F.least(8192 - c("n"), 10240 - c("n")), c("want"))).cast("long")},
    {"room": "CAST(CASE WHEN least(8192 - n, 10240 - n) < 8 THEN -1 ELSE least(8192 - n, 10240 - n, want) END AS BIGINT)"},
)
_docs(
    "fn_context_budget",
    {"n": "n_chars"},
    {"batch": lambda: F.least(F.greatest(c("n") + 2560, F.lit(2048)), F.lit(16384)).cast("long"), "context": lambda: F.least(F.greatest(F.least(F.greatest(c("n") + 2560, F.lit(2048)), F.lit(16384)) + 2048, F.lit(8192)), F.lit(32768)).cast("long")},
    {"batch": "CAST(least(greatest(n + 2560, 2048), 16384) AS BIGINT)", "context": "CAST(least(greatest(least(greatest(n + 2560, 2048), 16384) + 2048, 8192), 32768) AS BIGINT)"},
)
_docs(
    "fn_range_mismatch",
    {"h": "CASE doc_id % 4 WHEN 0 THEN 'bytes ' || CAST(doc_id AS STRING) || '-900/1000' WHEN 1 THEN 'bytes 5-9/10' WHEN 2 THEN 'junk' ELSE 'bytes x-9/10' END", "got": "doc_id"},
    {"mismatch": lambda: F.coalesce(F.regexp_extract("h", r"^bytes (\d+)-", 1).try_cast("long") != c("got"), F.lit(False))},
    {"mismatch": r"coalesce(try_cast(regexp_extract(h, '^bytes (\d+)-', 1) AS BIGINT) <> got, false)"},
)
_docs(
    "fn_review_merge",
    {"l": "text", "r": "' ' || text || ' ' || lang", "pick": "CASE doc_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'both' END"},
    {"center": lambda: F.when(c("pick") == "left", c("l")).when(c("pick") == "right", c("r")).otherwise(F.concat_ws("\n\n", T.trimmed(c("l")), T.trimmed(c("r"))))},
    {"center": f"CASE pick WHEN 'left' THEN l WHEN 'right' THEN r ELSE {TRIM.format('l')} || chr(10) || chr(10) || {TRIM.format('r')} END"},
)
_docs(
    "agg_word_guard",
    {"a": "length(text) - length(replace(text, ' ', '')) + 1", "b": "length(text) - length(replace(text, ' ', '')) + doc_id % 30 - 12"},
    {"verbatim": lambda: (c("b") == 0) | (F.abs(c("a") - c("b")) > F.greatest(F.floor(c("a") / 20), F.lit(8)))},
    {"verbatim": "b = 0 OR abs(a - b) > greatest(a // 20, 8)"},
)
_RATIO = "(CASE WHEN video THEN s * ratio // 100 * (50 + a) // 100 ELSE s * ratio // 100 END)"


def _target() -> Column:
    base = F.floor(c("s") * c("ratio") / 100)
    base = F.when(c("video"), F.floor(base * (50 + c("a")) / 100)).otherwise(base)
    return F.greatest(F.when(c("dup") > 0.5, F.floor(base * 2 / 5)).otherwise(base), F.lit(50)).cast("long")


_docs(
    "agg_length_target",
    {"s": "n_chars", "ratio": "25 * (doc_id % 3 + 1)", "a": "doc_id % 101", "video": "doc_id % 2 = 0", "dup": "(doc_id % 10) / 10.0"},
    {"target": _target, "budget": lambda: F.floor(_target() * 1.3 + 256).cast("long")},
    {"target": f"CAST(greatest(CASE WHEN dup > 0.5 THEN {_RATIO} * 2 // 5 ELSE {_RATIO} END, 50) AS BIGINT)", "budget": f"CAST(floor(greatest(CASE WHEN dup > 0.5 THEN {_RATIO} * 2 // 5 ELSE {_RATIO} END, 50) * 1.3 + 256) AS BIGINT)"},
)
_docs("agg_tokens", {"t": "text"}, {"n": lambda: F.size(T.tokens(c("t"))).cast("long"), "distinct_n": lambda: F.size(F.array_distinct(T.tokens(c("t")))).cast("long")}, {"n": r"CAST(len(list_filter(string_split_regex(lower(t), '[^\p{L}\p{N}]+'), lambda w: strlen(w) >= 3)) AS BIGINT)", "distinct_n": r"CAST(len(list_distinct(list_filter(string_split_regex(lower(t), '[^\p{L}\p{N}]+'), lambda w: strlen(w) >= 3))) AS BIGINT)"})
_SENT = r"list_filter(list_transform(regexp_extract_all(t, '[^.!?\n]*[.!?\n]'), lambda s: regexp_replace(regexp_replace(lower(s), '[ \t\r]+', ' ', 'g'), '^ +', '')), lambda s: length(s) >= 20)"
_DUP = f"(CASE WHEN len({_SENT}) < 10 THEN 0.0 ELSE 1 - len(list_distinct({_SENT})) / len({_SENT}) END)"
_docs("agg_sentence_dup", {"t": "text"}, {"ratio": lambda: T.rounded(T.sentence_dup_ratio(c("t")), 6)}, {"ratio": f"CAST(round({_DUP}, 6) AS DOUBLE)"})
_ALNUM = "regexp_extract_all(lower(t), '[a-z0-9]+')"


def _degenerate() -> Column:
    words = F.regexp_extract_all(F.lower(c("t")), F.lit("[a-z0-9]+"), F.lit(0))
    return (T.sentence_dup_ratio(c("t")) > 0.75) | ((F.size(words) > 40) & (F.size(F.array_distinct(words)) / F.size(words) < 0.2))


_docs("agg_degenerate", {"t": "text"}, {"degenerate": _degenerate}, {"degenerate": f"{_DUP} > 0.75 OR (len({_ALNUM}) > 40 AND len(list_distinct({_ALNUM})) / len({_ALNUM}) < 0.2)"})
_docs("agg_source_count", {"t": NOTE}, {"sources": lambda: F.regexp_count(c("t"), F.lit("\n## ")).cast("long")}, {"sources": "CAST(len(regexp_extract_all(t, '\\n## ')) AS BIGINT)"})
_LOG = r"(SELECT *, length(t) > 262144 AS cut, string_split_regex(right(t, 262144), '\r?\n') AS f FROM (SELECT doc_id, text AS t FROM documents))"
_LOG = f"(SELECT doc_id, cut, CASE WHEN cut THEN f[2:] ELSE f END AS f FROM (SELECT doc_id, cut, CASE WHEN f[len(f)] = '' THEN f[1:len(f) - 1] ELSE f END AS f FROM {_LOG}))"


def _log(field: str) -> Callable[[], Column]:
    return lambda: T.log_tail(c("t"))[field]


_docs("src_log_tail", {"t": "text"}, {"tail": _log("tail"), "truncated": _log("truncated")}, {"tail": "t"})
SQL["src_log_tail"] = f"SELECT doc_id, array_to_string(list_transform(f[greatest(len(f) - 199, 1):], lambda x: CASE WHEN length(x) > 2000 THEN left(x, 2000) || '…' ELSE x END), chr(10)) AS tail, cut OR len(f) > 200 AS truncated FROM {_LOG}"
