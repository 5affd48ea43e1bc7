"""String functions on columns: names, labels, paths, stamps, tokens. Limits that the source states in bytes hold for characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leads that are cut from topics, stop words of query terms, markers of echoed guides.
LEADS = (
    "executive summary", "summary", "key points", "overview", "tldr", "tl;dr", "what happens",
    "what it is about", "what the ai makes of it", "related", "the compressed whole",
)
STOP = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "day", "lec", "lecture", "class", "part", "episode", "film", "video", "watch")
GUIDE_MARKS = ("AGENTS.md", "behavior supplement", "MAP (excerpt)", "REDUCE (summary)", "[Program behavior]")
SKIP_MARK = "*(summary skipped — raw transcript only)*"


def trimmed(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def or_else(c: Column, default: str) -> Column:
    return F.when(c == "", default).otherwise(c)


def sanitize_filename(c: Column) -> Column:
    return or_else(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', "-"), r"[ .]+\z", ""), "Untitled")


def sanitize_stem(c: Column, most: int = 80) -> Column:
    c = trimmed(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1F\x7F]', "-"))
    c = trimmed(F.regexp_replace(c, r"^\.+|\.+\z", ""))
    return F.left(F.regexp_replace(c, "-{2,}", "-"), F.lit(most))


def research_stem(c: Column, most: int = 60) -> Column:
    return or_else(F.left(trimmed(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1F\x7F]', "-")), F.lit(most)), "research")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".\.([^.]*)$", 1))


def parent_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]*$", 1)


def parse_day(name: Column) -> Column:
    """Day label of a file name, or null."""

    def day(pattern: str) -> Column:
        return F.when(name.rlike(pattern), F.concat(F.lit("Day "), F.regexp_extract(name, pattern, 1)))

    iso = r"(\d{4}-\d{2}-\d{2})"
    return F.coalesce(day(r"(?i)day[\s_-]*(\d{1,3})"), day(r"(?i)lec(?:ture)?[\s_-]*(\d{1,3})"), F.when(name.rlike(iso), F.regexp_extract(name, iso, 1)), day(r"(?:^|[\s_\-\[(])(\d{1,3})(?:[\s_\-\])]|$)"))


def heuristic_name(path: Column) -> Column:
    """class - day - topic, from path tokens, the parent folder and the first 40 characters of the stem."""
    tokens = F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda t: t != "")
    number = F.transform(
        F.arrays_zip(tokens.alias("t"), F.concat(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))), F.array(F.lit(""))).alias("n")),
        lambda p: F.when(p["t"].isin("day", "lec", "lecture") & p["n"].rlike(r"^\d{1,3}$"), p["n"]).when(p["t"].rlike(r"^(day|lec|lecture)\d{1,3}$") & ~p["t"].rlike(r"[a-z]1$"), F.regexp_extract(p["t"], r"(\d+)$", 1)).otherwise(""),
    )
    day = F.concat(F.lit("Day "), F.coalesce(F.get(F.filter(number, lambda x: x != ""), F.lit(0)), F.lit("1")))
    topic = F.left(stem(path), F.lit(40))
    cut = F.when(F.startswith(F.lower(topic), F.lower(day)), F.regexp_replace(F.substring(topic, F.length(day) + 1, F.lit(1000)), "^[- ]+", "")).otherwise(topic)
    return F.concat_ws(" - ", or_else(parent_name(path), "General"), day, cut)


def clean_label(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x20\x7F]+", " "), r"^ +| +\z", "")
    cut = F.regexp_extract(c, "^(.{0,80}) ", 1)
    return or_else(F.when(F.length(c) > 80, F.when(cut != "", cut).otherwise(F.left(c, F.lit(80)))).otherwise(c), "Untitled")


def strip_topic_lead(c: Column) -> Column:
    """Leading marks, bullets, quotes and generic headings, again and again."""
    marks = r"[ \t\r\n#*+>:,.;]|-(?= |$)"
    quotes = "•|—|–|“|”|‘|’|«|»|…|¬|\"|'"
    leads = "|".join(x.replace(".", r"\.") for x in LEADS)
    return F.regexp_replace(c, rf"^(?:{marks}|{quotes}|(?i:{leads})(?=$|[ :,.\-]))+", "")


def strip_bracketed(c: Column) -> Column:
    return F.regexp_replace(c, r"\[[^\]]{0,23}\]", "")


def cap_title(c: Column, most: Column | int) -> Column:
    return or_else(F.regexp_replace(F.left(c, F.lit(most)), r"[ .\-]+\z", ""), "Untitled")


def compose_title(cls: Column, day: Column, topic: Column) -> Column:
    return cap_title(sanitize_filename(F.concat(cls, F.lit(" - "), day, F.when(topic != "", F.concat(F.lit(" - "), topic)).otherwise(""))), 100)


def head_tail(c: Column, head: int, tail: int) -> Column:
    return F.when(F.length(c) > head + tail, F.concat(F.left(c, F.lit(head)), F.lit("\n[…]\n"), F.right(c, F.lit(tail)))).otherwise(c)


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def fmt_time(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    minutes = F.floor(s / 60).cast("string")
    return F.when(s >= 3600, F.concat_ws(":", h.cast("string"), _two(m), _two(r))).otherwise(F.concat_ws(":", F.lpad(minutes, F.greatest(F.length(minutes), F.lit(2)), F.lit("0")), _two(r)))


def fmt_srt(ms: Column) -> Column:
    v = F.greatest(ms, F.lit(0)).cast("long")
    hours = F.floor(v / 3600000).cast("string")
    return F.concat(F.lpad(hours, F.greatest(F.length(hours), F.lit(2)), F.lit("0")), F.lit(":"), _two(F.floor(v % 3600000 / 60000)), F.lit(":"), _two(F.floor(v % 60000 / 1000)), F.lit(","), F.lpad((v % 1000).cast("string"), 3, "0"))


def parse_stamp(line: Column) -> Column:
    """Milliseconds of the first bracketed [MM:SS] or [H:MM:SS]; -1 if that is no stamp."""
    first = F.regexp_extract(line, r"^[^\[]*\[([^\]]*)\]", 1)
    parts = F.split(first, ":")
    n = F.size(parts)
    numbers = F.transform(parts, lambda x: x.try_cast("long"))
    h = F.when(n == 3, F.get(numbers, F.lit(0))).otherwise(0)
    m, s = F.get(numbers, n - 2), F.get(numbers, n - 1)
    good = first.rlike(r"^\d+:\d+(?::\d+)?$") & (F.length(first) <= 15) & (m < 60) & (s < 60)
    return F.when(good, (h * 3600 + m * 60 + s) * 1000).otherwise(-1).cast("long")


def fmt_size(size: Column) -> Column:
    def unit(power: int, name: str) -> Column:
        # exact, as a double over a power of two is; halves go to the even tenth
        shown = size.cast("double") / float(1024**power)
        whole = F.floor(shown)
        tenths = whole * 10 + F.rint((shown - whole) * 10).cast("long")
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {name}"))

    return F.when(size >= 1024**3, unit(3, "GB")).when(size >= 1024**2, unit(2, "MB")).when(size >= 1024, unit(1, "KB")).otherwise(F.concat(size.cast("string"), F.lit(" B")))


def civil_date(days: Column) -> Column:
    """Y-M-D of days since 1970; years of five digits have no sign."""
    return F.regexp_replace(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd"), r"^\+", "")


def rounded(value: Column, places: int) -> Column:
    """A double rounded as SQL engines and C do: the scaled double, halves away from zero; F.round rounds its shortest decimal form."""
    scale = float(10**places)
    scaled = F.round(value * scale) / scale
    return F.when(F.isnan(scaled) | (F.abs(scaled) == float("inf")), value).otherwise(scaled)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).cast("long")


def alpha_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z0-9]+")).cast("long")


def est_tokens(c: Column) -> Column:
    return (F.floor(F.octet_length(c) / 4) + 1).cast("long")


def normalize_ws(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), r"[ \t\r\f]+(\n|\z)", "$1")
    return trimmed(F.regexp_replace(c, "\n{4,}", "\n\n\n"))


def query_terms(c: Column, most: int) -> Column:
    words = F.filter(F.split(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: (F.octet_length(w) >= 3) & ~w.isin(*STOP))
    return F.slice(F.array_distinct(words), 1, most)


def url_allowed(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://[^/?#@\\\s][^/?#\\\s@]*(?:[/?#][^@]*)?$")


def result_links(html: Column, most: int) -> Column:
    raw = F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))
    wrapped = lambda x: F.try_url_decode(F.regexp_extract(x, "uddg=([^&]*)", 1))
    urls = F.transform(raw, lambda x: F.split_part(F.when(x.contains("uddg="), wrapped(x)).otherwise(x), F.lit("&"), F.lit(1)))
    return F.slice(F.array_distinct(F.filter(urls, url_allowed)), 1, most)


def strip_guide_echo(c: Column) -> Column:
    marks = "|".join("\\Q" + m + "\\E" for m in GUIDE_MARKS)
    kept = F.regexp_replace(F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(f"(?i){marks}")), "\n"), r"\n+\z", "")
    return F.when(kept == "", c).otherwise(kept)


def sidecar_int(text: Column, key: str) -> Column:
    return F.regexp_extract(text, rf'"{key}":\s*(-?\d+)', 1).try_cast("long")


def parse_md(md: Column) -> Column:
    """(raw, summary, skipped) of a note in the single or the merged layout."""
    marker = F.when(md.contains("## Source Texts"), F.lit("## Source Texts")).otherwise("## Raw Transcript")
    parts = F.split(md, marker)
    parts = F.when(md.contains("## Source Texts"), F.split(md, "## Source Texts")).otherwise(F.split(md, "## Raw Transcript"))
    summary = trimmed(F.coalesce(F.get(F.split(F.get(parts, F.lit(0)), "## Summary"), F.lit(1)), F.lit("")))
    raw = trimmed(F.get(F.split(trimmed(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), "\n## Audio"), F.lit(0)))
    skipped = summary.contains(SKIP_MARK)
    return F.struct(raw.alias("raw"), F.when(skipped, "").otherwise(summary).alias("summary"), skipped.alias("skipped"))


def section_head(md: Column, most: int = 800) -> Column:
    at = F.instr(md, "## Summary")
    return F.substring(md, F.greatest(at, F.lit(1)), F.lit(most))


def confined(name: Column) -> Column:
    """Relative path below a folder, without drive, stream or parent parts, ending in .md or .json."""
    return ~name.rlike(r"^[/\\]") & ~name.contains(":") & ~name.rlike(r"(^|[/\\])\.\.([/\\]|$)") & name.rlike(r"(?i)[^/\\]\.(md|json)$")


def path_policy(path: Column, capture: Column, kind: Column) -> Column:
    """Decision on a folder that a user names: ok, warn or the reason against it. kind: fixed, removable, remote or unknown."""
    p = trimmed(path)
    unc = p.rlike(r"^(\\\\|//)")
    cloud = F.lower(p).rlike("onedrive|dropbox")
    return (
        F.when(p == "", "empty")
        .when(F.regexp_replace(p, "^.:", "").rlike(r"[/\\].*:"), "stream")
        .when(~p.rlike(r"^([A-Za-z]:[/\\]|[/\\])"), "relative")
        .when(unc & capture, "network")
        .when(unc, "warn network")
        .when(kind.isin("remote", "unknown") & capture, "network")
        .when((kind == "removable") & capture, "removable")
        .when((kind == "removable") & cloud, "warn removable cloud")
        .when(kind == "removable", "warn removable")
        .when(cloud, "warn cloud")
        .otherwise("ok")
    )


def version_newer(current: Column, latest: Column) -> Column:
    def parts(v: Column) -> Column:
        numbers = F.transform(F.split(F.regexp_replace(trimmed(v), "^v+", ""), r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^(\d+)", 1).try_cast("long"), F.lit(0).cast("long")))
        return F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), 8)), 1, 8)

    return parts(current) < parts(latest)


def canonical(c: Column, known: tuple[str, ...], default: str) -> Column:
    return F.when(c.isin(*known), c).otherwise(default)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def peak_db(peak: Column) -> Column:
    return F.when(peak <= 0, "-inf dB").otherwise(F.concat(F.round(20 * F.log10(peak)).cast("long").cast("string"), F.lit(" dB")))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits of at least three bytes."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= 3)


def sentence_dup_ratio(c: Column) -> Column:
    """Share of repeated sentences of 20 characters or more; 0 under ten sentences."""
    # the whole text is cleaned before it is cut, and one fold over one array gives both numbers
    clean = F.regexp_replace(F.regexp_replace(F.lower(c), "[ \t\r]+", " "), r"(^|[.!?\n]) +", "$1")
    # cut behind each mark: looking for the next mark from every place would be quadratic in texts without marks
    found = F.filter(F.split(clean, r"(?<=[.!?\n])"), lambda s: (F.length(s) >= 20) & F.right(s, F.lit(1)).isin(".", "!", "?", "\n"))
    sizes = F.transform(F.array(found), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return F.get(F.transform(sizes, lambda x: F.when(x["n"] < 10, 0.0).otherwise(1 - x["d"] / x["n"])), F.lit(0))


def fnv(parts: Column) -> Column:
    """FNV-1a of 64 bits over an array of byte values, as 16 hex digits.

    Offset basis and prime (2**40 + 0x1B3) are fixed values. The state is kept as two halves of 32 bits, so no product leaves a long."""
    start = F.struct(F.lit(1469598103934665603 >> 32).cast("long").alias("high"), F.lit(1469598103934665603 & 0xFFFFFFFF).cast("long").alias("low"))
    mask = F.lit(0xFFFFFFFF)

    def step(h: Column, b: Column) -> Column:
        low = h["low"].bitwiseXOR(b)
        product = low * 0x1B3
        high = (h["high"] * 0x1B3 + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(mask)
        return F.struct(high.alias("high"), product.bitwiseAND(mask).alias("low"))

    return F.aggregate(parts, start, step, lambda h: F.lower(F.concat(F.lpad(F.hex(h["high"]), 8, "0"), F.lpad(F.hex(h["low"]), 8, "0"))))


def bytes_of(c: Column) -> Column:
    """The bytes of a string as an array of numbers."""
    return F.transform(F.filter(F.split(F.regexp_replace(F.hex(c.cast("binary")), "(..)", "$1 "), " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))


def long_bytes(c: Column) -> Column:
    """The eight bytes of a long, the lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(56), F.lit(8)), lambda i: F.call_function("shiftright", c.cast("long"), i).bitwiseAND(F.lit(255).cast("long")))


def log_tail(c: Column, lines: int = 200, most: int = 2000, window: int = 262144) -> Column:
    """(tail, truncated): the last lines of the last characters; a first line that the window cuts goes, long lines are marked."""
    cut = F.length(c) > window
    found = F.split(F.right(c, F.lit(window)), "\r?\n")
    found = F.when(F.element_at(found, -1) == "", F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found)
    found = F.when(cut & (F.size(found) > 0), F.slice(found, F.lit(2), F.size(found))).otherwise(found)
    last = F.slice(found, F.greatest(F.size(found) - (lines - 1), F.lit(1)), F.lit(lines))
    marked = F.transform(last, lambda x: F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("…"))).otherwise(x))
    return F.struct(F.array_join(marked, "\n").alias("tail"), (cut | (F.size(found) > lines)).alias("truncated"))
