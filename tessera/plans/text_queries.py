"""Queries of similarity, chunking, cues, speakers and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import cues, models, reduction, similarity
from tessera.registry import query, table
from tessera.sources import sinks

c = F.col
#: Default bands of similarity.
SUGGEST, PROMPT = 0.35, 0.80


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), c("source").alias("lib"), "text")


_TF = r"""words AS (SELECT doc_id AS id, source AS lib, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: strlen(w) >= 3) AS w FROM documents),
tf AS (SELECT id, lib, term, count(*) / max(n) AS tf FROM (SELECT id, lib, len(w) AS n, unnest(w) AS term FROM words) GROUP BY ALL),
q AS (SELECT id, sum(tf * tf) AS q FROM tf GROUP BY id),
sums AS (SELECT x.lib, x.id AS a, y.id AS b, sum(x.tf * y.tf) AS d, sum(x.tf * x.tf) AS sa, sum(y.tf * y.tf) AS sb FROM tf x JOIN tf y ON x.lib = y.lib AND x.term = y.term AND x.id < y.id GROUP BY ALL),
pairs AS (SELECT a, b, lib, round(least(greatest(d / sqrt((k * qa.q - (k - 1) * sa) * (k * qb.q - (k - 1) * sb)), 0.0), 1.0), 6) AS score FROM sums JOIN q qa ON qa.id = a JOIN q qb ON qb.id = b, (SELECT power(1 + ln(1.5), 2) AS k))"""
_COMPONENTS = """edges AS (SELECT a, b, score FROM pairs WHERE score >= 0.35), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(n, m) AS (SELECT a, a FROM both_ways UNION SELECT r.n, e.b FROM reach r JOIN both_ways e ON e.a = r.m),
comp AS (SELECT n AS node, min(m) AS component FROM reach GROUP BY n)"""


@query("agg_tfidf_cosine", f"WITH {_TF} SELECT a, b, lib, score FROM pairs WHERE score >= 0.35")
def agg_tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cosine_pairs(_items(spark, sf_dir), low=SUGGEST)


@query("join_term_pairs", "WITH t AS (SELECT DISTINCT doc_id AS id, source AS lib, unnest(list_filter(string_split_regex(lower(left(text, 4000)), '[^\\p{L}\\p{N}]+'), lambda w: strlen(w) >= 3)) AS term FROM documents) SELECT a.id AS a, b.id AS b, count(*) AS shared FROM t a JOIN t b ON a.lib = b.lib AND a.term = b.term AND a.id < b.id GROUP BY ALL")
def join_term_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.term_pairs(_items(spark, sf_dir))


@query("agg_similarity_groups", f"WITH RECURSIVE {_TF}, {_COMPONENTS} SELECT component, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members, max(best) AS score, CASE WHEN max(best) >= 0.8 THEN 'prompt' ELSE 'suggest' END AS band FROM comp JOIN (SELECT n, max(score) AS best FROM (SELECT a AS n, score FROM edges UNION ALL SELECT b, score FROM edges) GROUP BY n) ON n = node GROUP BY component")
def agg_similarity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.groups(similarity.linking_pairs(_items(spark, sf_dir), low=SUGGEST), SUGGEST, PROMPT)


@query("agg_group_key", "SELECT key, band FROM (SELECT conv_id, string_agg(role || '-' || CAST(turn AS VARCHAR), ' + ' ORDER BY role || '-' || CAST(turn AS VARCHAR)) AS key, CASE WHEN count(*) > 4 AND conv_id <> 1 THEN 'prompt' ELSE 'suggest' END AS band FROM conversations GROUP BY conv_id) WHERE conv_id NOT IN (SELECT item_id * 3 FROM benchmark)")
def agg_group_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a group (here: turns of a conversation) make its key; dismissed groups go, and those without automatic prompt are only suggested."""
    members = table(spark, sf_dir, "conversations").select("conv_id", F.concat_ws("-", "role", c("turn").cast("string")).alias("name"))
    keyed = members.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list("name")), " + ").alias("key"), F.count("*").alias("n"))
    dismissed = table(spark, sf_dir, "benchmark").select((c("item_id") * 3).alias("conv_id"))
    return keyed.join(dismissed, "conv_id", "left_anti").select("key", F.when((c("n") > 4) & (c("conv_id") != 1), "prompt").otherwise("suggest").alias("band"))


_MEMBERS = "SELECT conv_id, turn, role || '-' || CAST(turn AS VARCHAR) AS name, role AS kind, text AS body FROM conversations"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a group: its turns in order, with name, kind and body."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat_ws("-", "role", c("turn").cast("string")).alias("name"), c("role").alias("kind"), c("text").alias("body")).alias("x"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("m"))


@query("agg_merged_input", f"SELECT conv_id, 'MERGE MODE: long' || chr(10) || CAST(count(*) AS VARCHAR) || ' sources' || chr(10) || string_agg('--- ' || name || ' (' || kind || ') ---' || chr(10), '' ORDER BY turn) || chr(10) || string_agg('--- ' || name || ' (' || kind || ') ---' || chr(10) || body || chr(10) || chr(10), '' ORDER BY turn) AS input FROM ({_MEMBERS}) GROUP BY conv_id")
def agg_merged_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One input text per group: mode, ledger of members, then each member's text under its line."""
    line = lambda x: F.concat(F.lit("--- "), x["name"], F.lit(" ("), x["kind"], F.lit(") ---\n"))
    ledger = F.array_join(F.transform("m", line), "")
    bodies = F.array_join(F.transform("m", lambda x: F.concat(line(x), x["body"], F.lit("\n\n"))), "")
    return _members(spark, sf_dir).select("conv_id", F.concat(F.lit("MERGE MODE: long\n"), F.size("m").cast("string"), F.lit(" sources\n"), ledger, F.lit("\n"), bodies).alias("input"))


@query("sink_merged_md", f"SELECT conv_id, '#c' || CAST(conv_id AS VARCHAR) || chr(10) || chr(10) || '## Sources' || chr(10) || string_agg('- ' || name || ' (' || kind || ', ' || CAST(length(body) AS VARCHAR) || ' chars)' || chr(10), '' ORDER BY turn) || chr(10) || '## Summary' || chr(10) || '{T.SKIP_MARK}' || chr(10) || chr(10) || '## Source Texts' || chr(10) || string_agg('### ' || name || chr(10) || regexp_replace(body, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10), '' ORDER BY turn) AS md FROM ({_MEMBERS}) GROUP BY conv_id")
def sink_merged_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = F.array_join(F.transform("m", lambda x: F.concat(F.lit("- "), x["name"], F.lit(" ("), x["kind"], F.lit(", "), F.length(x["body"]).cast("string"), F.lit(" chars)\n"))), "")
    bodies = F.array_join(F.transform("m", lambda x: F.concat(F.lit("### "), x["name"], F.lit("\n"), T.trimmed(x["body"]), F.lit("\n\n"))), "")
    notes = _members(spark, sf_dir).select("conv_id", F.concat(F.lit("#c"), c("conv_id").cast("string"), F.lit("\n\n## Sources\n"), ledger, F.lit(f"\n## Summary\n{T.SKIP_MARK}\n\n## Source Texts\n"), bodies).alias("md"))
    return sinks.through_files(spark, notes, "conv_id", "md", ".md")


#: A fold over words: the size of the last chunk, then the chunks.
_PACKED = r"""c AS (SELECT doc_id, list_reduce(list_prepend(['0'], list_transform(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> ''), lambda w: [w])), lambda acc, w: CASE WHEN len(acc) = 1 OR CAST(acc[1] AS INTEGER) + 2 + strlen(w[1]) // 4 > 1000
THEN list_concat(list_concat([CAST(strlen(w[1]) // 4 + 1 AS VARCHAR)], acc[2:]), w) ELSE list_concat(list_concat([CAST(CAST(acc[1] AS INTEGER) + 2 + strlen(w[1]) // 4 AS VARCHAR)], acc[2:len(acc) - 1]), [acc[len(acc)] || ' ' || w[1]]) END) AS acc FROM documents),
p AS (SELECT doc_id, CASE WHEN len(acc) = 1 THEN [''] ELSE acc[2:] END AS parts FROM c)"""


@query("win_chunk_by_tokens", f"WITH {_PACKED} SELECT doc_id, CAST(unnest(range(len(parts))) AS BIGINT) AS chunk, unnest(parts) AS body FROM p")
def win_chunk_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", cues.chunks(c("text"), 1000).alias("parts"))
    return docs.select("doc_id", F.posexplode("parts").alias("chunk", "body")).select("doc_id", c("chunk").cast("long").alias("chunk"), "body")


@query("agg_extractive_summary", f"WITH {_PACKED} SELECT doc_id, array_to_string(list_transform(parts, lambda x, i: chr(10) || chr(10) || '[chunk ' || i || '] ' || left(x, 400)), '') AS notes FROM p")
def agg_extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a model: the head of every chunk."""
    docs = table(spark, sf_dir, "documents").select("doc_id", cues.chunks(c("text"), 1000).alias("p"))
    return docs.select("doc_id", F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("\n\n[chunk "), (i + 1).cast("string"), F.lit("] "), F.left(x, F.lit(400)))), "").alias("notes"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as transcript lines: stamped every third line, one in eleven back in time."""
    t = table(spark, sf_dir, "conversations")
    at = F.when(c("turn") % 11 == 5, c("turn") * 7 - 60).otherwise(c("turn") * 7)
    at = F.greatest(at, F.lit(0))
    stamp = F.format_string("[%02d:%02d]", F.floor(at / 60), at % 60)
    body = F.regexp_replace("text", r"[\n\[\]]", " ")
    return t.select("conv_id", "turn", F.when(c("turn") % 3 == 2, body).otherwise(F.concat(stamp, F.lit(" "), body)).alias("line"))


_LINES = r"""lines AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN -1 ELSE greatest(CASE WHEN turn % 11 = 5 THEN turn * 7 - 60 ELSE turn * 7 END, 0) * 1000 END AS ms,
regexp_replace(CASE WHEN turn % 3 = 2 THEN regexp_replace(text, '[\n\[\]]', ' ', 'g') ELSE regexp_replace(regexp_replace(text, '[\n\[\]]', ' ', 'g'), '^[ \t]+', '') END, '[ \t\r]+$', '') AS body FROM conversations),
top AS (SELECT *, max(CASE WHEN ms >= 0 THEN ms END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM lines WHERE ms >= 0 OR body <> ''),
kept AS (SELECT *, sum(CASE WHEN ms >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS idx FROM top WHERE ms < 0 OR top IS NULL OR ms >= top),
grp AS (SELECT conv_id, CAST(idx AS BIGINT) AS idx, CAST(max(ms) AS BIGINT) AS start_ms, string_agg(body, ' ' ORDER BY turn) AS text FROM kept WHERE idx > 0 GROUP BY conv_id, idx),
ended AS (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY conv_id ORDER BY idx), 100000) AS e FROM grp),
cues AS (SELECT conv_id, idx, start_ms, CASE WHEN e <= start_ms THEN start_ms + 1000 ELSE e END AS end_ms, CASE WHEN text = '' THEN '(silence)' ELSE left(text, 2000) END AS text FROM ended)"""


@query("win_srt_cues", f"WITH {_LINES} SELECT * FROM cues")
def win_srt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.srt_cues(_lines(spark, sf_dir), "conv_id", "turn", F.lit(100_000).cast("long"))


def _ts(ms: str) -> str:
    return f"lpad(CAST({ms} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} % 60000 // 1000 AS VARCHAR), 2, '0') || ',' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"


@query("sink_srt", f"WITH {_LINES} SELECT conv_id, string_agg(CAST(idx AS VARCHAR) || chr(10) || {_ts('start_ms')} || ' --> ' || {_ts('end_ms')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY idx) AS srt FROM cues GROUP BY conv_id")
def sink_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = win_srt_cues(spark, sf_dir)
    one = F.concat(c("idx").cast("string"), F.lit("\n"), T.fmt_srt(c("start_ms")), F.lit(" --> "), T.fmt_srt(c("end_ms")), F.lit("\n"), c("text"), F.lit("\n\n"))
    whole = found.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", one.alias("cue")))), lambda x: x["cue"]), "").alias("srt"))
    return sinks.through_files(spark, whole, "conv_id", "srt", ".srt")


@query("win_speaker_turns", "SELECT conv_id, turn, CAST(s AS BIGINT) AS speaker, CASE WHEN lag(s) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM s THEN 'Speaker ' || CAST(s AS VARCHAR) || ': ' ELSE '' END AS label FROM (SELECT conv_id, turn, CAST(1 + coalesce(sum(CASE WHEN length(text) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS BIGINT) AS s FROM conversations)")
def win_speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", cues.speaker(F.length("text") % 3 == 0, "conv_id", "turn").alias("speaker"))
    before = F.lag("speaker").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select("conv_id", "turn", "speaker", F.when(~before.eqNullSafe(c("speaker")), F.concat(F.lit("Speaker "), c("speaker").cast("string"), F.lit(": "))).otherwise("").alias("label"))


_STAMPS = r"""WITH p AS (SELECT conv_id, turn, k, trim(x) AS x, regexp_matches(x, '[.?!]$') AS ends FROM (SELECT conv_id, turn, unnest(regexp_extract_all(regexp_replace(text, '\s+', ' ', 'g'), '[^.?!]*[.?!]|[^.?!]+')) AS x, unnest(range(len(regexp_extract_all(regexp_replace(text, '\s+', ' ', 'g'), '[^.?!]*[.?!]|[^.?!]+')))) AS k FROM conversations) WHERE trim(x) <> ''),
n AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER w, 0) AS n, max(CASE WHEN ends THEN turn END) OVER w AS since FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, n, '[' || CASE WHEN t >= 3600 THEN CAST(t // 3600 AS VARCHAR) || ':' || lpad(CAST(t % 3600 // 60 AS VARCHAR), 2, '0') ELSE lpad(CAST(t // 60 AS VARCHAR), 2, '0') END || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') || ']' AS stamp, sentence
FROM (SELECT conv_id, CAST(n AS BIGINT) AS n, 7 * coalesce(max(since), min(turn)) AS t, string_agg(x, ' ' ORDER BY turn, k) AS sentence FROM n GROUP BY conv_id, n)"""


@query("win_sentence_stamp", _STAMPS)
def win_sentence_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of conversations whose turns are seven seconds apart."""
    found = cues.sentences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    return found.select("conv_id", "n", F.concat(F.lit("["), T.fmt_time(c("turn") * 7), F.lit("]")).alias("stamp"), "sentence")


_BAG = "a AS (SELECT doc_id, string_split(text, chr(10))[1:500] AS o, string_split(replace(text, 'the', 'THE'), chr(10))[1:500] AS n FROM documents)"


_CHANGES = "d AS (SELECT doc_id, list_filter(o, lambda x: NOT list_contains(n, x)) AS gone, list_filter(n, lambda x: NOT list_contains(o, x)) AS fresh FROM a)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, and the lines of a bag diff that are gone and that are new."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.slice(F.split("text", "\n"), 1, 500).alias("o"), F.slice(F.split(F.replace(c("text"), F.lit("the"), F.lit("THE")), "\n"), 1, 500).alias("n"))
    return docs.select("doc_id", F.filter("o", lambda x: ~F.array_contains(c("n"), x)).alias("gone"), F.filter("n", lambda x: ~F.array_contains(c("o"), x)).alias("fresh"))


@query("win_bag_diff", f"WITH {_BAG}, {_CHANGES} SELECT doc_id, CASE WHEN len(gone) + len(fresh) = 0 THEN ' (no differences)' ELSE array_to_string(list_concat(list_transform(gone, lambda x: '-' || x), list_transform(fresh, lambda x: '+' || x)), chr(10)) END AS diff FROM d")
def win_bag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat(F.transform("gone", lambda x: F.concat(F.lit("-"), x)), F.transform("fresh", lambda x: F.concat(F.lit("+"), x)))
    return _changes(spark, sf_dir).select("doc_id", F.when(F.size(both) == 0, " (no differences)").otherwise(F.array_join(both, "\n")).alias("diff"))


#: The table of lengths, a row a step from the last line up, then the walk through it.
_LCS = """WITH RECURSIVE v AS (SELECT doc_id, coalesce(text, '') AS a, replace(replace(coalesce(text, ''), 'and', 'AND'), chr(10) || 'The', chr(10) || chr(10) || 'The') AS b FROM documents),
d AS (SELECT doc_id, string_split(regexp_replace(a, '\n$', ''), chr(10)) AS o, string_split(regexp_replace(b, '\n$', ''), chr(10)) AS n FROM v),
dp(doc_id, i, r) AS (SELECT doc_id, CAST(len(o) AS BIGINT), [CAST(0 AS BIGINT) FOR x IN range(len(n) + 1)] FROM d UNION ALL
SELECT doc_id, i - 1, list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(len(n), 0, -1), lambda j: [j])), lambda acc, x: list_prepend(CASE WHEN o[i] = n[x[1]] THEN r[x[1] + 1] + 1 ELSE greatest(r[x[1]], acc[1]) END, acc)) FROM dp JOIN d USING (doc_id) WHERE i > 0),
w(doc_id, step, i, k, t, x) AS (SELECT doc_id, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', '' FROM d UNION ALL
SELECT doc_id, step + 1, i + CASE WHEN t = '+' THEN 0 ELSE 1 END, k + CASE WHEN t = '-' THEN 0 ELSE 1 END, t, CASE WHEN t = '+' THEN n[k + 1] ELSE o[i + 1] END FROM (
SELECT d.doc_id, step, w.i, k, o, n, CASE WHEN w.i < len(o) AND k < len(n) AND o[w.i + 1] = n[k + 1] THEN ' ' WHEN w.i < len(o) AND (k = len(n) OR below.r[k + 1] >= here.r[k + 2]) THEN '-' ELSE '+' END AS t
FROM w JOIN d ON d.doc_id = w.doc_id LEFT JOIN dp here ON here.doc_id = w.doc_id AND here.i = w.i LEFT JOIN dp below ON below.doc_id = w.doc_id AND below.i = w.i + 1 WHERE w.i < len(o) OR k < len(n))),
j AS (SELECT doc_id, CAST(to_json(list({'t': t, 'text': x, 'chunk': 0} ORDER BY step)) AS VARCHAR) AS diff FROM w WHERE step > 0 GROUP BY doc_id)"""


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, diff) between texts and what became of them: some words changed, empty lines came in."""
    old = F.coalesce("text", F.lit(""))
    new = F.replace(F.replace(old, F.lit("and"), F.lit("AND")), F.lit("\nThe"), F.lit("\n\nThe"))
    return cues.line_diffs(table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), old.alias("old"), new.alias("new")))


@query("win_lcs_diff", f"{_LCS} SELECT doc_id, diff FROM j")
def win_lcs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir).select(c("id").alias("doc_id"), F.to_json("diff").alias("diff"))


@query("sink_diff_json", f"{_LCS} SELECT doc_id, diff AS json FROM j")
def sink_diff_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line diff of each document as a JSON file beside it, read back."""
    return sinks.through_files(spark, _diffs(spark, sf_dir).select(c("id").alias("doc_id"), F.to_json("diff").alias("json")), "doc_id", "json", ".json")


_REDUCED = "regexp_replace(left('Summarise in about ' || target || ' words:' || chr(10) || body, 600), '\\n+$', '')"
_LIMIT = 256


def _reduce_sql() -> str:
    """The split by recursion, then one step up a level."""
    up = [f"u6 AS (SELECT doc_id, pos, {_REDUCED} AS body, CAST(1 AS BIGINT) AS parts, CAST(6 AS BIGINT) AS depth FROM leaves WHERE depth = 6)"]
    for d in range(5, -1, -1):
        up.append(
            f"""j{d} AS (SELECT x.doc_id, t.pos, target, x.body || chr(10) || chr(10) || '## Part' || chr(10) || chr(10) || y.body AS body, x.parts + y.parts AS parts, greatest(x.depth, y.depth) AS depth FROM u{d + 1} x JOIN u{d + 1} y ON x.doc_id = y.doc_id AND left(x.pos, {d}) = left(y.pos, {d}) AND right(x.pos, 1) = '0' AND right(y.pos, 1) = '1' JOIN t ON t.doc_id = x.doc_id AND t.pos = left(x.pos, {d})),
u{d} AS (SELECT doc_id, pos, CASE WHEN strlen(body) // 4 + 1 <= {_LIMIT} THEN {_REDUCED} ELSE body END AS body, parts, depth FROM j{d} UNION ALL SELECT doc_id, pos, {_REDUCED}, 1, depth FROM leaves WHERE depth = {d})"""
        )
    return f"""WITH RECURSIVE t(doc_id, depth, pos, body, target) AS (SELECT doc_id, 0, CAST('' AS VARCHAR), coalesce(text, ''), CAST(100 AS BIGINT) FROM documents UNION ALL
SELECT doc_id, depth + 1, pos || side, CASE side WHEN '0' THEN left(body, cut) ELSE substr(body, cut + 1) END, CASE side WHEN '0' THEN CAST(floor(target * (cut / length(body))) AS BIGINT) ELSE target - CAST(floor(target * (cut / length(body))) AS BIGINT) END
FROM (SELECT *, CASE WHEN nl > 0 AND mid + nl - 1 <= length(body) * 3 // 4 THEN mid + nl - 1 WHEN contains(left(body, mid + 1), ' ') THEN length(regexp_extract(left(body, mid + 1), '(?s)^(.*) ', 1)) ELSE mid END AS cut FROM (SELECT *, length(body) // 2 AS mid, instr(substr(body, length(body) // 2 + 1), chr(10)) AS nl FROM t WHERE depth < 6 AND strlen(body) // 4 + 1 > {_LIMIT})), (VALUES ('0'), ('1')) s(side)),
leaves AS (SELECT * FROM t WHERE NOT (depth < 6 AND strlen(body) // 4 + 1 > {_LIMIT})), {", ".join(up)}
SELECT doc_id AS id, body AS summary, CAST(parts AS BIGINT) AS parts, CAST(depth AS BIGINT) AS depth, false AS verbatim FROM u0"""


@query("win_reduce_tree", _reduce_sql())
def win_reduce_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of whole texts by a model with little room: most are split, and not all joined summaries fit."""
    notes = table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), c("text").alias("notes"))
    return reduction.reduce_long(notes, models.HeadOfPrompt(), context=reduction.ROOM + _LIMIT)
