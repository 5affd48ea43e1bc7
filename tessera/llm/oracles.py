"""DuckDB SQL for the training-data queries that SQL can express, by plain definitions."""

from __future__ import annotations

from tessera.llm.near_dedup import SHINGLE

_SPACE = r"[\x20\x09-\x0D]"

LINE_DEDUP = rf"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS ls FROM documents),
w AS (SELECT doc_id, p, array_to_string(ls[p + 1:p + 3], chr(10)) AS win FROM (SELECT doc_id, ls, unnest(range(greatest(len(ls) - 2, 1))) AS p FROM l WHERE text IS NOT NULL)),
f AS (SELECT win, min((doc_id, p)) AS first FROM w WHERE regexp_matches(win, '[^\x20\x09-\x0D]') GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS p FROM w JOIN f USING (win) WHERE (doc_id, p) <> first),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
k AS (SELECT l.doc_id, text, raw, ps, CASE WHEN ps IS NULL THEN raw ELSE list_transform(list_filter(range(len(raw)), lambda i: NOT list_contains(ps, i)), lambda i: raw[i + 1]) END AS kept FROM l LEFT JOIN g USING (doc_id))
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END AS text, CAST(coalesce(len(raw), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(raw) - len(kept), 0) AS BIGINT) AS n_removed FROM k"""

_WORDS = r"list_filter(string_split_regex(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM (SELECT item_id, coalesce(text, '') AS t FROM benchmark)),
q AS (SELECT item, p AS place, least(13, len(w)) AS k, array_to_string(w[p + 1:p + least(13, len(w))], ' ') AS g FROM (SELECT item, w, unnest(range(len(w) - least(13, len(w)) + 1)) AS p FROM b WHERE len(w) > 0)),
h AS (SELECT doc_id, p, k, item, place FROM (SELECT doc_id, p, k, array_to_string(w[p + 1:p + k], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)) JOIN q USING (k, g)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM (SELECT DISTINCT doc_id, p, k FROM h)) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id),
s AS (SELECT doc_id, item, p, k, p - place AS line, p - row_number() OVER (PARTITION BY doc_id, item, k, p - place ORDER BY p) AS island FROM h),
r AS (SELECT doc_id, max(p + k) - min(p) AS longest, min(p) AS place FROM s GROUP BY doc_id, item, k, line, island),
m AS (SELECT doc_id, max(longest) AS longest, arg_min(place, (-longest, place)) AS longest_at FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(coalesce(longest_at, -1) AS BIGINT) AS longest_at
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN m USING (doc_id)"""

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {_WORDS} AS w FROM (SELECT doc_id, text, coalesce(text, '') AS t FROM documents)),
rep AS (SELECT text, min(doc_id) AS rep, any_value(w) AS w FROM d WHERE len(w) > 0 GROUP BY text),
s AS (SELECT rep, g, count(*) AS tf FROM (SELECT rep, array_to_string(w[p + 1:p + {SHINGLE}], ' ') AS g FROM (SELECT rep, w, unnest(range(greatest(len(w) - {SHINGLE - 1}, 1))) AS p FROM rep)) GROUP BY rep, g),
n AS (SELECT count(*) AS n FROM rep),
x AS (SELECT rep, g, df, tf * (1 + 0.2 * ln(n / df) / ln(n + 1)) AS weight FROM s JOIN (SELECT g, count(*) AS df FROM s GROUP BY g) USING (g), n),
t AS (SELECT rep, sum(weight) AS total FROM x GROUP BY rep),
c AS (SELECT a.rep AS a, b.rep AS b, sum(least(a.weight, b.weight)) AS common FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND a.df > 1 GROUP BY a.rep, b.rep),
e AS (SELECT a, b FROM c JOIN t ta ON ta.rep = a JOIN t tb ON tb.rep = b WHERE common >= 0.8 * (ta.total + tb.total - common)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(u, v) AS (SELECT a, a FROM both_ways UNION SELECT r.u, o.b FROM reach r JOIN both_ways o ON o.a = r.v),
comp AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(comp.m, rep.rep, d.doc_id) AS class_id FROM d LEFT JOIN rep ON rep.text = d.text AND len(d.w) > 0 LEFT JOIN comp ON comp.u = rep.rep"""

NGRAM_JOIN = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[p + 1:p + 3], ' ') AS g FROM (SELECT r, w, unnest(range(greatest(len(w) - 2, 1))) AS p FROM d WHERE len(w) > 0)),
t AS (SELECT r, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS key FROM s GROUP BY r),
rep AS (SELECT key, min(r) AS rep, any_value(n) AS n FROM t GROUP BY key),
x AS (SELECT rep, n, g FROM rep JOIN s ON s.r = rep),
c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS common, any_value(a.n) AS m, any_value(b.n) AS n FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY a.rep, b.rep),
e AS (SELECT a, b FROM c WHERE 100 * common >= 90 * (m + n - common)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(u, v) AS (SELECT a, a FROM both_ways UNION SELECT q.u, o.b FROM reach q JOIN both_ways o ON o.a = q.v),
comp AS (SELECT u, min(v) AS m FROM reach GROUP BY u),
o AS (SELECT t.r, t.n, coalesce(m, rep) AS c FROM t JOIN rep USING (key) LEFT JOIN comp ON u = rep),
names AS (SELECT c, min(doc_id) AS component_id FROM o JOIN d USING (r) GROUP BY c)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id FROM d LEFT JOIN o USING (r) LEFT JOIN names USING (c)"""

_WORD = r"[^\x20\x09-\x0D]+"
CONVERSATION_TRIE = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, md5(coalesce(role, '') || chr(31) || coalesce(text, '')) AS f, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS w FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda a, b: list_reduce(list_concat([xor(a, b)], [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, k, f, w FROM c JOIN t ON t.conv_id = base AND k <= h UNION ALL SELECT c.conv_id, k + 1000000, f, w FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, md5(string_agg(f, '' ORDER BY k) OVER (PARTITION BY conv_id ORDER BY k)) AS node, w FROM r),
m AS (SELECT conv_id, depth, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS up, w FROM p UNION ALL SELECT conv_id, 0, 'root', NULL, 0 FROM c),
n AS (SELECT node, min(depth) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM m GROUP BY node),
k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT DISTINCT a.node, b.node AS under FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
s AS (SELECT below.node, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.node = below.under)) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM below JOIN n ON n.node = below.under GROUP BY below.node),
e AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM (SELECT conv_id, arg_max(node, depth) AS node FROM m GROUP BY conv_id) GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM n LEFT JOIN n u ON u.node = n.up LEFT JOIN k ON k.node = n.node JOIN s ON s.node = n.node LEFT JOIN e ON e.node = n.node"""

HARD_NEGATIVES = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS z
FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id, b.r, a.label = b.label AS same, CAST(list_inner_product(a.z, b.z) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT ar, anchor_id, r, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.ar, p.r ORDER BY score DESC, vec_id NULLS LAST) QUALIFY row_number() OVER w <= 5"""
