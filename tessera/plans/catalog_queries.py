"""Queries of inventories, memory, drafts, top rows and set operations: joins over small keyed tables."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import drafts, labels, names
from tessera.plans.scalar_queries import DAY, PATHS, STEM
from tessera.registry import query, table
from tessera.session import checkpointed, mounted, scratch
from tessera.sources import moves, outputs, retention, sinks, tree

c = F.col

# Model-like tables out of the star schema: part is the catalog, supplier-like buckets are files and the manifest.
CATALOG = "SELECT p_partkey AS id, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN 'stt' WHEN 1 THEN 'llm' ELSE 'vlm' END AS role, p_partkey * 10 AS bytes, p_size AS attention_min, 'proj' || CAST(p_partkey % 5 AS STRING) || '.bin' AS proj FROM part"
FILES = "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN p_partkey * 10 - 1 ELSE p_partkey * 10 END AS size, p_partkey % 3 <> 1 AS has_proj FROM part WHERE p_partkey % 5 <> 2"
MANIFEST = "SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'h0' ELSE 'h1' END AS sha, CASE WHEN p_partkey % 7 = 0 THEN 'D:/x' END AS path, p_partkey % 2 = 0 AS verified FROM part WHERE p_partkey % 3 <> 2"


def _view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The rows of a projection that both engines read alike."""
    return spark.sql(sql.format(**{n: "{" + n + "}" for n in names}), **{n: table(spark, sf_dir, n) for n in names})


def _part(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


def _both(sql: str, *names: str):
    """(Spark function, DuckDB text) for a projection of named tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = sql.replace("\\", "\\\\")
        for n in names:
            own = own.replace(f"FROM {n}", f"FROM {{{n}}}")
        return spark.sql(own, **{n: table(spark, sf_dir, n) for n in names})

    return run


@query("join_model_status", f"SELECT c.id, name, role, coalesce(size, 0) AS on_disk, coalesce(size > 0 AND size = bytes AND (role <> 'vlm' OR has_proj), false) AS complete, coalesce(verified, false) AS verified, concat_ws(',', role, CASE WHEN m.id IS NOT NULL THEN 'recorded' END, CASE WHEN path IS NOT NULL THEN 'linked' END) AS tags FROM ({CATALOG}) c LEFT JOIN ({FILES}) f ON f.id = c.id LEFT JOIN ({MANIFEST}) m ON m.id = c.id UNION ALL SELECT -id, 'link', 'llm', 0, false, verified, 'linked' FROM ({MANIFEST}) WHERE path IS NOT NULL")
def join_model_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog with what is on disk and recorded; entries with a projector need both files; linked files are rows of their own."""
    catalog, files, manifest = (_part(spark, sf_dir, s) for s in (CATALOG, FILES, MANIFEST))
    joined = catalog.join(files, "id", "left").join(manifest.withColumn("known", F.lit(True)), "id", "left")
    complete = (c("size") > 0) & (c("size") == c("bytes")) & ((c("role") != "vlm") | c("has_proj"))
    tags = F.concat_ws(",", "role", F.when(c("known"), "recorded"), F.when(c("path").isNotNull(), "linked"))
    rows = joined.select("id", "name", "role", F.coalesce("size", F.lit(0)).alias("on_disk"), F.coalesce(complete, F.lit(False)).alias("complete"), F.coalesce("verified", F.lit(False)).alias("verified"), tags.alias("tags"))
    links = manifest.where("path IS NOT NULL").select((-c("id")).alias("id"), F.lit("link").alias("name"), F.lit("llm").alias("role"), F.lit(0).cast("long").alias("on_disk"), F.lit(False).alias("complete"), "verified", F.lit("linked").alias("tags"))
    return rows.unionByName(links)


@query("join_mmproj_fallback", f"SELECT id, proj, provider FROM (SELECT a.id, a.proj, b.id AS provider, row_number() OVER (PARTITION BY a.id ORDER BY (b.id = a.id) DESC, b.id) AS r FROM ({CATALOG}) a JOIN (SELECT c.id, proj FROM ({CATALOG}) c JOIN ({FILES}) f ON f.id = c.id WHERE size = bytes AND has_proj) b ON a.proj = b.proj WHERE a.role = 'vlm') WHERE r = 1")
def join_mmproj_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projector of the entry itself, else that of any complete entry with the same file name (the least id)."""
    catalog = _part(spark, sf_dir, CATALOG)
    ready = catalog.join(_part(spark, sf_dir, FILES), "id").where("size = bytes AND has_proj")
    own = ready.select("id", c("id").alias("own"))
    other = ready.groupBy("proj").agg(F.min("id").alias("other"))
    return catalog.where("role = 'vlm'").join(own, "id", "left").join(other, "proj").select("id", "proj", F.coalesce("own", "other").alias("provider"))


_COMPLETE = f"(SELECT c.id, role, attention_min FROM ({CATALOG}) c JOIN ({FILES}) f ON f.id = c.id WHERE size = bytes)"


@query("topk_fallback_model", f"SELECT role, arg_max(c.id, bytes * 100000000 + c.id) AS id FROM ({CATALOG}) c JOIN ({FILES}) f ON f.id = c.id LEFT JOIN ({MANIFEST}) m ON m.id = c.id WHERE size = bytes AND size > 0 AND (c.id % 11 = 0 OR sha = 'h1') AND c.id <> 7 GROUP BY role")
def topk_fallback_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last usable entry of each role in catalog order, which ascends by size; entries without a pinned hash (here: every eleventh) need none in the manifest."""
    ready = _part(spark, sf_dir, CATALOG).join(_part(spark, sf_dir, FILES), "id").where("size = bytes AND size > 0 AND id <> 7")
    judged = ready.join(_part(spark, sf_dir, MANIFEST).select("id", "sha"), "id", "left").where((c("id") % 11 == 0) | (c("sha") == "h1"))
    return judged.groupBy("role").agg(F.max_by("id", F.struct("bytes", "id")).alias("id"))


@query("topk_vlm_for_attention", f"SELECT a.attention, coalesce((SELECT arg_min(id, id) FROM {_COMPLETE} v WHERE role = 'vlm' AND attention_min <= a.attention AND attention_min = (SELECT max(attention_min) FROM {_COMPLETE} w WHERE role = 'vlm' AND attention_min <= a.attention)), (SELECT min(id) FROM {_COMPLETE} x WHERE role = 'vlm')) AS id FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS attention FROM part UNION SELECT 0) a")
def topk_vlm_for_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per attention the complete entry with the greatest minimum not above it (the first of equals), else the first complete one."""
    ready = _part(spark, sf_dir, CATALOG).join(_part(spark, sf_dir, FILES), "id").where("size = bytes AND role = 'vlm'")
    steps = ready.groupBy(c("attention_min").cast("long").alias("attention")).agg(F.min("id").alias("id"))
    asked = table(spark, sf_dir, "part").select(c("p_size").cast("long").alias("attention")).union(spark.range(1)).distinct()
    # an as-of look-up: steps and questions in one order, the last step at or before each question
    line = steps.select("attention", "id", F.lit(0).alias("kind")).unionByName(asked.select("attention", F.lit(None).cast("long").alias("id"), F.lit(1).alias("kind")))
    seen = line.withColumn("found", F.last("id", ignorenulls=True).over(Window.orderBy("attention", "kind"))).where("kind = 1")
    first = ready.agg(F.min("id").alias("first"))
    return seen.join(F.broadcast(first)).select("attention", F.coalesce("found", "first").alias("id"))


#: Shown paths are made different by a folder on top, so that memories and files belong to one document each.
_SHOWN = f"SELECT doc_id, concat('t', doc_id, '/', {PATHS}) AS p FROM documents"
_MEMORY = "SELECT doc_id, CASE WHEN quality = 1 THEN 'Day ' || CAST(doc_id % 50 AS STRING) ELSE '' END AS m_day, CASE WHEN toxic = 1 THEN '' ELSE 'Class ' || CAST(doc_id % 6 AS STRING) END AS m_class FROM labels"
_PARENT = r"regexp_extract(p, '([^/\\]+)[/\\][^/\\]*$', 1)"
_DATE = "CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS VARCHAR)"


@query("join_memory_lookup", f"""SELECT doc_id, coalesce(day, nullif(m_day, ''), CASE WHEN doc_id % 3 = 0 THEN {_DATE} WHEN doc_id % 4 = 0 THEN CAST(DATE '2023-06-15' AS VARCHAR) END, 'Day 1') AS day, coalesce(nullif(m_class, ''), nullif(parent, ''), 'General') AS class
FROM (SELECT doc_id, parent, {DAY} AS day FROM (SELECT doc_id, {_PARENT} AS parent, coalesce(nullif({STEM}, ''), p) AS p FROM ({_SHOWN}))) LEFT JOIN (SELECT doc_id, max(m_day) AS m_day, max(m_class) AS m_class FROM ({_MEMORY}) GROUP BY doc_id) m USING (doc_id)""")
def join_memory_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and classes of shown paths; a third of the stored files and a quarter of the shown ones are there, with dates of their own."""
    shown = table(spark, sf_dir, "documents").selectExpr("doc_id", _SHOWN.replace("\\", "\\\\").removeprefix("SELECT doc_id, ").removesuffix(" FROM documents"))
    folder = scratch(spark, "dated")
    top = mounted(folder)

    def dated(batches):
        for rows in batches:
            for name, day in zip(rows["name"], rows["day"], strict=True):
                path = os.path.join(top, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w"):
                    pass
                at = datetime.datetime.combine(day, datetime.time(12), datetime.UTC).timestamp()
                os.utime(path, (at, at))
            yield rows

    stored = shown.where("doc_id % 3 = 0").select(F.concat(F.lit("real/"), "doc_id").alias("name"), F.date_add(F.lit("2024-01-01"), (c("doc_id") % 300).cast("int")).alias("day"))
    seen = shown.where("doc_id % 4 = 0").select(F.concat(F.lit("shown/"), "p").alias("name"), F.lit("2023-06-15").cast("date").alias("day"))
    stored.union(seen).mapInPandas(dated, "name string, day date").count()
    dates = tree.tree(spark, folder, depth=1 << 20).select(F.regexp_replace("relative", "^shown/", "").alias("path"), F.to_date("modified").alias("date"))
    memory = shown.join(_both(_MEMORY, "labels")(spark, sf_dir), "doc_id").select(c("p").alias("shown"), c("m_day").alias("day"), c("m_class").alias("class"))
    items = shown.select(c("doc_id").alias("id"), c("p").alias("shown"), F.concat(F.lit("real/"), "doc_id").alias("real"))
    return labels.day_and_class(items, memory, dates).select(c("id").alias("doc_id"), "day", "class")


@query("join_order_event", "SELECT e.event_id, o.path FROM (SELECT event_id, value % 300 AS idx FROM (SELECT event_id, event_id * 7 AS value FROM events)) e JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, source || '/' || CAST(doc_id AS VARCHAR) AS path FROM documents) o ON o.idx = e.idx")
def join_order_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events name files by their place in the order of submission; places that do not exist go."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    # ids are submission order: ranks by range partitions, each numbered from what stands before it
    ordered = docs.select("doc_id", F.concat_ws("/", "source", c("doc_id").cast("string")).alias("path")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    # the number of a partition is read once and kept, so both uses below see the same one
    placed = checkpointed(ordered.select("path", "doc_id", F.spark_partition_id().alias("part")))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("doc_id"))
    order = placed.withColumn("own", own).join(F.broadcast(base), "part").select("path", (c("own") + c("base") - 1).alias("idx"))
    events = table(spark, sf_dir, "events").select("event_id", (c("event_id") * 7 % 300).alias("idx"))
    return events.join(order, "idx").select("event_id", "path")


@query("join_refresh_output", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT item_id FROM benchmark)")
def join_refresh_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").join(table(spark, sf_dir, "benchmark").select(c("item_id").alias("doc_id")), "doc_id", "left_anti")


@query("join_prune_links", f"SELECT id, path IS NOT NULL AND id NOT IN (SELECT id FROM ({FILES})) AS pruned FROM ({MANIFEST})")
def join_prune_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose file is gone; managed rows are never pruned."""
    manifest, files = _part(spark, sf_dir, MANIFEST), _part(spark, sf_dir, FILES).select("id", F.lit(True).alias("there"))
    return manifest.join(files, "id", "left").select("id", (c("path").isNotNull() & c("there").isNull()).alias("pruned"))


@query("join_sweep_orphans", "SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def join_sweep_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return drafts.join(table(spark, sf_dir, "labels").select(c("doc_id").alias("conv_id")), "conv_id", "left_anti")


@query("join_declared_peers", "SELECT d.doc_id, count(p.doc_id) - CASE WHEN bool_or(p.doc_id = d.doc_id) THEN 1 ELSE 0 END AS peers FROM documents d LEFT JOIN (SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) p USING (source) GROUP BY d.doc_id")
def join_declared_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other selected inputs (labelled documents) stand beside each one in its library."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    chosen = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    beside = chosen.groupBy("source").agg(F.count("*").alias("n"))
    own = chosen.select("doc_id", F.lit(1).alias("own"))
    return docs.join(beside, "source", "left").join(own, "doc_id", "left").select("doc_id", (F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("peers"))


@query("join_part_seed", "SELECT a.conv_id, a.turn, right(b.text, 400) AS seed FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE length(right(b.text, 400)) > 40")
def join_part_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part N takes the tail of part N - 1 of the same take."""
    parts = table(spark, sf_dir, "conversations")
    before = parts.select("conv_id", (c("turn") + 1).alias("turn"), F.right("text", F.lit(400)).alias("seed"))
    return parts.select("conv_id", "turn").join(before, ["conv_id", "turn"]).where(F.length("seed") > 40)


@query("join_research_sidecar", "SELECT d.doc_id, left(n.text, 12288) AS notes, left(q.text, 2000) AS declared FROM documents d LEFT JOIN benchmark n ON n.item_id = d.doc_id LEFT JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0) q ON q.conv_id = d.doc_id")
def join_research_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    notes = table(spark, sf_dir, "benchmark").select(c("item_id").alias("doc_id"), F.left("text", F.lit(12288)).alias("notes"))
    declared = table(spark, sf_dir, "conversations").where("turn = 0").select(c("conv_id").alias("doc_id"), F.left("text", F.lit(2000)).alias("declared"))
    return docs.join(notes, "doc_id", "left").join(declared, "doc_id", "left")


_NOTES = "SELECT doc_id, source, n_chars * 1000 + doc_id AS wtime, '# T' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '## Summary' || chr(10) END || text AS md FROM documents"


@query("agg_folder_context", f"SELECT source, left(string_agg(chr(10) || '[' || CAST(doc_id AS VARCHAR) || ']' || chr(10) || substr(left(md, 4000), greatest(instr(left(md, 4000), '## Summary'), 1), 800) || chr(10), '' ORDER BY r), 9000) AS context FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY wtime DESC) AS r FROM ({_NOTES})) WHERE r <= 20 GROUP BY source")
def agg_folder_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _both(_NOTES, "documents")(spark, sf_dir)
    top = notes.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("wtime")))).where("r <= 20")
    one = F.concat(F.lit("\n["), c("doc_id").cast("string"), F.lit("]\n"), T.section_head(F.left("md", F.lit(4000))), F.lit("\n"))
    return top.groupBy("source").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", one.alias("t")))), lambda x: x["t"]), ""), F.lit(9000)).alias("context"))


@query("topk_recent_notes", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def topk_recent_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty, with text length as the time of writing."""
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("agg_coverage", "SELECT source, sum(a) * 100 // sum(b) AS achieved_pct, count(*) AS notes, 'Coverage: ' || CAST(sum(a) * 100 // sum(b) AS VARCHAR) || '% of ' || CAST(sum(b) AS VARCHAR) || ' words' AS line FROM (SELECT source, CAST(len(list_filter(string_split_regex(left(text, n_chars // 3), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS BIGINT) AS a, CAST(len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS BIGINT) + doc_id % 2 AS b FROM documents) GROUP BY source")
def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of summary words; captions add to the words of the source."""
    docs = table(spark, sf_dir, "documents").select("source", T.word_count(F.left("text", F.floor(c("n_chars") / 3).cast("int"))).alias("a"), (T.word_count(c("text")) + c("doc_id") % 2).alias("b"))
    sums = docs.groupBy("source").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("notes"))
    pct = F.floor(c("a") * 100 / c("b")).cast("long")
    return sums.select("source", pct.alias("achieved_pct"), "notes", F.concat(F.lit("Coverage: "), pct.cast("string"), F.lit("% of "), c("b").cast("string"), F.lit(" words")).alias("line"))


@query("set_union_declared", "SELECT doc_id, min(pri) AS pri FROM (SELECT doc_id, 0 AS pri FROM labels UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'de') GROUP BY doc_id")
def set_union_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("pri"))
    context = table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id", F.lit(1).alias("pri"))
    return declared.unionByName(context).groupBy("doc_id").agg(F.min("pri").alias("pri"))


@query("set_download_need", f"SELECT id FROM ({CATALOG}) WHERE role IN ('stt', 'llm') EXCEPT SELECT c.id FROM ({CATALOG}) c JOIN ({FILES}) f ON f.id = c.id WHERE size = bytes")
def set_download_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _part(spark, sf_dir, CATALOG)
    complete = catalog.join(_part(spark, sf_dir, FILES), "id").where("size = bytes").select("id")
    return catalog.where("role IN ('stt', 'llm')").select("id").join(complete, "id", "left_anti")


@query("st_active_pair", f"SELECT tier, CASE WHEN bool_and(done) AND tier <> 3 THEN 'activate' ELSE 'keep' END AS action FROM (SELECT c.id // 5 AS tier, coalesce(size = bytes, false) AS done FROM ({CATALOG}) c LEFT JOIN ({FILES}) f ON f.id = c.id ) GROUP BY tier")
def st_active_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tier all of whose files are complete becomes the default, unless a job runs (tier 3 is busy)."""
    joined = _part(spark, sf_dir, CATALOG).join(_part(spark, sf_dir, FILES), "id", "left")
    return joined.groupBy(F.floor(c("id") / 5).alias("tier")).agg(F.when(F.bool_and(F.coalesce(c("size") == c("bytes"), F.lit(False))) & (F.first(F.floor(c("id") / 5)) != 3), "activate").otherwise("keep").alias("action"))


_VERIFY = "SELECT c.id, bytes, size, sha, path, CASE WHEN c.id % 11 = 0 THEN NULL ELSE 'h1' END AS pinned FROM catalog c"


@query("fn_verify_decision", f"SELECT c.id, CASE WHEN size IS NULL OR size = 0 THEN 'missing' WHEN size <> bytes THEN 'quarantined' WHEN c.id % 11 = 0 THEN 'ok unpinned' WHEN sha = 'h1' AND verified THEN 'ok' WHEN coalesce(sha, 'h1') = 'h1' THEN 'ok hashed' ELSE 'quarantined' END AS verdict FROM ({CATALOG}) c LEFT JOIN ({FILES}) f ON f.id = c.id LEFT JOIN ({MANIFEST}) m ON m.id = c.id")
def fn_verify_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size first, then the recorded hash (the fast path), then hashing; nothing is moved."""
    joined = _part(spark, sf_dir, CATALOG).join(_part(spark, sf_dir, FILES), "id", "left").join(_part(spark, sf_dir, MANIFEST), "id", "left")
    verdict = (
        F.when(c("size").isNull() | (c("size") == 0), "missing").when(c("size") != c("bytes"), "quarantined").when(c("id") % 11 == 0, "ok unpinned")
        .when((c("sha") == "h1") & c("verified"), "ok").when(F.coalesce("sha", F.lit("h1")) == "h1", "ok hashed").otherwise("quarantined")
    )
    return joined.select("id", verdict.alias("verdict"))


@query("fn_download_decision", f"SELECT c.id, CASE WHEN size IS NULL THEN 'fetch' WHEN size <> bytes THEN 'resume' WHEN coalesce(sha, 'h1') = 'h1' THEN 'skip' WHEN c.id % 11 = 0 THEN 'delete' ELSE 'quarantine' END AS action FROM ({CATALOG}) c LEFT JOIN ({FILES}) f ON f.id = c.id LEFT JOIN ({MANIFEST}) m ON m.id = c.id")
def fn_download_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _part(spark, sf_dir, CATALOG).join(_part(spark, sf_dir, FILES), "id", "left").join(_part(spark, sf_dir, MANIFEST), "id", "left")
    action = F.when(c("size").isNull(), "fetch").when(c("size") != c("bytes"), "resume").when(F.coalesce("sha", F.lit("h1")) == "h1", "skip").when(c("id") % 11 == 0, "delete").otherwise("quarantine")
    return joined.select("id", action.alias("action"))


@query("fn_boot_findings", f"SELECT role, severity, message FROM (SELECT role, 'error' AS severity, 'fallback to ' || CAST(max(CASE WHEN size = bytes THEN c.id END) AS VARCHAR) AS message FROM ({CATALOG}) c LEFT JOIN ({FILES}) f ON f.id = c.id GROUP BY role HAVING min(CASE WHEN size = bytes THEN 1 ELSE 0 END) = 0 UNION ALL SELECT role, 'advisory', CAST(count(*) AS VARCHAR) || ' unverified' FROM ({CATALOG}) c JOIN ({MANIFEST}) m ON m.id = c.id WHERE NOT verified GROUP BY role)")
def fn_boot_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _part(spark, sf_dir, CATALOG)
    joined = catalog.join(_part(spark, sf_dir, FILES), "id", "left")
    ready = F.coalesce(c("size") == c("bytes"), F.lit(False))
    errors = joined.groupBy("role").agg(F.max(F.when(ready, c("id"))).alias("best"), F.bool_and(ready).alias("all")).where("NOT all").select("role", F.lit("error").alias("severity"), F.concat(F.lit("fallback to "), c("best").cast("string")).alias("message"))
    advice = catalog.join(_part(spark, sf_dir, MANIFEST).where("NOT verified"), "id").groupBy("role").agg(F.count("*").alias("n")).select("role", F.lit("advisory").alias("severity"), F.concat(c("n").cast("string"), F.lit(" unverified")).alias("message"))
    return errors.unionByName(advice)


@query("str_validate_gate", f"SELECT job, CASE WHEN NOT stt THEN 'abort: stt' WHEN NOT llm THEN 'abort: llm' WHEN NOT vlm THEN 'run without captions' ELSE 'run' END AS decision FROM (SELECT c.id // 3 AS job, bool_or(role = 'stt' AND coalesce(size = bytes, false)) AS stt, bool_or(role = 'llm' AND coalesce(size = bytes, false)) AS llm, bool_or(role = 'vlm' AND coalesce(size = bytes, false)) AS vlm FROM ({CATALOG}) c LEFT JOIN ({FILES}) f ON f.id = c.id GROUP BY ALL)")
def str_validate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech and language models are needed, a vision model only degrades the run."""
    joined = _part(spark, sf_dir, CATALOG).join(_part(spark, sf_dir, FILES), "id", "left")
    ready = F.coalesce(c("size") == c("bytes"), F.lit(False))
    jobs = joined.groupBy(F.floor(c("id") / 3).alias("job")).agg(*[F.bool_or((c("role") == r) & ready).alias(r) for r in ("stt", "llm", "vlm")])
    return jobs.select("job", F.when(~c("stt"), "abort: stt").when(~c("llm"), "abort: llm").when(~c("vlm"), "run without captions").otherwise("run").alias("decision"))


#: Manifests by document: four or five names deep, too few, too many, or broken; a fifth have no blob.
_MANIFEST = "CASE doc_id % 7 WHEN 4 THEN concat('short/m', doc_id) WHEN 5 THEN concat('h/1/2/3/4/5/6/7/8/m', doc_id, '/t') WHEN 3 THEN concat('h/deep/', source, '/m', doc_id, '/', lang) ELSE concat('host', doc_id % 3, '/', CASE WHEN doc_id % 2 = 0 THEN 'library' ELSE source END, '/m', doc_id, '/', lang) END"
_LAYER = "application/vnd.image.model"


@query("src_registry_scan", f"""WITH m AS (SELECT *, {_MANIFEST} AS p, sha256(CAST(doc_id AS VARCHAR)) AS digest FROM documents), f AS (SELECT * FROM m WHERE len(string_split(p, '/')) <= 9 ORDER BY p LIMIT 4096)
SELECT CASE WHEN ns = 'library' THEN '' ELSE ns || '/' END || 'm' || doc_id || ':' || lang AS name, digest, n_chars AS bytes FROM (SELECT *, string_split(p, '/')[-3] AS ns FROM f WHERE len(string_split(p, '/')) >= 4) WHERE doc_id % 7 <> 6 AND doc_id % 5 <> 4""")
def src_registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store is written, with links that lead in circles, and scanned."""
    root = scratch(spark, "registry")
    digest = F.sha2(c("doc_id").cast("string").cast("binary"), 256)
    layers = F.format_string('{"layers":[{"mediaType":"license","digest":"sha256:0","size":1},{"mediaType":"%s","digest":"sha256:","size":3},{"mediaType":"%s","digest":"sha256:%s","size":%d}]}', F.lit(_LAYER), F.lit(_LAYER), digest, c("n_chars"))
    docs = table(spark, sf_dir, "documents")
    manifests = docs.select(F.concat(F.lit("manifests/"), F.expr(_MANIFEST)).alias("name"), F.when(c("doc_id") % 7 == 6, F.lit("not json")).otherwise(layers).alias("body"))
    blobs = docs.where("doc_id % 5 <> 4").select(F.concat(F.lit("blobs/sha256-"), digest).alias("name"), F.lit("weights").alias("body"))
    sinks.write_files(manifests.union(blobs), root, "name", "body")
    top = mounted(root)
    os.symlink(f"{top}/manifests", f"{top}/manifests/circle")
    os.symlink(f"{top}/blobs", f"{top}/manifests/host0/blobs")
    return tree.registry(spark, root, _LAYER)


#: File extensions by kind, in the order of the tests.
_VIDEO = (
    "mp4", "m4v", "mov", "qt", "mkv", "mk3d", "webm", "avi", "divx", "wmv", "asf", "flv", "f4v", "mpg", "mpeg", "mpe", "mpv", "m2v", "ts", "m2ts",
    "m2t", "mts", "vob", "3gp", "3g2", "ogv", "rm", "rmvb", "nsv", "mxf",
)
_AUDIO = (
    "wav", "flac", "aiff", "aif", "aifc", "au", "snd", "avr", "caf", "w64", "rf64", "voc", "wma", "alac", "wv", "ape", "mpc", "mpp", "mp+", "tak",
    "tta", "shn", "dsf", "dss", "sln", "gsm", "mp3", "mp2", "mp1", "mpa", "m1a", "m2a", "aac", "m4a", "m4b", "m4r", "ogg", "oga", "ogv", "ogx",
    "opus", "spx", "amr", "awb", "ac3", "eac3", "ec3", "dts", "dtshd", "mlp", "thd", "aa", "aax", "mod", "xm", "it", "s3m", "mtm", "med", "okt",
    "669", "far", "stm", "ult", "ay", "gbs", "gym", "hes", "kss", "nsf", "nsfe", "sap", "spc", "vgm", "vgz", "mp4", "m4v", "mov", "qt", "3gp", "3g2",
    "3gp2", "3gpp", "isma", "ismv", "mkv", "mka", "mk3d", "webm", "weba", "webp", "avi", "divx", "wmv", "asf", "flv", "f4v", "f4a", "f4b", "mpg",
    "mpeg", "mpe", "mpv", "m2v", "ts", "m2ts", "m2t", "mts", "vob", "evo", "vro", "mxf", "gxf", "rm", "rmvb", "ra", "nsv", "ivf", "nut", "wtv",
    "dvr-ms", "smk", "roq", "bink", "binka", "brstm", "aup3", "aup4", "aup3unsaved",
)
_DOC = (
    "txt", "md", "markdown", "log", "csv", "tsv", "json", "xml", "yaml", "yml", "toml", "ini", "srt", "vtt", "lrc", "html", "htm", "xhtml", "mhtml",
    "rtf", "docx", "pptx", "xlsx", "xlsm", "doc", "ppt", "xls", "odt", "ods", "odp", "epub", "pdf",
)
_EXT = r"lower(regexp_extract(regexp_extract(p, '([^/\\]*)$', 1), '.\.([^.]*)$', 1))"
_GATE = "SELECT doc_id AS seq, CASE WHEN doc_id % 13 = 5 THEN 'old/project.aup' ELSE " + PATHS + " END AS p FROM documents"


def _in(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query("src_intake_gate", f"SELECT p AS path, min(seq) AS seq, any_value(CASE WHEN {_EXT} = 'aup' THEN 'rejected' WHEN {_EXT} IN ({_in(_VIDEO)}) THEN 'Video' WHEN {_EXT} IN ({_in(_AUDIO)}) THEN 'Audio' WHEN {_EXT} IN ({_in(_DOC)}) THEN 'Doc' ELSE 'warning' END) AS kind FROM ({_GATE}) GROUP BY p")
def src_intake_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths once each, with their kind: a video extension is tested before audio, then documents; other ones are a warning."""
    rows = _both(_GATE, "documents")(spark, sf_dir).groupBy(c("p").alias("path")).agg(F.min("seq").alias("seq"))
    ext = T.extension(c("path"))
    kind = F.when(ext == "aup", "rejected").when(ext.isin(*_VIDEO), "Video").when(ext.isin(*_AUDIO), "Audio").when(ext.isin(*_DOC), "Doc").otherwise("warning")
    return rows.select("path", "seq", kind.alias("kind"))


@query("src_restore_staged", "SELECT s.doc_id, l.doc_id IS NOT NULL AS found FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 256) s LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def src_restore_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(256)
    files = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("there")).distinct()
    return saved.join(files, "doc_id", "left").select("doc_id", F.coalesce("there", F.lit(False)).alias("found"))


@query("sink_note_md", f"SELECT doc_id, '# ' || source || chr(10) || chr(10) || '## Summary' || chr(10) || CASE WHEN doc_id % 6 = 0 THEN '{T.SKIP_MARK}' ELSE left(text, 100) END || chr(10) || chr(10) || '## Raw Transcript' || chr(10) || text || chr(10) || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '## Audio' || chr(10) || CAST(doc_id AS VARCHAR) || '.wav' || chr(10) ELSE '' END AS md FROM documents")
def sink_note_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = F.when(c("doc_id") % 6 == 0, T.SKIP_MARK).otherwise(F.left("text", F.lit(100)))
    audio = F.when(c("doc_id") % 4 == 0, F.concat(F.lit("\n## Audio\n"), c("doc_id").cast("string"), F.lit(".wav\n"))).otherwise("")
    notes = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), c("source"), F.lit("\n\n## Summary\n"), summary, F.lit("\n\n## Raw Transcript\n"), c("text"), F.lit("\n"), audio).alias("md"))
    return sinks.through_files(spark, notes, "doc_id", "md", ".md")


@query("sink_sidecar_json", """SELECT doc_id, '{"title":"' || source || '","day":"Day ' || CAST(doc_id % 9 AS VARCHAR) || '","coverage":{"chunks":' || CAST(n_chars // 400 AS VARCHAR) || ',"relaxed":' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || '}}' AS json FROM documents""")
def sink_sidecar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.through_files(spark, _sidecars(spark, sf_dir), "doc_id", "json", ".json")


def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    coverage = F.struct(F.floor(c("n_chars") / 400).alias("chunks"), (c("doc_id") % 2 == 0).alias("relaxed"))
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(c("source").alias("title"), F.concat(F.lit("Day "), (c("doc_id") % 9).cast("string")).alias("day"), coverage.alias("coverage"))).alias("json"))


#: Some titles read like another title's second to fourth name, and some names exist.
_TITLE = "concat(source, ' ', lang, CASE WHEN doc_id % 11 = 3 THEN concat(' - ', 2 + doc_id % 3) ELSE '' END)"
_EXISTING = "SELECT DISTINCT concat(source, ' ', lang, CASE WHEN doc_id % 2 = 0 THEN ' - 3' ELSE '' END) AS name, concat(source, ' ', lang) AS root FROM documents WHERE lang = 'de'"


@query("sink_uniquify", f"""WITH RECURSIVE d AS (SELECT doc_id, {_TITLE} AS title, concat(source, ' ', lang) AS root, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents),
f(root, n, names, doc_id, name) AS (SELECT root, CAST(0 AS BIGINT), coalesce((SELECT list(name) FROM ({_EXISTING}) e WHERE e.root = d.root), CAST([] AS VARCHAR[])), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM d WHERE n = 1
UNION ALL SELECT root, n, list_append(names, name), doc_id, name FROM (SELECT f.root, d.n, names, d.doc_id, CASE WHEN list_contains(names, title) THEN title || ' - ' || list_filter(range(2, len(names) + 3), lambda k: NOT list_contains(names, title || ' - ' || k))[1] ELSE title END AS name FROM f JOIN d ON d.root = f.root AND d.n = f.n + 1))
SELECT doc_id, name FROM f WHERE n > 0""")
def sink_uniquify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of outputs: the second of a title gets ' - 2', or the next number that is free."""
    docs = table(spark, sf_dir, "documents")
    titled = docs.select(c("doc_id").alias("id"), F.expr(_TITLE).alias("title"), c("doc_id").alias("order"))
    existing = docs.where("lang = 'de'").select(F.expr("concat(source, ' ', lang, CASE WHEN doc_id % 2 = 0 THEN ' - 3' ELSE '' END)").alias("name"))
    return names.unique_names(titled, existing).select(c("id").alias("doc_id"), "name")


@query("sink_upsert_memory", "SELECT path, max_by(day, seq) AS day FROM (SELECT doc_id % 70 AS path, quality AS day, doc_id AS seq FROM labels UNION ALL SELECT doc_id % 90, 7, doc_id + 1000000 FROM documents WHERE lang = 'fr') GROUP BY path")
def sink_upsert_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of writes into a store; the last write of each path wins."""
    old = table(spark, sf_dir, "labels").select((c("doc_id") % 70).alias("path"), c("quality").alias("day"), c("doc_id").alias("seq"))
    new = table(spark, sf_dir, "documents").where("lang = 'fr'").select((c("doc_id") % 90).alias("path"), F.lit(7).alias("day"), (c("doc_id") + 1_000_000).alias("seq"))
    store = scratch(spark, "memory")
    sinks.upsert(store, old, "path", c("seq"))
    return sinks.upsert(store, new, "path", c("seq")).select("path", "day")


#: Sources of documents: names with all kinds of extensions, settings, and Spanish ones as videos.
_SOURCES = "SELECT doc_id, concat('f', doc_id, CASE doc_id % 5 WHEN 0 THEN '.MP3' WHEN 1 THEN '.flac' WHEN 2 THEN '' WHEN 3 THEN '.recording' ELSE '.wav' END) AS source, concat('T', doc_id) AS title, CASE doc_id % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'keep' WHEN 2 THEN 'archive' ELSE CASE WHEN doc_id % 8 = 3 THEN 'archive' ELSE 'other' END END AS setting, lang = 'es' AS video FROM documents"


@query("sink_retention", f"""SELECT doc_id, action, CASE WHEN action = 'archive' THEN title || '.src' || CASE doc_id % 5 WHEN 0 THEN '.mp3' WHEN 1 THEN '.flac' ELSE '.wav' END || CASE WHEN doc_id % 3 = 0 THEN ' (2)' ELSE '' END END AS archived, action <> 'delete' AS source_there, CASE WHEN action = 'archive' THEN sha256(text) END AS archived_sha256
FROM (SELECT *, CASE WHEN video OR setting NOT IN ('delete', 'archive') THEN 'keep' ELSE setting END AS action FROM ({_SOURCES})) JOIN documents USING (doc_id)""")
def sink_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are written, then kept, deleted or archived by their setting, twice; some names in the archive are taken."""
    old, new = scratch(spark, "sources"), scratch(spark, "outputs")
    rows = checkpointed(_both(_SOURCES, "documents")(spark, sf_dir))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    sinks.write_files(rows.join(texts, "doc_id").select(c("source").alias("name"), "body"), old, "name", "body")
    ext = F.when(c("doc_id") % 5 == 0, ".mp3").when(c("doc_id") % 5 == 1, ".flac").otherwise(".wav")
    taken = rows.where("doc_id % 3 = 0").select(F.concat("title", F.lit(".src"), ext).alias("name"), F.lit("another source").alias("body"))
    sinks.write_files(taken, new, "name", "body")
    done = checkpointed(retention.apply(rows, old, new))
    checkpointed(retention.apply(rows, old, new))
    there = tree.tree(spark, old, depth=0).select(c("relative").alias("source"), F.lit(True).alias("there"))
    files = tree.tree(spark, new, depth=0, content=True).select(c("relative").alias("archived"), F.sha2("content", 256).alias("archived_sha256"))
    found = rows.select("doc_id", "source").join(done, "source").join(there, "source", "left").join(files, "archived", "left")
    return found.select("doc_id", "action", "archived", F.coalesce("there", F.lit(False)).alias("source_there"), "archived_sha256")


@query("sink_atomic_json")
def sink_atomic_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON rows through Spark's commit protocol and back."""
    path = scratch(spark, "json")
    _sidecars(spark, sf_dir).write.mode("overwrite").json(path)
    return spark.read.schema("doc_id long, json string").json(path)


#: Turns as operations: a text whose length divides by seven deletes, users open, others save.
_OPS = "SELECT conv_id AS id, turn AS seq, CASE WHEN length(text) % 7 = 0 THEN 'delete' WHEN role = 'user' THEN 'open' ELSE 'save' END AS op, text AS body FROM conversations"


@query("st_draft_lifecycle", f"""WITH o AS (SELECT *, coalesce(max(CASE WHEN op = 'open' THEN seq END) OVER w, -1) > coalesce(max(CASE WHEN op = 'delete' THEN seq END) OVER w, -1) AS there FROM ({_OPS}) WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT id, coalesce(max(CASE WHEN op = 'delete' THEN seq END), -1) AS deleted, count(*) FILTER (WHERE op = 'save' AND NOT there) AS lost FROM o GROUP BY id)
SELECT id, max_by(body, seq) AS body, max(seq) AS updated_at, count(*) FILTER (WHERE op = 'save') AS saves, any_value(lost) AS lost FROM o JOIN e USING (id) WHERE seq > deleted AND ((op = 'open' AND NOT there) OR (op = 'save' AND there)) GROUP BY id""")
def st_draft_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts after all that was done to them."""
    return drafts.fold(_both(_OPS, "conversations")(spark, sf_dir))


#: A draft for each conversation: what users said, what was answered, and a note of both numbers.
_DRAFTS = "SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN text END, chr(10) ORDER BY turn), '') AS raw, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) ORDER BY turn), '') AS summary, count(*) AS n FROM conversations GROUP BY conv_id"


@query("st_draft_move", f"""SELECT 'd' || conv_id AS stem, result, CASE WHEN result = 'moved' THEN 'new' ELSE 'old' END AS place, sha256(raw) AS raw_sha256, sha256(summary) AS summary_sha256, CAST(CASE WHEN result = 'moved' THEN 3 ELSE 0 END AS INTEGER) AS files
FROM (SELECT *, CASE WHEN conv_id IN (SELECT item_id FROM benchmark WHERE item_id % 3 = 0) THEN 'taken' ELSE 'moved' END AS result FROM ({_DRAFTS}))""")
def st_draft_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts are written, moved twice, and read from where they are; some places are taken by others."""
    old, new = scratch(spark, "drafts-old"), scratch(spark, "drafts-new")
    said = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    drafts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said("user").alias("raw"), said("assistant").alias("summary"), F.count("*").alias("n"))
    drafts = checkpointed(drafts.select(F.concat(F.lit("d"), "conv_id").alias("stem"), "conv_id", "raw", "summary", F.to_json(F.struct("conv_id", "n")).alias("meta")))
    each = lambda name, body: drafts.select(F.concat("stem", F.lit(f"/{name}")).alias("name"), c(body).alias("body"))
    sinks.write_files(each("raw.md", "raw").union(each("summary.md", "summary")).union(each("meta.json", "meta")), old, "name", "body")
    taken = table(spark, sf_dir, "benchmark").where("item_id % 3 = 0").select(c("item_id").alias("conv_id")).distinct()
    sinks.write_files(drafts.join(taken, "conv_id", "left_semi").select(F.concat("stem", F.lit("/raw.md")).alias("name"), F.lit("another draft").alias("body")), new, "name", "body")
    checkpointed(moves.move_all(drafts, old, new))
    told = checkpointed(moves.move_all(drafts, old, new))

    def there(folder: str, place: str) -> DataFrame:
        files = tree.tree(spark, folder, content=True).select(F.split("relative", "/").alias("p"), "content").where("size(p) = 2")
        # digests are dealt, so that contents are not sorted for the groups
        digests = files.select(c("p")[0].alias("stem"), c("p")[1].alias("file"), F.sha2("content", 256).alias("digest")).repartition("stem")
        digest = lambda name: F.max(F.when(c("file") == name, c("digest")))
        return digests.groupBy("stem").agg(digest("raw.md").alias("raw_sha256"), digest("summary.md").alias("summary_sha256")).withColumn("place", F.lit(place))

    found = there(old, "old").union(there(new, "new"))
    here = (c("result") == "moved") == (c("place") == "new")
    return told.join(found, "stem").where(here).select("stem", "result", "place", "raw_sha256", "summary_sha256", "files")


#: Toxic documents are dismissed, good ones renamed to twice their number, bad ones deleted.
_OUTPUT_OPS = "SELECT doc_id AS id, concat('note', doc_id) AS stem, CASE WHEN toxic = 1 THEN 'dismiss' WHEN quality = 1 THEN 'rename' ELSE 'delete' END AS op, concat(' note', doc_id * 2, '.md') AS next FROM (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id)"


@query("st_output_ops", f"""WITH o AS (SELECT *, op = 'rename' AND id * 2 IN (SELECT doc_id FROM documents) AS taken FROM ({_OUTPUT_OPS}) WHERE id IN (SELECT doc_id FROM documents))
SELECT 'note' || CASE WHEN op = 'rename' AND NOT taken THEN doc_id * 2 ELSE doc_id END AS stem, sha256(coalesce(text, '')) AS sha256, CAST(1 + CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS beside, coalesce(op <> 'dismiss', true) AS shown, coalesce(taken, false) AS conflict
FROM documents LEFT JOIN o ON id = doc_id WHERE op IS NULL OR op <> 'delete'""")
def st_output_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and the files beside them are written, renamed, dismissed and deleted by labels, and listed."""
    folder = scratch(spark, "outputs")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    shelves = max(1024, 16 * spark.sparkContext.defaultParallelism)
    stem = outputs.shelf(F.concat(F.lit("note"), c("doc_id").cast("string")), shelves)
    each = lambda rows, ending, body: rows.select(F.concat(stem, F.lit(ending)).alias("name"), body.alias("body"))
    files = each(docs, ".md", c("body")).union(each(docs, ".md.json", F.lit("{}"))).union(each(docs.where("doc_id % 2 = 1"), ".md.diff.json", F.lit("[]"))).union(each(docs.where("doc_id % 3 = 0"), ".srt", F.lit("1")))
    sinks.write_files(files, folder, "name", "body")
    done = checkpointed(outputs.apply(_both(_OUTPUT_OPS, "labels")(spark, sf_dir), folder, shelves))
    found = outputs.listed(spark, folder, shelves, content=True).select(F.regexp_extract("name", r"^([^.]+)(.*)$", 1).alias("stem"), F.regexp_extract("name", r"^([^.]+)(.*)$", 2).alias("ending"), "content")
    # digests are dealt, so that contents are not sorted for the groups
    digests = found.select("stem", "ending", F.sha2("content", 256).alias("digest")).repartition("stem")
    notes = digests.groupBy("stem").agg(F.max(F.when(c("ending") == ".md", c("digest"))).alias("sha256"), (F.count("*") - 1).alias("beside"))
    hidden = done.where("op = 'dismiss' AND result = 'accepted'").select("stem", F.lit(False).alias("shown"))
    refused = done.where("result = 'taken'").select("stem", F.lit(True).alias("conflict"))
    return notes.join(hidden, "stem", "left").join(refused, "stem", "left").select("stem", "sha256", "beside", F.coalesce("shown", F.lit(True)).alias("shown"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


@query("fn_take_name", "SELECT doc_id, 'Rec ' || source || CASE WHEN n > 1 THEN ' (Part ' || CAST(n AS VARCHAR) || ')' ELSE '' END || '.wav' AS name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)")
def fn_take_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(1).alias("one"))
    n = c("upto")
    return names.running(takes, "source", "doc_id", "one").select("doc_id", F.concat(F.lit("Rec "), c("source"), F.when(n > 1, F.concat(F.lit(" (Part "), n.cast("string"), F.lit(")"))).otherwise(""), F.lit(".wav")).alias("name"))


@query("fn_sums_check", "SELECT d.doc_id, coalesce(s.digest = sha256(d.text), false) AS good FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'bad' ELSE sha256(text) END AS digest FROM documents WHERE doc_id % 2 = 0) s USING (doc_id)")
def fn_sums_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests against the lines of a sums document, matched by leaf name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(c("text").cast("binary"), 256).alias("own"))
    lines = docs.where("doc_id % 2 = 0").select(F.concat(F.when(c("doc_id") % 3 == 0, "bad").otherwise(c("own")), F.lit("  dist/f"), c("doc_id").cast("string")).alias("line"))
    sums = lines.select(F.regexp_extract("line", r"f(\d+)$", 1).cast("long").alias("doc_id"), F.regexp_extract("line", r"^(\S+)", 1).alias("digest"))
    return docs.join(sums, "doc_id", "left").select("doc_id", F.coalesce(c("digest") == c("own"), F.lit(False)).alias("good"))
