"""Names that never repeat: the n-th asker for a title gets its n-th free suffix.

Askers come in an order. A title x has the names ``x``, ``x - 2``, ``x - 3`` and so on; an asker gets the first that
neither exists nor was given before. Two titles only collide where one reads like the other's n-th name, as ``x - 2``
does: its first asker claims number 2 of x, and has it if x has not come to 2 by then.

An asker's rank within its title is a running count over ranges of the order, so no task sees a whole title. Which
claims succeed is a fold over the few claims on a title, one level of suffixes after the other. The number for a
rank follows from the numbers that are taken: between the j-th and the next one, rank k has number k + j. Ranks and
these gaps meet by title and bucket of ranks.

Defined cases: askers without a title get none; orders must differ; repeated existing names are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpointed

#: Ranks of a bucket in which they meet gaps.
BUCKET = 10_000
_SUFFIX = r"^(.*) - ([2-9]|[1-9][0-9]+)$"


def running(rows: DataFrame, key: str, order: str, amount: str) -> DataFrame:
    """rows with ``upto``: the sum of amount over the rows of their key up to them, by order.

    Rows are dealt by ranges of key and order; a large key has many ranges, and only their sums meet."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(n, key, order).withColumn("range", F.spark_partition_id()))
    whole = dealt.groupBy(key, "range").agg(F.sum(amount).alias("own"))
    before = F.sum("own").over(Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    whole = whole.select(key, "range", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum(amount).over(Window.partitionBy(key, "range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("within", within).join(whole, [key, "range"]).withColumn("upto", F.col("before") + F.col("within")).drop("range", "before", "within")


def numbers(ranks: DataFrame, taken: DataFrame) -> DataFrame:
    """ranks (title, k, ...) with ``number``: the k-th that is not among taken (title, number) of their title."""
    place = F.row_number().over(Window.partitionBy("title").orderBy("number"))
    gaps = taken.distinct().withColumn("j", place).withColumn("above", F.col("number") - F.col("j"))
    # several taken in a row leave no rank between them: the last one counts
    gaps = gaps.groupBy("title", "above").agg(F.max("j").alias("j"))
    gaps = gaps.withColumn("next", F.lead("above").over(Window.partitionBy("title").orderBy("above")))
    most = ranks.groupBy("title").agg(F.max("k").alias("most"))
    reach = gaps.join(most, "title").where("above < most").withColumn("last", F.least(F.coalesce("next", "most"), F.col("most")))
    span = F.explode(F.sequence(F.floor((F.col("above") + 1) / BUCKET), F.floor(F.col("last") / BUCKET))).alias("bucket")
    spread = reach.select(F.col("title").alias("t"), "above", "last", "j", span)
    met = ranks.withColumn("bucket", F.floor(F.col("k") / BUCKET)).join(spread, (F.col("title") == F.col("t")) & (F.col("k") > F.col("above")) & (F.col("k") <= F.col("last")) & spread["bucket"].eqNullSafe(F.floor(F.col("k") / BUCKET)), "left")
    return met.select(*[ranks[c] for c in ranks.columns], (F.col("k") + F.coalesce("j", F.lit(0))).alias("number"))


def _parent(name: Column) -> tuple[Column, Column]:
    """The title of which a name is the n-th, and n; null if it is no such name."""
    found = F.regexp_extract(name, _SUFFIX, 2)
    return F.when(found != "", F.regexp_extract(name, _SUFFIX, 1)), F.nullif(found, F.lit("")).try_cast("long")


def unique_names(askers: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, name) for askers (id, title, order), beside the names (name) that exist."""
    asked = checkpointed(askers.where("title IS NOT NULL").select("id", "title", "order"))
    parent, number = _parent(F.col("title"))
    first = asked.groupBy("title").agg(F.min("order").alias("order"), F.count("*").alias("n"))
    first = checkpointed(first.select("title", "order", parent.alias("parent"), number.alias("number")))
    titles = first.select("title")
    claims = first.where("number IS NOT NULL").join(titles.withColumnRenamed("title", "parent"), "parent", "left_semi")
    counted = asked.select("title", "order", F.col("id"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("number"))
    marks = claims.select(F.col("parent").alias("title"), "order", F.lit(None).cast(asked.schema["id"].dataType).alias("id"), F.lit(0).alias("one"), "number")
    ranked = checkpointed(running(counted.union(marks), "title", "order", "one"))

    there = existing.where("name IS NOT NULL").distinct()
    up, nth = _parent(F.col("name"))
    taken = there.select(F.col("name").alias("title"), F.lit(1).cast("long").alias("number")).union(there.select(up.alias("title"), nth.alias("number")).where("number IS NOT NULL"))
    taken = checkpointed(taken.join(titles, "title", "left_semi"))

    # claims on titles without a suffix are settled first, then those on titles with one, and so on
    depth = F.size(F.split("title", " - ")) - 1
    marked = ranked.where("id IS NULL AND number IS NOT NULL AND one = 0").select("title", "number", F.col("upto").alias("before"), depth.alias("depth"))
    marked = checkpointed(marked)
    for (level,) in sorted(marked.select("depth").distinct().collect()):
        of_title = marked.where(F.col("depth") == level).groupBy("title").agg(F.sort_array(F.collect_list(F.struct("number", "before"))).alias("claims"))
        held = taken.groupBy("title").agg(F.sort_array(F.collect_set("number")).alias("held"))
        both = of_title.join(held, "title", "left").withColumn("held", F.coalesce("held", F.array().cast("array<long>")))
        rank = lambda won, x: x["number"] - F.size(F.filter("held", lambda h: h < x["number"])) - F.size(won)
        wins = lambda won, x: ~F.array_contains("held", x["number"]) & (x["before"] < rank(won, x))
        won = F.aggregate("claims", F.array().cast("array<long>"), lambda w, x: F.when(wins(w, x), F.array_append(w, x["number"])).otherwise(w))
        settled = both.select("title", F.explode("claims.number").alias("number"), won.alias("won")).withColumn("wins", F.array_contains("won", F.col("number")))
        lost = settled.where("NOT wins").select(F.concat("title", F.lit(" - "), F.col("number").cast("string")), F.lit(1).cast("long"))
        taken = checkpointed(taken.union(settled.where("wins").select("title", "number")).union(lost).distinct())

    found = numbers(ranked.where("one = 1").select("id", "title", F.col("upto").alias("k")), taken)
    return found.select("id", F.when(F.col("number") == 1, F.col("title")).otherwise(F.concat("title", F.lit(" - "), F.col("number").cast("string"))).alias("name"))
