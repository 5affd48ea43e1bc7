"""Downloads that go on where they stopped: what a partial file and the answers of a server make together.

Bytes are binary columns, so joining them to what is there, and their digests, stay in Spark. An answer is a row
(id, attempt, status, start, body): ``start`` is the first byte it says it holds, null if it says nothing.

- A partial file of the whole size needs no request; a longer one is stale and dropped first.
- 206 from the asked byte on is appended. One from another byte, or 416, drops the partial file and asks once
  more, for everything; a second refusal is an error.
- 200 holds everything, whatever was asked: it replaces the partial file.
- Any other status, or no answer, is an error, and the partial file stays.
- A file that is short or long afterwards is incomplete and stays partial; a whole one with another digest than
  the expected one is deleted.

Defined cases: no partial file is an empty one; without a known size (null or 0) anything is whole; without an
expected digest anything is right; of repeated answers to an attempt, one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses of an answer.
PARTIAL, WHOLE, REFUSED = 206, 200, 416


def resumed(parts: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, result, restarts, content, sha256) of partial files (id, part, total, expected).

    result is done, incomplete, wrong digest, or the error; content is what is on disk afterwards, null if deleted."""
    empty = F.unhex(F.lit(""))
    size = lambda x: F.octet_length(x).cast("long")
    one = lambda k: answers.where(F.col("attempt") == k).groupBy("id").agg(F.max(F.struct("status", "start", "body")).alias(f"r{k}"))
    rows = parts.select("id", F.coalesce("part", empty).alias("part"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), "expected")
    sized = F.col("total") > 0
    rows = rows.withColumn("part", F.when(sized & (size("part") > F.col("total")), empty).otherwise(F.col("part")))
    rows = rows.join(one(1), "id", "left").join(one(2), "id", "left")
    have, r1, r2 = size("part"), F.col("r1"), F.col("r2")
    complete = sized & (have == F.col("total"))
    elsewhere = (r1["status"] == PARTIAL) & (have > 0) & F.coalesce(r1["start"] != have, F.lit(False))
    again = ~complete & F.coalesce(elsewhere | (r1["status"] == REFUSED), F.lit(False))

    def error(r: Column) -> Column:
        return F.when(r.isNull(), "request failed").otherwise(F.concat(F.lit("server status "), r["status"].cast("string")))

    body = lambda r: F.coalesce(r["body"], empty)
    good = lambda r: F.coalesce(r["status"].isin(PARTIAL, WHOLE), F.lit(False))
    content = (
        F.when(complete, F.col("part")).when(again, F.when(good(r2), body(r2)).otherwise(empty))
        .when(r1["status"] == PARTIAL, F.concat("part", body(r1))).when(r1["status"] == WHOLE, body(r1)).otherwise(F.col("part"))
    )
    failed = F.when(complete, None).when(again, F.when(good(r2), None).when(r2["status"] == REFUSED, "refused twice").otherwise(error(r2))).when(good(r1), None).otherwise(error(r1))
    got = rows.select("id", "total", "expected", content.alias("content"), failed.alias("failed"), again.cast("int").alias("restarts"))
    digest = F.sha2("content", 256)
    short = sized & (size("content") != F.col("total"))
    wrong = F.coalesce(F.lower("expected") != digest, F.lit(False)) & (F.col("expected") != "")
    result = F.coalesce("failed", F.when(short, "incomplete").when(wrong, "wrong digest").otherwise("done"))
    told = got.select("id", result.alias("result"), "restarts", "content", digest.alias("sha256"))
    deleted = F.col("result") == "wrong digest"
    return told.select("id", "result", "restarts", F.when(~deleted, F.col("content")).alias("content"), F.when(~deleted, F.col("sha256")).alias("sha256"))
