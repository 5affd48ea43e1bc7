"""Sinks: one file a row, and a table of last writes."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import mounted, scratch
from tessera.sources import tree


def write_files(rows: DataFrame, folder: str, name: str, body: str) -> int:
    """Write the body of each row under its name, in place at once, so a repeated task writes the same file again; the number of files.

    Names are paths below the folder, as the caller made them unique; the folder is one that all executors mount."""
    top = mounted(folder)

    def run(batches):
        made: set[str] = set()
        for batch in batches:
            os.makedirs(top, exist_ok=True)
            for where, text in zip(batch[name], batch[body], strict=True):
                target = os.path.join(top, where)
                beside = os.path.dirname(target)
                if beside not in made:
                    os.makedirs(beside, exist_ok=True)
                    made.add(beside)
                # beside its target: a folder that all tasks write to makes them wait for each other
                own = os.path.join(beside, f".{uuid.uuid4().hex}")
                with open(own, "w", encoding="utf-8", newline="") as file:
                    file.write(text)
                os.replace(own, target)
            yield batch[[name]]

    # files are work for all tasks, also where the rows are few pieces
    dealt = rows.select(name, body).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInPandas(run, f"{name} string").count()


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, body) of the files of a folder."""
    return tree.tree(spark, folder, depth=0, content=True).select(F.col("relative").alias("name"), F.col("content").cast("string").alias("body"))


def through_files(spark: SparkSession, rows: DataFrame, key: str, body: str, ending: str) -> DataFrame:
    """(key, body) of files named by a number, one a row, that were written to a new folder and read back."""
    folder = scratch(spark, "files")
    write_files(rows.select(F.concat(F.col(key).cast("string"), F.lit(ending)).alias("name"), body), folder, "name", body)
    return read_files(spark, folder).select(F.regexp_extract("name", r"^(\d+)\.", 1).cast("long").alias(key), F.col("body").alias(body))


def _log(spark: SparkSession, store: str):
    """(file system, path class, folder) of a store's log."""
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(f"{store}/log")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    return fs, jvm.Path, folder


def _version(spark: SparkSession, store: str) -> tuple[int, dict[str, str]]:
    """Number of the last version (0: none), and where each bucket lies in it."""
    fs, _, folder = _log(spark, store)
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    n = max((int(x.removesuffix(".json")) for x in names if x.removesuffix(".json").isdigit()), default=0)
    return n, json.loads(spark.read.text(f"{store}/log/{n}.json", wholetext=True).first()[0]) if n else {}


def _commit(spark: SparkSession, store: str, n: int, places: dict[str, str]) -> bool:
    """Write version n, unless another writer did."""
    fs, path, _ = _log(spark, store)
    try:
        out = fs.create(path(f"{store}/log/{n}.json"), False)
    except Py4JJavaError as e:
        if "exist" in str(e.java_exception).lower():
            return False
        raise
    out.write(bytearray(json.dumps(places).encode()))
    out.close()
    return True


def upsert(store: str, rows: DataFrame, key: str, order: Column, buckets: int = 64, tries: int = 8) -> DataFrame:
    """Merge rows into the table at ``store``, the last write of each key by ``order`` wins; the table as it is then.

    Keys lie in buckets, and only those that rows touch are read and written again, to places of their own. A version is
    a small file that says where each bucket lies; it can be created once only, so of two writers at once the second
    one merges into what the first one left. Readers of an older version go on. The number of buckets stays as
    the first write had it."""
    spark = rows.sparkSession
    values = [c for c in rows.columns if c != key]
    for _ in range(tries):
        n, places = _version(spark, store)
        count = places.get("buckets", buckets)
        bucket = F.pmod(F.xxhash64(key), F.lit(count)).alias("bucket")
        touched = [str(r[0]) for r in rows.select(bucket).distinct().collect()]
        old = [places[b] for b in touched if b in places]
        both = rows.unionByName(spark.read.schema(rows.schema).parquet(*old)) if old else rows
        merged = both.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("last")).select(key, *[F.col(f"last.{c}").alias(c) for c in values])
        place = f"{store}/data/{uuid.uuid4().hex}"
        merged.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(count))).repartition("bucket").write.partitionBy("bucket").parquet(place)
        new = places | {b: f"{place}/bucket={b}" for b in touched} | {"buckets": count}
        if _commit(spark, store, n + 1, new):
            return stored(spark, store, rows.schema)
    raise RuntimeError(f"{store}: other writers were first {tries} times")


def stored(spark: SparkSession, store: str, schema) -> DataFrame:
    """The table at ``store``."""
    places = [p for b, p in _version(spark, store)[1].items() if b != "buckets"]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)
