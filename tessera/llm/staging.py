"""Tables and files that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables of more files than this get their row numbers by staging; up to it their names are broadcast.
MAX_FILES = 100_000


def shared_dir(spark: SparkSession) -> str:
    """URI of a folder below ``spark.checkpoint.dir``, own to this application.

    Only a local-mode session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a staged path through Hadoop's file system."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def stage_path(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def local_path(uri: str) -> str:
    """POSIX path of a shared folder that is mounted on every node (file: or no scheme)."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri}")
    return os.path.abspath(uri)


def _is_scan(docs: DataFrame) -> bool:
    """Whether docs is a file table with nothing but projections and filters above it."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1:
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias"):
            return False
        plan = plan.children().head()
    return plan.nodeName().startswith("LogicalRelation")


def with_rows(docs: DataFrame) -> DataFrame:
    """(row, own): a number that tells each row of docs from all others, and its columns as a struct.

    Rows of a file table have the number of their file and their place in it, so nothing is written;
    any other table is staged with a number first. Either way a row keeps its number however often the
    result is computed, whatever doc_id says, and no column name of docs can clash with ours.
    """
    if _is_scan(docs) and "_metadata" not in (c.lower() for c in docs.columns):
        try:
            names = docs.select(F.col("_metadata.file_path").alias("path"))
        except AnalysisException:  # a source without file metadata
            names = None
        files = names and stage(names.distinct(), "files")
        if files and (n_files := files.count()) <= MAX_FILES:
            own = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"), F.struct("*").alias("own"))
            if n_files <= 1:
                return own.select(F.col("place").alias("row"), "own")
            # one task numbers the names of at most MAX_FILES files
            numbers = files.select("path", F.row_number().over(Window.orderBy("path")).cast("long").alias("file"))
            return own.join(F.broadcast(numbers), "path").select((F.shiftleft("file", 40) + F.col("place")).alias("row"), "own")
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("own")), "rows")
