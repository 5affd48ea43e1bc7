"""Folders as a Python data source: partitions share the files of a tree by their names, links are never followed.

Options: ``path``, ``depth`` (folders below the top that are entered, 8), ``content`` (whether files are read),
``shares`` (partitions). The folder is one that all nodes mount. What cannot be listed or read is left out; names that are not text as well.
"""

from __future__ import annotations

import datetime
import os
import stat
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.session import mounted

#: Folders below a registry's top and files of it that are looked at, and files of one intake by hand.
DEPTH, MOST_MANIFESTS, MOST_DROPPED = 8, 4096, 256
#: Folders below the top that all partitions list, at most, and rows and bytes of a batch.
SHARED, ROWS, HELD = 2, 1024, 4 << 20


class Share(InputPartition):
    """One of so many shares of a tree."""

    def __init__(self, number: int, of: int) -> None:
        self.number, self.of = number, of

    def holds(self, name: str) -> bool:
        return zlib.crc32(name.encode()) % self.of == self.number


def _entries(folder: str) -> tuple[list[str], list[str]]:
    """Names of the folders and of the other entries of a folder, without links to folders."""
    folders, others = [], []
    try:
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    entry.name.encode()
                    (folders if entry.is_dir(follow_symlinks=False) else others).append(entry.name)
                except (OSError, UnicodeError):
                    continue
    except OSError:
        return [], []
    return folders, others


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.top, self.most = mounted(options["path"]).rstrip("/"), int(options.get("depth", DEPTH))
        self.content, self.shares = options.get("content", "false").lower() == "true", int(options.get("shares", 16))

    def partitions(self) -> Sequence[InputPartition]:
        return [Share(k, self.shares) for k in range(self.shares)]

    def _files(self, share: Share) -> Iterator[tuple[str, int]]:
        """(path, depth) of the files of a share. Names of the top and of folders near it are listed in all shares, which
        deal the files; where there are many folders, or deeper down, a folder is in one share with all below it."""
        stack = [(self.top, 0, False)]
        while stack:
            folder, depth, own = stack.pop()
            folders, others = _entries(folder)
            whole = own or depth >= SHARED or len(folders) >= 4 * share.of
            if depth < self.most:
                paths = (os.path.join(folder, n) for n in folders)
                stack.extend((p, depth + 1, whole) for p in paths if own or not whole or share.holds(p))
            yield from ((p, depth) for n in others if share.holds(p := os.path.join(folder, n)) or own)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, depth in self._files(partition):
            try:
                s = os.lstat(path)
                if not stat.S_ISREG(s.st_mode):
                    continue
                body = None
                if self.content:
                    with open(path, "rb") as file:
                        body = file.read()
            except OSError:
                continue
            rows.append((path, path[len(self.top) + 1 :], depth, s.st_size, datetime.datetime.fromtimestamp(s.st_mtime, datetime.UTC), body))
            held += len(body or b"")
            if len(rows) == ROWS or held >= HELD:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


_FIELDS = {"path": pa.string(), "relative": pa.string(), "depth": pa.int32(), "size": pa.int64(), "modified": pa.timestamp("us", "UTC"), "content": pa.binary()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _FIELDS.values(), strict=True)], names=list(_FIELDS))


class FolderTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return "path string, relative string, depth int, size long, modified timestamp, content binary"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def tree(spark: SparkSession, folder: str, depth: int = DEPTH, content: bool = False) -> DataFrame:
    """(path, relative, depth, size, modified, content) of the files below a folder."""
    spark.dataSource.register(FolderTree)
    return spark.read.format("folder_tree").options(path=folder, depth=depth, content=content, shares=4 * spark.sparkContext.defaultParallelism).load()


def expand(spark: SparkSession, paths: list[str], most: int = MOST_DROPPED) -> DataFrame:
    """(path, size) of dropped files and the files below dropped folders, sorted.

    An intake by hand takes so many files only: it starts with the last path and with the last name of each folder.
    A path that is a link or does not exist has no files."""
    found = spark.createDataFrame([], "turn int, names array<string>, path string, size long")
    for turn, path in enumerate(map(mounted, paths)):
        if os.path.islink(path) or not os.path.exists(path):
            continue
        if os.path.isdir(path):
            files = tree(spark, path, depth=1 << 20).select("path", "size")
        else:
            files = spark.createDataFrame([(path, os.lstat(path).st_size)], "path string, size long")
        found = found.union(files.select(F.lit(turn), F.split("path", "/"), "path", "size"))
    taken = found.orderBy(F.desc("turn"), F.desc("names")).limit(most)
    return taken.orderBy("names").select("path", "size")


def weight_layer(manifest: Column, layer: str) -> Column:
    """(digest, bytes) of the first layer of a kind that has a usable digest; null if there is none."""
    layers = F.from_json(manifest, "layers array<struct<mediaType:string,digest:string,size:bigint>>")["layers"]
    fit = F.filter(layers, lambda x: (x["mediaType"] == layer) & x["digest"].rlike("^sha256:[0-9A-Fa-f]+$") & x["size"].isNotNull())
    first = F.get(fit, F.lit(0))
    return F.when(first.isNotNull(), F.struct(F.substring_index(first["digest"], ":", -1).alias("digest"), first["size"].alias("bytes")))


def registry(spark: SparkSession, root: str, layer: str, most: int = MOST_MANIFESTS) -> DataFrame:
    """(name, digest, bytes) of the models of a store: manifests/<host>/.../<namespace>/<model>/<tag>, whose blobs/sha256-<digest> is there."""
    manifests = tree(spark, f"{root}/manifests", content=True).orderBy("relative").limit(most)
    parts = F.split("relative", "/")
    n = F.size(parts)
    namespace, model, tag = (F.element_at(parts, -k) for k in (3, 2, 1))
    tail = F.concat_ws(":", model, tag)
    own = F.when(namespace.isin("library", ""), tail).otherwise(F.concat_ws("/", namespace, tail))
    read = manifests.where(n >= 4).select(own.alias("name"), weight_layer(F.col("content").cast("string"), layer).alias("w")).where("w IS NOT NULL")
    blobs = tree(spark, f"{root}/blobs", depth=0).select(F.regexp_extract("relative", "^sha256-(.*)$", 1).alias("digest"))
    return read.select("name", "w.digest", "w.bytes").join(blobs, "digest").select("name", "digest", "bytes")
