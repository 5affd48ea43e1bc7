"""Session settings that operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() into the shared folder of the session; a local session without one gets a temporary folder."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder")
            folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def slices(batches: Iterator[pd.DataFrame], size: int = 64) -> Iterator[pd.DataFrame]:
    """Rows of batches, so many at a time: what is made from them is sent on before more is made."""
    for rows in batches:
        for at in range(0, len(rows), size):
            yield rows.iloc[at : at + size]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared folder; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/scratch-{name}-{uuid.uuid4().hex[:12]}"


def mounted(uri: str) -> str:
    """POSIX path of a folder that every node mounts (file: or no scheme)."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"files are written one by one into a mounted folder, not {uri}")
    return os.path.abspath(uri)
