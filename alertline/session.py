"""Session settings every operator relies on, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone, so that zone-less timestamps convert to epoch micros and back unchanged."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors (``spark.checkpoint.dir``).

    Only a local session without that setting gets a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return context.getCheckpointDir().rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="alertline-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, not yet existing path under the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def open_shared(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path in it. A path without a scheme is a local one."""
    if uri.startswith("file:"):
        uri = "file:///" + re.sub("^file:/*", "", uri)
    elif "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    What is read many times afterwards neither recomputes its joins nor depends on executors that hold it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
