"""Folders for what a session derives from tables, and whether the tables are still the same."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which all executors share; deleted when the driver's Python ends.

    Where that is unset, a temporary folder in local mode, which has no other executors, and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = Path(tempfile.mkdtemp(prefix=f"{name}-")).as_uri()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made.append((spark, path))
    return path


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def release() -> None:
    """Delete the folders of this process."""
    while _made:
        spark, path = _made.pop()
        try:
            fs, own = _at(spark, path)
            fs.delete(own, True)
        except Exception:  # noqa: BLE001  the session has ended: its folder belongs to the cluster's cleaning
            return


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time of change) of a table's files: what differs if the table has been written anew."""
    fs, own = _at(spark, path)
    state = fs.getFileStatus(own)
    states = list(fs.listStatus(own)) if state.isDirectory() else [state]
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in states)
