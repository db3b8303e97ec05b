"""Fingerprints of files, and what changed between two sets of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprints(files: DataFrame, path: str = "relative_path", content: str = "content") -> DataFrame:
    """(relative_path, sha256) of every file's bytes."""
    return files.select(F.col(path).alias("relative_path"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(relative_path, change): added, modified or deleted; unchanged files are left out."""
    a = previous.select("relative_path", F.col("sha256").alias("before"))
    b = current.select("relative_path", F.col("sha256").alias("after"))
    both = a.join(b, "relative_path", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(F.col("before") != F.col("after"), "modified")
    return both.select("relative_path", change.alias("change")).where("change is not null")


def changed(files: DataFrame, changes: DataFrame) -> DataFrame:
    """The files that are new or modified."""
    return files.join(changes.where("change <> 'deleted'").select("relative_path"), "relative_path", "left_semi")


def stale(changes: DataFrame) -> DataFrame:
    """Paths whose rows an index must lose: deleted and modified ones."""
    return changes.where("change <> 'added'").select("relative_path")


def without_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """rows without those of the given paths."""
    return rows.join(paths.select("relative_path"), "relative_path", "left_anti").select(rows.columns)
