"""File trees as tables.

Which files there are is settled on the driver, folder by folder, as ignore rules of a folder decide
whether those below are visited at all; a row per path results, and contents are read by Spark.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.config import EXTENSIONLESS_FILES, Settings
from lodestrand.sources.ignore import Ignores

FILES = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("relative_path", T.StringType()), T.StructField("bytes", T.BinaryType())])
#: Paths that one read names; a larger tree is read in that many reads, whose union is one plan.
PATHS_PER_READ = 20_000
_GLOB = re.compile(r"[\\*?\[\]{}]")


def checked_root(path: str) -> Path:
    """An absolute path to a folder that is there."""
    root = Path(path)
    if not root.is_absolute():
        raise ValueError(f"the path must be absolute: {path}")
    if not root.exists():
        raise ValueError(f"there is no such path: {path}")
    if not root.is_dir():
        raise ValueError(f"the path is no folder: {path}")
    return root


def is_included(name: str, extensions: frozenset[str]) -> bool:
    """Extensions in their listed case, or one of a few names that have none."""
    stem, dot, ext = name.rpartition(".")
    return ext in extensions if dot and stem else name.lower() in EXTENSIONLESS_FILES


def walk(path: str, settings: Settings | None = None, home: str | None = None) -> list[str]:
    """The files to be indexed, sorted. Hidden and ignored ones are left out, and what cannot be
    read; links are not followed unless asked for."""
    settings = settings or Settings()
    root = checked_root(path)
    patterns = settings.ignore_patterns if settings.apply_default_ignores else ()
    ignores = Ignores(root, settings.ignore_file, Path(home) if home else None, tuple(patterns))
    return sorted(_below(root, ignores, frozenset(settings.extensions), settings, set()))


def _below(folder: Path, ignores: Ignores, extensions: frozenset[str], settings: Settings, seen: set[str]) -> Iterator[str]:
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    if settings.follow_symlinks:
        real = os.path.realpath(folder)
        if real in seen:
            return
        seen.add(real)
    for entry in entries:
        try:
            if entry.name.startswith(".") or entry.is_symlink() and not settings.follow_symlinks:
                continue
            is_dir = entry.is_dir()
            if not is_dir and not (entry.is_file() and is_included(entry.name, extensions)):
                continue
            if settings.apply_max_file_size and not is_dir and 0 < settings.max_file_size < entry.stat().st_size:
                continue
        except OSError:
            continue
        own = folder / entry.name
        if ignores.ignored(own, is_dir):
            continue
        if is_dir:
            yield from _below(own, ignores, extensions, settings, seen)
        else:
            yield str(own)


def read(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(file_path, relative_path, bytes) of the files."""
    if not paths:
        return spark.createDataFrame([], FILES)
    found = None
    for k in range(0, len(paths), PATHS_PER_READ):
        own = ["file://" + _GLOB.sub(r"\\\g<0>", p) for p in paths[k : k + PATHS_PER_READ]]
        part = spark.read.format("binaryFile").load(own).select("path", F.col("content").alias("bytes"))
        found = part if found is None else found.unionAll(part)
    plain = F.regexp_replace("path", "^file:/+", "/")
    head = str(Path(root)).rstrip("/") + "/"
    return found.select(plain.alias("file_path"), F.substr(plain, F.lit(len(head) + 1)).alias("relative_path"), "bytes")


def texts(files: DataFrame) -> DataFrame:
    """(file_path, relative_path, content): the files that are valid UTF-8."""
    return files.where(F.is_valid_utf8("bytes")).select("file_path", "relative_path", F.col("bytes").cast("string").alias("content"))


def unreadable(files: DataFrame) -> DataFrame:
    """(relative_path, warning): files whose bytes are no text."""
    return files.where(~F.is_valid_utf8("bytes")).select("relative_path", F.lit("not valid UTF-8").alias("warning"))
