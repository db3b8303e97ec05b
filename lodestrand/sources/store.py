"""Workspaces: the tables of a collection, as Parquet in segments.

{workspace}/{collection}/ holds current.json, which names the segments that readers use and the index's
header. A run writes one segment: folders of its new rows, and the paths whose rows in earlier segments
are void. Nothing that is there is written again, until there are more than MOST_SEGMENTS: then they
are merged to one. A segment is written whole, and then current.json is replaced in one step, so a reader or a
crash never meets half an index. Segments that no longer count stay for KEEP_SECONDS, for the searches that
were planned before. Files go through Hadoop's file system, so a workspace may lie in any store that Spark knows.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_SEGMENTS = 8
KEEP_SECONDS = 3600.0
#: A lock that its owner has not renewed for this long is void; owners renew it four times as often.
LOCK_SECONDS = 600.0


class Store:
    """Small files and folders in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):  # noqa: ANN202
        own = self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{path}")
        return own.getFileSystem(self._conf), own

    def exists(self, path: str) -> bool:
        fs, own = self._at(path)
        return fs.exists(own)

    def delete(self, path: str) -> bool:
        fs, own = self._at(path)
        return fs.delete(own, True)

    def names(self, path: str = "") -> list[str]:
        """The folders in a folder."""
        fs, own = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(own) if s.isDirectory()) if fs.exists(own) else []

    def load(self, path: str) -> dict | None:
        fs, own = self._at(path)
        if not fs.exists(own):
            return None
        stream = fs.open(own)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def save(self, path: str, value: dict) -> None:
        """Write beside, then replace."""
        fs, own = self._at(path)
        fs, draft = self._at(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(json.dumps(value, indent=2).encode())
        stream.close()
        self._context(fs, own).rename(draft, own, self._renames(self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE))

    def rename(self, path: str, to: str) -> bool:
        """Whether a file was there and has been moved: only one of several that try can, and a file that is at the new name stays."""
        (fs, own), (_, target) = self._at(path), self._at(to)
        try:
            self._context(fs, own).rename(own, target, self._renames())
        except Exception as e:  # noqa: BLE001  the JVM's exception says what was there
            if "FileNotFound" in str(e) or "AlreadyExists" in str(e):
                return False
            raise
        return True

    def _context(self, fs, own):  # noqa: ANN001, ANN202
        return self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri() if own.toUri().getScheme() else fs.getUri(), self._conf)

    def _renames(self, *options):  # noqa: ANN002, ANN202
        array = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, len(options))
        for k, x in enumerate(options):
            array[k] = x
        return array

    def age(self, path: str) -> float | None:
        """Seconds since a file was written or touched; None if it is not there."""
        fs, own = self._at(path)
        return max(0.0, time.time() - fs.getFileStatus(own).getModificationTime() / 1000) if fs.exists(own) else None

    def touch(self, path: str) -> None:
        fs, own = self._at(path)
        fs.setTimes(own, int(time.time() * 1000), -1)

    def create_alone(self, path: str, value: dict) -> bool:
        """Make a file that must not be there yet."""
        fs, own = self._at(path)
        try:
            stream = fs.create(own, False)
        except Exception as e:  # noqa: BLE001  the JVM's exception says whether it was there
            if "AlreadyExists" in str(e):
                return False
            raise
        stream.write(json.dumps(value).encode())
        stream.close()
        return True


class Lost(RuntimeError):
    """The lock, or the index as it was read, is not ours any more: another run has taken over."""


class Lock:
    """A file that only one run can make, renewed while the run lives; one that nobody renews may be broken.

    Breaking is a rename to a name that follows from the broken lock's owner, which one run alone can win: a lock that
    another has taken meanwhile has another owner, and is put back."""

    def __init__(self, store: Store, path: str, seconds: float = LOCK_SECONDS):
        self.store, self.path, self.seconds, self.owner = store, path, seconds, uuid.uuid4().hex
        self._ended = threading.Event()

    def take(self, facts: dict) -> bool:
        """Whether the lock is ours now."""
        age, held = self.store.age(self.path), self.store.load(self.path)
        if age is not None and held is not None and age > self.seconds and not self._break(held.get("owner")):
            return False
        if not self.store.create_alone(self.path, {"owner": self.owner, **facts}):
            return False
        threading.Thread(target=self._renew, daemon=True).start()
        return True

    def _break(self, owner: str | None) -> bool:
        """Take away the lock of an owner that was found too old; no other lock that is there now."""
        aside = f"{self.path}.{owner}.broken"
        if not self.store.rename(self.path, aside):
            return False
        moved = self.store.load(aside)
        if moved is not None and moved.get("owner") != owner:
            # Someone has broken the old lock before us and made this one. It goes back, unless a third has come.
            self.store.rename(aside, self.path)
            return False
        self.store.delete(aside)
        return True

    def ours(self) -> bool:
        held = self.store.load(self.path)
        return held is not None and held.get("owner") == self.owner

    def _renew(self) -> None:
        while not self._ended.wait(self.seconds / 4):
            try:
                if self.ours():
                    self.store.touch(self.path)
            except Exception:  # noqa: BLE001  the lock is gone or the session has ended: there is nothing to renew
                return

    def give_back(self) -> None:
        """Delete the lock, if it is still ours."""
        self._ended.set()
        if self.ours():
            self.store.delete(self.path)


Writers = dict[str, Callable[[DataFrame, str], None]]
Derived = dict[str, Callable[[dict[str, DataFrame]], DataFrame]]


@dataclass
class Collection:
    """One collection of a workspace. Its tables have the column relative_path, by which rows are deleted; derived ones need not.

    owned: whether this run may still publish."""

    store: Store
    name: str
    owned: Callable[[], bool] = lambda: True
    header: dict | None = field(init=False)

    def __post_init__(self) -> None:
        self.refresh()

    def refresh(self) -> None:
        self.header = self.store.load(f"{self.name}/current.json")

    @property
    def exists(self) -> bool:
        return self.header is not None

    def _path(self, segment: str, name: str) -> str:
        return f"{self.store.base}/{self.name}/{segment}/{name}"

    def raw(self, name: str) -> DataFrame | None:
        """A table's rows of all segments, those of deleted paths too, with the number of their segment in _segment; None if there is no such table."""
        if not self.header or name not in self.header["tables"]:
            return None
        schema = T.StructType.fromJson(self.header["tables"][name])
        rows = None
        for k, segment in enumerate(self.header["segments"]):
            if name in segment["tables"]:
                own = self.store.spark.read.schema(schema).parquet(self._path(segment["id"], name)).withColumn("_segment", F.lit(k))
                rows = own if rows is None else rows.unionAll(own)
        return rows

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows with relative_path and _segment, without those that a later segment has deleted."""
        gone = None
        for k, segment in enumerate(self.header["segments"]):
            if segment["deletes"] and k:
                own = self.store.spark.read.schema("relative_path string").parquet(self._path(segment["id"], "deleted")).withColumn("_before", F.lit(k))
                gone = own if gone is None else gone.unionAll(own)
        if gone is not None:
            last = gone.groupBy(F.col("relative_path").alias("_path")).agg(F.max("_before").alias("_before"))
            rows = rows.join(last, (F.col("relative_path") == F.col("_path")) & (F.col("_segment") < F.col("_before")), "left_anti")
        return rows.drop("_segment")

    def table(self, name: str) -> DataFrame | None:
        """A table's rows that no later segment has deleted; None if there is no such table."""
        rows = self.raw(name)
        return None if rows is None else self.live(rows)

    def append(self, tables: dict[str, DataFrame], deletes: DataFrame | None, facts: dict, writers: Writers | None = None, derived: Derived | None = None, gone: dict[str, DataFrame] | None = None) -> None:
        """Add a segment of new rows; deletes: paths whose rows in the segments so far are void. None: all of those are.

        writers: tables that are laid out in a way of their own. derived: tables made from the segment's tables as written, in
        order; they need no relative_path, and are made anew when segments are merged. gone: what the deleted rows have added to
        sums before; left out where no rows are deleted."""
        before = self.header["segments"] if self.header else []
        segment = {"id": uuid.uuid4().hex, "deletes": deletes is not None and bool(before)}
        given = {**tables, **({**(gone or {}), "deleted": deletes.select("relative_path")} if segment["deletes"] else {})}
        schemas = self._write(segment["id"], given, writers, derived)
        schemas.pop("deleted", None)
        segment["tables"] = sorted(schemas)
        kept = [*before, segment] if segment["deletes"] else [segment]
        self._publish(kept, [x["id"] for x in before] if len(kept) == 1 else [], {"tables": {**(self.header["tables"] if len(kept) > 1 else {}), **schemas}, **facts})
        if len(kept) > MOST_SEGMENTS:
            self.compact(writers, derived)
        self.vacuum()

    def compact(self, writers: Writers | None = None, derived: Derived | None = None) -> None:
        """Merge all segments to one, without the deleted rows."""
        old = self.header["segments"]
        own = [name for name, schema in self.header["tables"].items() if name not in (derived or {}) and any(f["name"] == "relative_path" for f in schema["fields"])]
        segment = {"id": uuid.uuid4().hex, "deletes": False}
        schemas = self._write(segment["id"], {name: self.table(name) for name in own}, writers, derived)
        segment["tables"] = sorted(schemas)
        self._publish([segment], [x["id"] for x in old], {**{k: v for k, v in self.header.items() if k not in ("segments", "retired")}, "tables": schemas})

    def _write(self, segment: str, tables: dict[str, DataFrame], writers: Writers | None, derived: Derived | None) -> dict[str, dict]:
        """Write a segment's tables; their schemas."""
        written: dict[str, DataFrame] = {}
        try:
            for name in [*tables, *(derived or {})]:
                df, path = tables[name] if name in tables else derived[name](written), self._path(segment, name)
                put = (writers or {}).get(name)
                if put:
                    put(df, path)
                else:
                    df.write.parquet(path)
                written[name] = self.store.spark.read.schema(df.schema).parquet(path)
        except BaseException:
            self.store.delete(f"{self.name}/{segment}")
            raise
        return {name: df.schema.jsonValue() for name, df in written.items()}

    def _publish(self, segments: list[dict], retired: list[str], facts: dict) -> None:
        """Replace the header that was read, and no other: a run that was paused while another has published stops here."""
        found = self.store.load(f"{self.name}/current.json")
        if (found or {}).get("version") != (self.header or {}).get("version") or not self.owned():
            for x in segments[-1:]:
                self.store.delete(f"{self.name}/{x['id']}")
            raise Lost(f"{self.name} has been changed by another run")
        held = (self.header or {}).get("retired", []) + [{"id": x, "at": time.time()} for x in retired]
        header = {**facts, "segments": segments, "retired": held, "version": uuid.uuid4().hex}
        self.store.save(f"{self.name}/current.json", header)
        self.header = header

    def vacuum(self, seconds: float | None = None) -> None:
        """Delete segments that stopped to count that long ago."""
        limit = time.time() - (KEEP_SECONDS if seconds is None else seconds)
        old = [x for x in self.header["retired"] if x["at"] <= limit]
        if old:
            for x in old:
                self.store.delete(f"{self.name}/{x['id']}")
            self.header = {**self.header, "retired": [x for x in self.header["retired"] if x not in old]}
            self.store.save(f"{self.name}/current.json", self.header)

    def drop(self) -> bool:
        found = self.store.exists(self.name)
        self.store.delete(self.name)
        self.header = None
        return found


def row_counts(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """(name, row_count) of all collections in one job; a collection without rows has 0."""
    names = spark.createDataFrame([(n,) for n in sorted(tables)], "name string")
    parts = [df.select(F.lit(name).alias("name")) for name, df in tables.items() if df is not None]
    if not parts:
        return names.withColumn("row_count", F.lit(0).cast("long"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionAll(more)
    counts = rows.groupBy("name").agg(F.count("*").alias("row_count"))
    return names.join(counts, "name", "left").select("name", F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"))


LoadTable = Callable[[str], DataFrame | None]
