"""Helpers that every operator of this subpackage uses: batches, scratch tables, code shipping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows handed to a Python operator at once, and the bytes of text that it looks at together.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20

PACKAGE = __name__.partition(".")[0]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, or some of its columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(*columns) if columns else docs


@lru_cache(maxsize=1)
def _archive() -> str:
    """A zip of this package for the executors' import path."""
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix=f"{PACKAGE}-")) / f"{PACKAGE}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    return str(target)


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors, once a session, and bound the bytes of a batch for Python."""
    context = spark.sparkContext
    if not any(path.endswith(f"{PACKAGE}.zip") for path in context.listFiles):
        context.addPyFile(_archive())
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * BATCH_BYTES))
    # Spark 4.1.2 takes a union of bucketed tables for bucketed, reads them otherwise, and so groups it wrongly.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    # The buckets that bucketed() writes are one file each, in order.
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_made: list[tuple[SparkSession, str, str | None]] = []


def scratch(spark: SparkSession, name: str, table: str | None = None) -> str:
    """A new folder's path below spark.checkpoint.dir, which all executors share; table: one that goes with it.

    Where that is unset, as in local tests, the folder is a temporary one, and it becomes the
    checkpoint directory as well. Folders go when the driver's Python ends (or with release())."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = Path(tempfile.mkdtemp(prefix=f"{PACKAGE}-")).as_uri()
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{PACKAGE}-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made.append((spark, path, table))
    return path


def release() -> None:
    """Delete the scratch folders of this process, and their tables."""
    while _made:
        spark, path, table = _made.pop()
        try:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session has ended: its folder belongs to the cluster's cleaning
            return


def ensure_checkpoints(spark: SparkSession) -> None:
    """Give the session a checkpoint directory if it has none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured or Path(tempfile.mkdtemp(prefix=f"{PACKAGE}-")).as_uri())


def written(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, safe against lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.partitionBy(*partitions) if partitions else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df, which must be in that many hash partitions of key, as a table of one sorted file per bucket in the shared folder."""
    spark = df.sparkSession
    table = f"{PACKAGE}_{uuid.uuid4().hex}"
    df.write.option("path", scratch(spark, name, table)).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


#: Keys that hot_join broadcasts; and the bits of an IdFilter, whatever the number of ids: 16 MB.
HOT_KEYS = 1024
FILTER_BITS = 1 << 27


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has one row per key and in weight about how many rows of left it meets.

    The HOT_KEYS heaviest keys are broadcast, always that many at most, so that their rows stay where they
    are; all other rows are joined by a shuffle. right is read twice: it should be written or cheap."""
    heavy = written(right.orderBy(F.desc(weight), key).limit(HOT_KEYS), "heavy")
    names = F.broadcast(heavy.select(key))
    few = left.join(F.broadcast(heavy), key)
    rest = left.join(names, key, "left_anti").join(right.join(names, key, "left_anti"), key, how)
    return few.unionByName(rest)


class IdFilter:
    """A set of ids as FILTER_BITS bits, one for each id by its hash: it has all the ids and a few others.

    Rows that it does not have need no join, and so no shuffle, to be told from the ids; those that it has
    are joined to be exact. It takes the same space for any number of ids; with very many it lets more pass."""

    def __init__(self, ids: DataFrame, column: str):
        rows = ids.select(self.place(column).alias("place")).select(F.shiftright("place", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(place & 63L as int))").alias("mask"))
        # A row for each word that is not zero: FILTER_BITS / 64 at most.
        self.masks = written(rows.groupBy("word").agg(F.bit_or("mask").alias("mask")), "filter")

    @staticmethod
    def place(column: str) -> Column:
        """Which bit stands for an id."""
        return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))

    def split(self, df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """The rows of df whose id the filter has, and the others: by a broadcast of the masks, without moving a row."""
        names = df.columns
        place, word, mask = fresh(names, "place"), fresh(names, "word"), fresh(names, "mask")
        masks = F.broadcast(self.masks.withColumnsRenamed({"word": word, "mask": mask}))
        met = df.withColumn(place, self.place(column)).join(masks, F.shiftright(place, 6).cast("int") == F.col(word), "left")
        has = F.coalesce(F.getbit(F.col(mask), F.col(place).bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
        return met.where(has).select(names), met.where(~has).select(names)


_memos: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """Say how a module forgets what it remembers in a worker beyond a task."""
    _memos[owner] = forget


def turn_to(owner: str) -> None:
    """Workers serve one stage after another: one that turns to a module's work forgets what the others remember."""
    for name, forget in _memos.items():
        if name != owner:
            forget()
    pa.default_memory_pool().release_unused()


def fresh(taken: Iterable[str], name: str) -> str:
    """name, or a variant of it that no column has; column names ignore case."""
    known = {x.lower() for x in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def utf8(column: str | Column) -> Column:
    """A text column as bytes: texts need not be valid UTF-8 to pass through Arrow."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def text_of(raw: bytes | None) -> str:
    """A null is an empty text; bytes that are no UTF-8 become U+FFFD."""
    return raw.decode("utf-8", "replace") if raw else ""


def slices(batches: Iterable[pa.RecordBatch], text: int | None = None, most: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches to that many rows and, by the bytes of column number text, to about `most`."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, rows)
            if text is not None and part.num_rows > 1:
                lengths = pc.fill_null(pc.binary_length(part.column(text)), 0)
                sums = pc.cumulative_sum(lengths.cast(pa.int64())).to_numpy(zero_copy_only=False)
                part = part.slice(0, max(1, int(sums.searchsorted(most, side="right"))))
            yield part
            start += part.num_rows


def append_columns(
    df: DataFrame, read: str, make: Callable[[], Callable[[list], Iterable[tuple]]], added: T.StructType, drop: Iterable[str] = ()
) -> DataFrame:
    """df without the columns in drop, and with the columns of added for each row.

    make() is called once a task; what it returns gets the bytes (or None) of column read, in
    lists, and returns a tuple per row. Rows are neither dropped nor moved; there is no shuffle."""
    names, gone = df.columns, set(drop)
    place, kept = names.index(read), [k for k, name in enumerate(names) if name not in gone]
    schema = T.StructType([df.schema[k] for k in kept] + added.fields)
    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    labels = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(make.__module__)
        work = make()
        for part in slices(batches, place):
            rows = list(work(as_bytes(part.column(place))))
            made = [pa.array(list(x), kind) for x, kind in zip(zip(*rows), kinds, strict=True)] if rows else []
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *made], names=labels)

    return df.mapInArrow(run, schema)


def local_file(path: str) -> str:
    """A vocabulary's path on this machine: as given, or as shipped with SparkContext.addFile."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
