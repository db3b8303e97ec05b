"""Token-id files with Elias-Fano coded document boundaries.

A file holds the ids of some documents, one after the other, as an array of 2- or 4-byte numbers, and
two Elias-Fano sequences: the documents' ids and their boundaries in the array. A number's low bits
lie in a packed array, its high bits in a unary bit vector; every SELECT_EVERY-th set bit's place is
noted, so select(i) reads one sample and a few words. A boundary costs about 2 + log2(mean length)
bits and there is no table of 64-bit offsets.

Files are numbered in ascending doc_id order, so a document's global start is the number of ids in
the files before its own and its boundary there.

Defined results: null and empty texts are the end id alone; a null doc_id sorts first; repeated rows
and ties on doc_id are written one by one, ordered by a hash of their texts and then by these; an empty table gives no file and
no row; extra columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm import common
from lodestrand.llm.tokens import ROWS, chunked

TOKENIZER = "word_bpe_49k.json"
END = 1
MAGIC = b"EFIDS\x00\x00\x01"
SELECT_EVERY = 64
#: Bytes of ids after which a partition begins another file.
FILE_BYTES = 24 << 20


class EliasFano:
    """A sequence of numbers that does not fall, coded and with random access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(places[-1]) + 1 if n else 0), np.uint8)
        unary[places] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), places[::SELECT_EVERY].astype("<u4"))

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little")
        return chunk >> (first & 7) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Number i, from one sample on: set bits are counted byte by byte until it is reached."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SELECT_EVERY]), i % SELECT_EVERY
        if left:
            at = place >> 3
            byte = int(self.high[at]) & (0xFF << (place & 7) + 1) & 0xFF
            while (held := byte.bit_count()) < left:
                left -= held
                at += 1
                byte = int(self.high[at])
            for _ in range(left - 1):
                byte &= byte - 1
            place = (at << 3) + (byte & -byte).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (places - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out

    def tobytes(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<QBQQQ", raw, at)
        at += struct.calcsize("<QBQQQ")
        low = np.frombuffer(raw, np.uint8, a, at)
        high = np.frombuffer(raw, np.uint8, b, at + a)
        samples = np.frombuffer(raw, "<u4", c, at + a + b)
        return cls(n, low_bits, low, high, samples), at + a + b + 4 * c


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """A file's content. doc_ids do not fall, nulls first; negative ids are held as distances from the first."""
    known = [x for x in doc_ids if x is not None]
    least = known[0] if known else 0
    names = EliasFano.of(np.array([x - least for x in known], np.uint64))
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(lengths)]))
    head = struct.pack("<8sBQQq", MAGIC, width, len(doc_ids), len(doc_ids) - len(known), least)
    return head + names.tobytes() + bounds.tobytes() + ids


class IdFile:
    """A file that was read: doc_id(i), start(i), ids(i) by select, or everything at once."""

    def __init__(self, raw: bytes):
        view = memoryview(raw)
        magic, self.width, self.n, self.nulls, self.least = struct.unpack_from("<8sBQQq", view, 0)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.names, at = EliasFano.read(view, struct.calcsize("<8sBQQq"))
        self.bounds, at = EliasFano.read(view, at)
        self.array = np.frombuffer(view, f"<u{self.width}", -1, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.names.select(i - self.nulls)

    def start(self, i: int) -> int:
        return self.bounds.select(i)

    def ids(self, i: int) -> np.ndarray:
        return self.array[self.bounds.select(i) : self.bounds.select(i + 1)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.names.all() + self.least).tolist()


def _folder(spark: SparkSession, name: str) -> str:
    """A new shared folder, as a path with its scheme."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(common.scratch(spark, name))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    return files.makeQualified(path).toString()


WRITTEN = T.StructType([T.StructField("file", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end: int, lowered: bool, doc_id: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """Write docs to files in folder, in ascending doc_id order; a row (file, n_docs, n_ids) for each.

    Each attempt of a task writes files of its own, named in the order of their documents. Those of the
    rows that are returned count; what a lost or second attempt has left is not read back."""
    spark = common.prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.utf8(text).alias("text"))
    # Rows that share a doc_id may be many: the text's hash keeps them from one task.
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(max(shards(spark), 1), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunked(vocabulary, lowered, f"<u{width}")
        store, base = fs.FileSystem.from_uri(folder)
        tail = np.array([end], f"<u{width}").tobytes()
        part, number = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, held, size, number
            lengths = [len(x) // width for x in held]
            file = f"ids-{part:07d}-{number:05d}-{uuid.uuid4().hex}.ef"
            with store.open_output_stream(f"{base}/{file}") as out:
                out.write(file_bytes(names, lengths, b"".join(held), width))
            done = pa.RecordBatch.from_arrays([pa.array([file]), pa.array([len(names)], pa.int64()), pa.array([sum(lengths)], pa.int64())], names=WRITTEN.names)
            names, held, size, number = [], [], 0, number + 1
            return done

        for batch in common.slices(batches, 1, rows=ROWS):
            names += batch.column(0).to_pylist()
            for ids in coder.encode([common.text_of(x) for x in common.as_bytes(batch.column(1))]):
                held.append(ids + tail)
                size += len(ids) + len(tail)
            if size >= FILE_BYTES:
                yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, WRITTEN)


def shards(spark: SparkSession) -> int:
    return common.shuffle_partitions(spark)


DIGEST = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
)


def digests(file: IdFile, base: int) -> Iterator[pa.RecordBatch]:
    """DIGEST rows of a file whose first id has the global place base, BATCH_ROWS documents at a time.

    Each boundary is selected once, as the end of its document and the start of the next; there is no table of them."""
    names, end = file.doc_ids(), file.start(0)
    for at in range(0, file.n, common.BATCH_ROWS):
        starts, lengths, crcs = [], [], []
        for i in range(at, min(at + common.BATCH_ROWS, file.n)):
            start, end = end, file.start(i + 1)
            starts.append(base + start)
            lengths.append(end - start)
            crcs.append(zlib.crc32(file.array[start:end].astype("<u4")))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (names[at : at + len(starts)], starts, lengths, crcs)], names=DIGEST.names)


def read_ids(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """A row for each document of the files: doc_id, its global start, its number of ids, their CRC.

    files: (name, number of ids) in name order; a row per FILE_BYTES of ids, not per document."""
    starts, total = {}, 0
    for name, n in files:
        starts[name], total = total, total + n
    shared = spark.sparkContext.broadcast(starts)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ef").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py().rpartition("/")[2]
                if name not in shared.value:
                    continue
                yield from digests(IdFile(batch.column(1)[k].as_buffer()), shared.value[name])

    return found.mapInArrow(run, DIGEST)


def op4_token_id_output(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    folder = _folder(spark, "ids")
    made = write_ids(common.documents(spark, sf_dir, "doc_id", "text"), folder, vocabulary or public_tokenizers.path(TOKENIZER), END, lowered=True)
    return read_ids(spark, folder, sorted((r.file, r.n_ids) for r in made.collect()))
