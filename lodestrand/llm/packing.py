"""Packing by power-of-two decomposition.

A document's ids, with the end id, are cut into pieces whose lengths are the powers of two of its
binary length, the longest (at most SEQUENCE) first. Each piece is a sequence: none crosses documents, none is padded, and sequences of one
length form a bucket: a bucket's sequence ids are a range of their own, so ordering by them groups
equal lengths, and write_buckets() lays the ids out by length.

Defined results: null and empty texts are the end id alone; repeated rows are packed one by one; an
empty table gives an empty one; extra columns are not read. A sequence id depends on the input's
partitions: run again over the same files it is the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm import common
from lodestrand.llm.tokens import ROWS, chunked

TOKENIZER = "byte_bpe_50k.json"
END = 0
SEQUENCE = 1024
#: A bucket's sequence ids share their upper bits, its exponent; partition and row number fill the rest.
BUCKET_SHIFT = 58


def pieces(n: int, longest: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; longest is a power of two."""
    out = [(k, longest) for k in range(0, n - longest + 1, longest)]
    at, rest = n - n % longest, n % longest
    for e in range(longest.bit_length() - 2, -1, -1):
        if rest >> e & 1:
            out.append((at, 1 << e))
            at += 1 << e
    return out


SCHEMA = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [T.StructField("ids", T.BinaryType())]
)


def pack(docs: DataFrame, vocabulary: str, end: int = END, longest: int = SEQUENCE, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if
    asked for, ids (little-endian unsigned 16-bit numbers). There is no shuffle."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.utf8(text).alias("text"))
    schema = SCHEMA if with_ids else T.StructType(SCHEMA.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunked(vocabulary, False, "<u2")
        tail = np.array([end], "<u2").tobytes()
        for part in common.slices(batches, 1, rows=ROWS):
            coded = coder.encode([common.text_of(x) for x in common.as_bytes(part.column(1))])
            own, start, length, crc, tokens, held = [], [], [], [], [], []
            for k, ids in enumerate(coded):
                ids += tail
                wide = memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                n = len(ids) // 2
                for at, size in pieces(n, longest):
                    own.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(wide[4 * at : 4 * (at + size)]))
                    tokens.append(n)
                    if with_ids:
                        held.append(ids[2 * at : 2 * (at + size)])
            columns = [part.column(0).take(pa.array(own, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(held, pa.binary())] * with_ids, names=schema.names)

    packed = rows.mapInArrow(run, schema)
    number = F.shiftleft(F.log2("length").cast("long"), BUCKET_SHIFT) + F.monotonically_increasing_id()
    return packed.withColumns({"sequence_id": number, "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences in a folder per length; each file holds equal lengths only. A hot length is
    written by many tasks, as no row is moved."""
    packed.select("length", "sequence_id", "doc_id", "start", "ids").write.partitionBy("length").parquet(path)


def op5_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack(common.documents(spark, sf_dir, "doc_id", "text"), vocabulary or public_tokenizers.path(TOKENIZER), with_ids=False)
