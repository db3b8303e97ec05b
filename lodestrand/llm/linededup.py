"""Line dedup on levelled sorted runs of line hashes.

A key is a line without the white space at its ends and with A-Z lower-cased. LineRuns holds, for
each key of enough code points, a 128-bit hash, how many documents hold it and the largest of their
ids, in runs: tables in hash buckets, sorted by hash in each bucket. Batches of documents come from the
largest ids down. A batch is merge-joined with the runs as it comes: the keys that none of them has (the anti-join)
are met here for the first time, so the batch's largest id with the key is that of the whole corpus; of the
others the batch adds its count only. The batch's keys are a run of level 0; as soon as a level has
FANOUT runs, they are compacted to one run of the next level by merging them. Buckets and order are the
same in all runs, so neither merging nor joining moves or sorts a run.

A line goes if enough documents hold its key and a document with a larger id does. How many do is known
only when the last batch is in: then the lines are joined with the keys of the merged runs, the
most frequent keys by broadcast, and only documents that may lose a line are shuffled to what they lose.

Defined results: a null or empty text is one empty line, which is too short to drop; a null doc_id
is smaller than any other; rows that share a doc_id are one document for the counts and each get a
result; an empty table gives an empty one. Line ends are "\\n" alone. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm import common

MIN_CHARS = 40
MIN_DOCS = 5
#: Batches that the query makes of its table, and the runs of a level that are merged to one of the next.
BATCHES = 8
FANOUT = 2
#: Ids, those with the smallest hashes, whose quantiles cut the batches: they set batch sizes, not results.
BOUND_IDS = 4096

_SPACE = b" \t\n\x0b\x0c\r"


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key's hash; None where the key is too short."""
    key = line.strip(_SPACE).lower()
    if len(key) < min_chars or not key.isascii() and sum(x & 0xC0 != 0x80 for x in key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _line_hashes(id_column: str, text: str, min_chars: int, kind: T.DataType) -> tuple[Callable, T.StructType]:
    """For mapInArrow: a row (id, hash) for each distinct key of a document row."""
    schema = T.StructType([T.StructField("id", kind), T.StructField("key", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, 1):
            rows, keys = [], []
            for k, raw in enumerate(common.as_bytes(part.column(1))):
                if raw and len(raw) >= min_chars:
                    own = {key_of(x, min_chars) for x in raw.split(b"\n") if len(x) >= min_chars} - {None}
                    keys += own
                    rows += [k] * len(own)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.binary())], names=["id", "key"])

    return run, schema


class LineRuns:
    """The runs, each a bucketed and sorted Parquet table in the shared folder."""

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_chars, self.min_docs, self.fanout = common.prepare(spark), min_chars, min_docs, fanout
        self.buckets = common.shuffle_partitions(spark)
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [x for level in self.levels for x in level]

    def add(self, lines: DataFrame) -> None:
        """Take up a batch's (id, key) rows. No document may be in two batches, and no id greater than one of
        an earlier batch; null is the smallest."""
        own = lines.distinct().groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last"))
        seen = []
        for k, run in enumerate(self.runs()):
            seen.append(f"seen_{k}")
            own = own.join(run.select("key", F.lit(True).alias(seen[-1])), "key", "left")
        new = F.coalesce(*seen, F.lit(False)) == F.lit(False)
        run = own.select("key", "n", F.when(new, F.col("last")).alias("last"))
        # The first run has no other whose buckets it could take over.
        self._place(run if seen else run.repartition(self.buckets, "key"), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(common.bucketed(run, f"lines-{level}", "key", self.buckets))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._place(self._merged(runs), level + 1)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Runs merged two at a time; all but the last pair are written, so that each has buckets."""
        while len(runs) > 2:
            runs = [*runs[2:], common.bucketed(self._pair(*runs[:2]), "lines", "key", self.buckets)]
        return self._pair(*runs) if len(runs) == 2 else runs[0]

    @staticmethod
    def _pair(run: DataFrame, other: DataFrame) -> DataFrame:
        other = other.withColumnsRenamed({"n": "n_other", "last": "last_other"})
        n = F.coalesce("n", F.lit(0)) + F.coalesce("n_other", F.lit(0))
        return run.join(other, "key", "full").select("key", n.alias("n"), F.greatest("last", "last_other").alias("last"))

    def repeated(self) -> DataFrame:
        """(key, n, last) of the keys that enough documents hold, over all runs."""
        return common.written(self._merged(self.runs()).where(F.col("n") >= self.min_docs), "repeated")

    def dropped(self, lines: DataFrame) -> DataFrame:
        """(id, keys): for each document of lines (id, key) the hashes of the lines that it loses."""
        lost = common.hot_join(lines, self.repeated(), "key", "n").where(~F.col("id").eqNullSafe(F.col("last")))
        return lost.groupBy("id").agg(F.collect_set("key").alias("keys"))


def _batch_of(ids: DataFrame, batches: int) -> Column:
    """The number of the batch of column id, from the greatest ids down."""
    sample = ids.select("id").where("id is not null").orderBy(F.xxhash64("id"), "id").limit(BOUND_IDS).collect()
    known = sorted((r.id for r in sample), reverse=True)
    bounds = sorted({known[len(known) * k // batches] for k in range(1, batches)}) if known else []
    below = sum((F.when(F.col("id") < F.lit(x), 1).otherwise(0) for x in bounds), F.lit(0))
    return F.when(F.col("id").isNull(), batches - 1).otherwise(below).cast("int")


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, keys) of the documents of docs that lose lines; docs are taken up in that many batches."""
    runs = LineRuns(docs.sparkSession, min_chars, min_docs)
    run, schema = _line_hashes(doc_id, text, min_chars, docs.schema[doc_id].dataType)
    hashes = docs.select(F.col(doc_id).alias("id"), common.utf8(text).alias("text")).mapInArrow(run, schema)
    lines = common.written(hashes.withColumn("batch", _batch_of(docs.select(F.col(doc_id).alias("id")), batches)), "lines", "batch")
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).select("id", "key"))
    return common.written(runs.dropped(lines.select("id", "key")), "lost")


def without_repeats(raw: bytes | None, lost: set[bytes], min_chars: int = MIN_CHARS) -> tuple[int, int, bytes]:
    """Number of lines, number dropped, the kept lines joined."""
    lines = (raw or b"").split(b"\n")
    if not lost:
        return len(lines), 0, raw or b""
    kept = [x for x in lines if len(x) < min_chars or key_of(x, min_chars) not in lost]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def deduplicated(docs: DataFrame, dropped: DataFrame, doc_id: str, text: str, make: Callable[[Callable], Callable], added: T.StructType, drop: Iterable[str]) -> DataFrame:
    """docs joined with what each document loses; make(row function) gives the columns to add. Documents
    that lose nothing stay where they are, but for the few that a filter of fixed size takes for others."""
    names = docs.columns
    lost, pair, same = common.fresh(names, "lost"), common.fresh(names, "pair"), common.fresh(names, "same")
    may_lose, stay = common.IdFilter(dropped, "id").split(docs, doc_id)
    # The hint keeps small inputs on the plan that large ones take.
    met = may_lose.join(dropped.withColumnsRenamed({"id": same, "keys": lost}).hint("merge"), F.col(doc_id).eqNullSafe(F.col(same)), "left").drop(same)
    marked = stay.withColumn(lost, F.lit(None).cast(met.schema[lost].dataType)).unionByName(met)
    # One binary column for Python: the number of lost keys, the keys, the text.
    packed = F.concat(
        F.encode(F.lpad(F.coalesce(F.size(lost), F.lit(0)).cast("string"), 10, "0"), "utf-8"),
        F.coalesce(F.array_join(F.transform(lost, lambda x: F.hex(x)), ""), F.lit("")).cast("binary"),
        F.coalesce(common.utf8(text), F.lit("").cast("binary")),
    )
    return common.append_columns(marked.withColumn(pair, packed).drop(lost), pair, make, added, [pair, *drop])


def _unpacked(pair: bytes) -> tuple[set[bytes], bytes]:
    n = max(0, int(pair[:10]))
    return {bytes.fromhex(pair[10 + 32 * k : 42 + 32 * k].decode()) for k in range(n)}, pair[10 + 32 * n :]


DIGEST = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")

    def make() -> Callable[[list], Iterable[tuple]]:
        def work(pairs: list) -> Iterable[tuple]:
            for pair in pairs:
                lost, raw = _unpacked(pair)
                n, gone, kept = without_repeats(raw, lost)
                yield n, gone, hashlib.sha256(kept).hexdigest()

        return work

    return deduplicated(docs, dropped_lines(docs), "doc_id", "text", make, DIGEST, ["text"])


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with repeated lines dropped from the texts, and the length column (if any) set anew where
    lines went. Documents that lose no line keep their row as it is, a null text included."""
    names = docs.columns
    gone, kept = common.fresh(names, "gone"), common.fresh(names, "kept")

    def make() -> Callable[[list], Iterable[tuple]]:
        def work(pairs: list) -> Iterable[tuple]:
            for pair in pairs:
                lost, raw = _unpacked(pair)
                _, n, rest = without_repeats(raw, lost, min_chars)
                yield n, rest if n else None

        return work

    added = T.StructType([T.StructField(gone, T.LongType()), T.StructField(kept, T.BinaryType())])
    out = deduplicated(docs, dropped_lines(docs, doc_id, text, min_chars=min_chars, min_docs=min_docs), doc_id, text, make, added, [])
    new = {text: F.when(F.col(gone) > 0, F.col(kept).cast("string")).otherwise(F.col(text))}
    if length and length in names:
        new[length] = F.when(F.col(gone) > 0, F.char_length(F.col(kept).cast("string")).cast(docs.schema[length].dataType)).otherwise(F.col(length))
    return out.withColumns(new).select(names)


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT row_no, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no, doc_id
"""
