"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts with the counts of the bytes that follow them in the training
texts. A byte is coded in its longest context (ORDER bytes); where that has not seen it, an escape is
coded (method D: each follower lends half a count to it), and the next shorter
context is tried without the bytes that the longer ones have already excluded, down to equal chances.
A document's score is the log10 probability of its bytes and an end symbol under the trained trie.

The trie is a table of counts of (context, symbol), sharded by the last three bytes of the context: a
shard holds all its contexts of order 3 and more, and the orders 0 to 2, at most 65536 * 257 counts,
go to every task. Texts are copied to the shared folder in blocks of about BLOCK_BYTES. A block asks
for its distinct (context, symbol) pairs and words only, and gets code lengths and counts back, so no
task holds the trie or the word counts of the corpus, and both grow with it.

Defined results: a null or empty text is the end alone, as a token and as a symbol; a null doc_id
counts as not held out; repeated rows are learned from and scored one by one; an empty table gives an
empty one; extra columns are not read. Texts are lower-cased (A-Z) before anything is counted.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm import common

ORDER = 5
END = 256
SYMBOLS = 257
HELD_OUT = 10
BLOCK_BYTES = 32 << 20
#: Bytes of text whose contexts are made at once; a longer text is cut, with its last ORDER bytes before each part.
RUN_BYTES = 4 << 20
#: Contexts whose probabilities are computed at once, and bytes of packed texts that are read at once.
CONTEXTS = 1024
PACKED_BYTES = 1 << 20
#: Codes that a task gathers from its shards before it scores them; a larger shard is scored whole.
SHARD_CODES = 200_000
SMOOTHING = 0.1
#: How far apart a partition's later blocks are placed.
TURN = 7919
#: The end as a token; no word holds a space.
END_TOKEN = b" "

_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def lowered(raw: bytes | None) -> bytes:
    return (raw or b"").translate(_LOWER)


def tokens(raw: bytes) -> list[bytes]:
    """Words between ASCII white space, and the end."""
    return [*raw.split(), END_TOKEN]


def contexts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes context << 9 | symbol of all positions of lower-cased texts, ends included, in runs of about RUN_BYTES: (codes, where
    each part of a text begins among them, the numbers of those texts). Before its begin a text has zero bytes."""
    parts: list[tuple[bytes, int, int]] = []
    size = 0
    for number, text in enumerate(texts):
        for at in range(0, max(len(text), 1), RUN_BYTES):
            body = text[at : at + RUN_BYTES]
            lead = text[max(0, at - ORDER) : at].rjust(ORDER, b"\0")
            closed = at + RUN_BYTES >= len(text)
            parts.append((lead + body + b"\0" * closed, closed, number))
            size += len(body)
            if size >= RUN_BYTES:
                yield _codes_of(parts)
                parts, size = [], 0
    if parts:
        yield _codes_of(parts)


def _codes_of(parts: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    joined = np.frombuffer(b"".join(x for x, _, _ in parts), np.uint8).astype(np.uint64)
    lengths = np.array([len(x) - ORDER for x, _, _ in parts])
    first = np.cumsum(lengths + ORDER) - lengths - ORDER
    context = np.zeros(len(joined) - ORDER, np.uint64)
    for k in range(ORDER):
        context |= joined[k : k + len(context)] << np.uint64(8 * (ORDER - 1 - k))
    codes = context << np.uint64(9) | joined[ORDER:]
    ends = (first + lengths - 1)[[bool(closed) for _, closed, _ in parts]]
    codes[ends] = context[ends] << np.uint64(9) | np.uint64(END)
    inside = np.ones(len(codes), bool)
    for k in range(1, ORDER + 1):
        inside[first[1:] - k] = False
    return codes[inside], np.cumsum(lengths) - lengths, np.array([n for _, _, n in parts])


def counted(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with their (summed) counts."""
    if counts is None:
        codes = np.sort(codes)
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        return codes[starts], np.diff(np.append(starts, len(codes)))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def chances(levels: list[np.ndarray]) -> np.ndarray:
    """Probabilities of all symbols from the counts of contexts of falling order: [n, SYMBOLS] for
    the longest, and [SYMBOLS] or [n, SYMBOLS] for the others."""
    n = len(levels[0])
    out, escape = np.zeros((n, SYMBOLS)), np.ones((n, 1))
    excluded = np.zeros((n, SYMBOLS), bool)
    for counts in levels:
        left = np.where(excluded, 0, counts)
        kinds = (left > 0).sum(1, keepdims=True)
        total = 2 * left.sum(1, keepdims=True)
        seen = total > 0
        share = escape / np.where(seen, total, 1)
        out += share * np.maximum(2 * left - 1, 0)
        escape = np.where(seen, share * kinds, escape)
        excluded |= counts > 0
    rest = (~excluded).sum(1, keepdims=True)
    return out + ~excluded * (escape / np.maximum(rest, 1))


class Followers:
    """Counts of (context, symbol) codes, in order: a sparse matrix of contexts and symbols."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.counts = counted(codes, counts)

    def rows(self, names: np.ndarray) -> np.ndarray:
        """[n, SYMBOLS] counts of n different contexts."""
        first = np.searchsorted(self.codes, names << np.uint64(9))
        sizes = np.searchsorted(self.codes, (names + np.uint64(1)) << np.uint64(9)) - first
        place = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out = np.zeros((len(names), SYMBOLS))
        out[np.repeat(np.arange(len(names)), sizes), (self.codes[place] & np.uint64(511)).astype(np.int64)] = self.counts[place]
        return out


class ShortContexts:
    """Counts of the orders 2, 1 and 0, which all shards share."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.pairs = Followers(codes, counts)
        order1 = np.zeros((256, SYMBOLS))
        np.add.at(order1, ((codes >> np.uint64(9) & np.uint64(255)).astype(np.int64), (codes & np.uint64(511)).astype(np.int64)), counts)
        self.order1, self.order0 = order1, order1.sum(0)


def _suffix(context: np.ndarray, order: int) -> np.ndarray:
    return context & np.uint64((1 << 8 * order) - 1)


def shard_scores(codes: np.ndarray, counts: np.ndarray, short: ShortContexts) -> np.ndarray:
    """log10 probabilities of whole shards' codes: all codes whose contexts end in the same three bytes are here or none."""
    context, symbol = codes >> np.uint64(9), codes & np.uint64(511)
    own = Followers(codes, counts)
    longer = {order: Followers(_suffix(context, order) << np.uint64(9) | symbol, counts) for order in range(ORDER - 1, 2, -1)}
    names, row = np.unique(context, return_inverse=True)
    # In the order of their last bytes, contexts that share shorter ones are neighbours.
    turned = sum((names >> np.uint64(8 * k) & np.uint64(255)) << np.uint64(8 * (ORDER - 1 - k)) for k in range(ORDER))
    order = np.argsort(turned)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    rank = np.argsort(place[row], kind="stable")
    bounds = np.append(np.searchsorted(place[row][rank], np.arange(len(names))), len(row))
    out = np.empty(len(codes))

    def level(source: Followers, of: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(of, return_inverse=True)
        return source.rows(distinct)[at]

    for a in range(0, len(names), CONTEXTS):
        b = min(a + CONTEXTS, len(names))
        part, mine = names[order[a:b]], rank[bounds[a] : bounds[b]]
        levels = [level(own, part), *(level(longer[k], _suffix(part, k)) for k in sorted(longer, reverse=True)), level(short.pairs, _suffix(part, 2))]
        p = chances([*levels, short.order1[(part & np.uint64(255)).astype(np.int64)], short.order0])
        out[mine] = np.log10(p[place[row[mine]] - a, symbol[mine].astype(np.int64)])
    return out


class Lookup:
    """Values by code: a table of slots with linear probing, filled and read by whole arrays."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        bits = max(1, (2 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, self.EMPTY), np.zeros(1 << bits, values.dtype)
        slot = self._slot(codes)
        while len(codes):
            free = self.keys[slot] == self.EMPTY
            self.keys[slot[free]] = codes[free]
            won = self.keys[slot] == codes
            self.values[slot[won]] = values[won]
            codes, values, slot = codes[~won], values[~won], (slot[~won] + np.uint64(1)) & self.mask

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return codes * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def get(self, codes: np.ndarray) -> np.ndarray:
        """The values of codes that are all in the table."""
        slot = self._slot(codes)
        out = self.values[slot]
        rest = np.flatnonzero(self.keys[slot] != codes)
        slot = slot[rest]
        while len(rest):
            slot = (slot + np.uint64(1)) & self.mask
            out[rest] = self.values[slot]
            missed = self.keys[slot] != codes[rest]
            rest, slot = rest[missed], slot[missed]
        return out


def held_out(doc_id: Column, parts: int = HELD_OUT) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == 0, F.lit(False))


COPY = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("text", T.BinaryType()), T.StructField("block", T.LongType())]
)


def _blocked(docs: DataFrame, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    """A copy of the lower-cased texts, compressed one by one, with block numbers; a block is a run of rows of one partition."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), common.utf8(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        pack = zstandard.ZstdCompressor(level=1).compress
        for part in common.slices(batches, 2):
            texts = [lowered(x) for x in common.as_bytes(part.column(2))]
            if size > block_bytes:
                block, size = block + 1, 0
            size += sum(map(len, texts))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(map(pack, texts)), pa.binary()), pa.array([block] * len(texts), pa.int64())], names=COPY.names)

    spark = docs.sparkSession
    path = common.scratch(spark, "texts")
    rows.mapInArrow(run, COPY).write.option("compression", "none").parquet(path)
    return spark.read.schema(COPY).parquet(path)


def unpacked(texts: list[bytes]) -> list[bytes]:
    return list(map(zstandard.ZstdDecompressor().decompress, texts))


WORDS = T.StructType([T.StructField("block", T.LongType()), T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])
CODES = T.StructType([T.StructField("block", T.LongType()), T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[list[bool], list[bytes]]]]]:
    """A partition's slices, grouped by runs of one block."""
    block, held = None, []
    for part in common.slices(batches, 1, PACKED_BYTES):
        numbers = part.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if numbers[a] != block and held:
                yield block, iter(held)
                held = []
            block = int(numbers[a])
            held.append((part.column(0).slice(a, b - a).to_pylist(), part.column(1).slice(a, b - a).to_pylist()))
    if held:
        yield block, iter(held)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's distinct tokens with their counts in training texts."""
    for block, parts in _blocks_of(batches):
        counts: Counter[bytes] = Counter()
        for held, texts in parts:
            for out, raw in zip(held, unpacked(texts), strict=True):
                if out:
                    for word in tokens(raw):
                        counts.setdefault(word, 0)
                else:
                    counts.update(tokens(raw))
        yield from _batches(block, list(counts), list(counts.values()))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's distinct (context, symbol) codes with their counts in training texts."""
    for block, parts in _blocks_of(batches):
        found, counts = [], []
        for held, texts in parts:
            raw = unpacked(texts)
            for learns in (True, False):
                for run, _, _ in contexts([x for out, x in zip(held, raw, strict=True) if out != learns]):
                    codes, n = counted(run)
                    found.append(codes)
                    counts.append(n if learns else np.zeros_like(n))
            if len(found) > 32:
                codes, n = counted(np.concatenate(found), np.concatenate(counts))
                found, counts = [codes], [n]
        codes, n = counted(np.concatenate(found), np.concatenate(counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), block)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=CODES.names)


def _batches(block: int, words: list[bytes], counts: list[int], size: int = 100_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(words), size):
        own = words[k : k + size]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.int64()), pa.array(own, pa.binary()), pa.array(counts[k : k + size], pa.int64())], names=WORDS.names)


SCORES = T.StructType([T.StructField("code", T.LongType()), T.StructField("score", T.DoubleType())])


def trie_scores(codes: DataFrame) -> DataFrame:
    """(code, score): the log10 probability of each distinct code, by shards of the trie."""
    # At most 65536 * 257 rows, whatever the corpus, and far fewer where it is text.
    table = codes.where("n > 0").groupBy(F.col("code").bitwiseAND(F.lit((1 << 25) - 1)).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    shared = codes.sparkSession.sparkContext.broadcast((table["code"].to_numpy().astype(np.uint64), table["n"].to_numpy().astype(float)))
    counts = codes.groupBy("code").agg(F.sum("n").alias("n")).withColumn("shard", F.shiftright("code", 9).bitwiseAND(F.lit((1 << 24) - 1)))
    dealt = counts.select("shard", "code", "n").repartition(common.shuffle_partitions(codes.sparkSession), "shard").sortWithinPartitions("shard")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = ShortContexts(*shared.value)

        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            own = rows["code"].to_numpy()
            found = shard_scores(own.astype(np.uint64), rows["n"].to_numpy().astype(float), short) if len(own) else np.zeros(0)
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(found)], names=SCORES.names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            # Whole shards are scored together, as soon as there are SHARD_CODES codes.
            if sum(x.num_rows for x in held) >= SHARD_CODES and len(shards):
                cut = int(np.searchsorted(shards, held[-1].column(0)[-1].as_py(), side="right"))
                if cut < len(shards):
                    yield done([*held, batch.slice(0, cut)])
                    held, batch = [], batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
        if held:
            yield done(held)

    return dealt.mapInArrow(score, SCORES)


SCORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("logs", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' sums; a block's codes come first, then its words, then its texts."""
    block = None
    codes: list[np.ndarray] = []
    scores: list[np.ndarray] = []
    logs: dict[bytes, float] = {}
    table: Lookup | None = None
    for batch in batches:
        numbers, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if numbers[a] != block:
                block, codes, scores, logs, table = numbers[a], [], [], {}, None
            if kinds[a] == 0:
                codes.append(part.column(2).to_numpy())
                scores.append(part.column(4).to_numpy())
            elif kinds[a] == 1:
                counts = part.column(4).to_numpy() + SMOOTHING
                logs.update(zip(part.column(3).to_pylist(), np.log10(counts).tolist(), strict=True))
            else:
                if table is None:
                    table = Lookup(np.concatenate(codes).astype(np.uint64), np.concatenate(scores))
                    codes, scores = [], []
                for piece in common.slices([part], 3, PACKED_BYTES):
                    yield _sums(piece, table, logs)


def _sums(part: pa.RecordBatch, table: Lookup, logs: dict[bytes, float]) -> pa.RecordBatch:
    texts = unpacked(part.column(3).to_pylist())
    totals = np.zeros(len(texts))
    for codes, starts, owners in contexts(texts):
        np.add.at(totals, owners, np.add.reduceat(table.get(codes), starts))
    n, known, base = [], [], []
    for raw in texts:
        words = tokens(raw)
        own = np.fromiter(map(logs.__getitem__, words), np.float64, len(words))
        n.append(len(own))
        known.append(int((own > 0).sum()))
        base.append(float(own.sum()))
    columns = [part.column(5), part.column(6), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(totals)]
    return pa.RecordBatch.from_arrays(columns, names=SCORED.names)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = common.prepare(docs.sparkSession)
    copy = _blocked(docs, doc_id, text, block_bytes)
    texts = copy.select("held_out", "text", "block")
    # A word has a row per block that holds it: a window over the word gives each row its count, in one shuffle.
    rows = texts.mapInArrow(_words, WORDS)
    own = "PARTITION BY word"
    words = rows.select("block", "word", F.expr(f"sum(n) OVER ({own})").alias("c"), F.expr(f"row_number() OVER ({own} ORDER BY block) = 1").alias("first"))
    words = _kept(words, "words")
    total = words.where("first").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_tokens, kinds = total.n or 0, total.v or 0
    codes = _kept(texts.mapInArrow(_codes, CODES), "codes")
    scores = codes.join(trie_scores(codes), "code").select("block", "code", "score")
    columns = {"block": "long", "kind": "int", "code": "long", "key": "binary", "value": "double", "doc_id": "long", "held_out": "boolean"}

    def shaped(df: DataFrame, **own: Column) -> DataFrame:
        return df.select(*(own.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in columns.items()))

    gathered = (
        shaped(scores, block=F.col("block"), kind=F.lit(0), code=F.col("code"), value=F.col("score"))
        .unionAll(shaped(words, block=F.col("block"), kind=F.lit(1), key=F.col("word"), value=F.col("c")))
        .unionAll(shaped(copy, block=F.col("block"), kind=F.lit(2), key=F.col("text"), doc_id=F.col("doc_id"), held_out=F.col("held_out")))
    )
    # Blocks are numbered by input partition: in turn they fill the tasks evenly, where a hash would not.
    n = common.shuffle_partitions(spark)
    place = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(TURN), F.lit(n)).cast("int")
    placed = gathered.repartitionById(n, place).sortWithinPartitions("block", "kind")
    sums = placed.mapInArrow(_score, SCORED)
    each = math.log10(n_tokens + SMOOTHING * (kinds + 1))
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        "score",
    )


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder, densely."""
    path = common.scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.documents(spark, sf_dir, "doc_id", "text"))
