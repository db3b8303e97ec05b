"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and items are cut into words (runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased)
and joined by single spaces; a window of item words, with a space at both ends, is a pattern. A
block shift table skips positions where no pattern can end, suffix-hash buckets name the few
patterns that may end at the others, and a direct comparison confirms each occurrence.

Defined results: a null or empty text has no words and no hits; an item without words has no
window; an item with a null item_id is searched for like all others, so words in its windows are hit and their document is
contaminated, but it has no id to count or to list; items with equal windows all count; repeated rows each get their own
result; an empty table gives an empty result; an empty benchmark gives no hits. Extra columns are
left alone.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm import common

WINDOW_WORDS = 10
#: Bytes of item text that one pass over the documents searches for; a larger benchmark takes more passes.
BLOCK_BYTES = 8 << 20

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if x in _KEEP else 32 for x in range(256))


def words(raw: bytes | None) -> list[bytes]:
    return raw.translate(_TABLE).split() if raw else []


def windows(item: list[bytes], size: int = WINDOW_WORDS) -> list[bytes]:
    """An item's windows as patterns; an item shorter than a window is one."""
    return [b" " + b" ".join(item[k : k + size]) + b" " for k in range(max(1, len(item) - size + 1))] if item else []


class WuManber:
    """The tables for patterns whose lengths lie within a factor of two of each other."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        #: Blocks long enough that few blocks of an ordinary text are among the patterns'.
        self.block = block = min(m, max(2, math.ceil(math.log(2 * m * len(patterns), 8)) + 1))
        self.skip = m - block + 1
        shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, list[bytes]]] = {}
        for pattern in patterns:
            for end in range(block, m + 1):
                key = pattern[end - block : end]
                if m - end < shift.get(key, self.skip):
                    shift[key] = m - end
            self.bucket.setdefault(pattern[m - block : m], {}).setdefault(pattern[:block], []).append(pattern)
        self.shift = shift

    def find(self, text: bytes, found: list[tuple[int, bytes]]) -> None:
        """Append (start, pattern) of every occurrence."""
        m, block, skip, shift = self.m, self.block, self.skip, self.shift.get
        end, size = m, len(text)
        while end <= size:
            key = text[end - block : end]
            step = shift(key, skip)
            if step:
                end += step
                continue
            start = end - m
            for pattern in self.bucket[key].get(text[start : start + block], ()):
                if text.startswith(pattern, start):
                    found.append((start, pattern))
            end += 1


class Matcher:
    """All windows of a block of items: Wu-Manber tables by classes of pattern length."""

    def __init__(self, items: Iterable[tuple[str | None, bytes | None]], size: int = WINDOW_WORDS):
        self.owners: dict[bytes, set[str]] = defaultdict(set)
        for name, raw in items:
            for pattern in windows(words(raw), size):
                self.owners[pattern].update(() if name is None else (name,))
        classes: dict[int, list[bytes]] = defaultdict(list)
        for pattern in self.owners:
            classes[len(pattern).bit_length()].append(pattern)
        self.tables = [WuManber(x) for _, x in sorted(classes.items())]

    def search(self, raw: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words; merged ranges [first, end) of the words that windows cover; items."""
        parts = words(raw)
        text = b" " + b" ".join(parts) + b" "
        found: list[tuple[int, bytes]] = []
        for table in self.tables:
            table.find(text, found)
        if not found:
            return len(parts), [], set()
        spaces = np.cumsum(np.frombuffer(text, np.uint8) == 32)
        spans, items = [], set()
        for start, pattern in found:
            first = int(spaces[start]) - 1
            spans.append((first, first + pattern.count(b" ") - 1))
            items |= self.owners[pattern]
        return len(parts), merged(spans), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges, as disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


HITS = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("items", T.ArrayType(T.StringType()))]
)


def find_overlaps(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW_WORDS, prefix: str = "") -> DataFrame:
    """docs with n_words, spans (word ranges that item windows cover) and items (ids as strings).

    Items are the query set: they are searched in blocks of about BLOCK_BYTES, one pass over the
    documents' rows for each, chained in the same task; nothing is shuffled. Columns that have the
    added names (prefix before each) must not be in docs."""
    spark = common.prepare(docs.sparkSession)
    queries = items.select(F.col(item_id).cast("string").alias("id"), common.utf8(item_text).alias("raw")).where("raw is not null")
    total = queries.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    added = T.StructType([T.StructField(prefix + f.name, f.dataType) for f in HITS])
    for k in range(blocks):
        # An item is at most 2 GB; a block holds BLOCK_BYTES on average, whatever the benchmark's size.
        rows = queries.where(F.pmod(F.xxhash64("id", "raw"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast([(r.id, bytes(r.raw)) for r in rows])
        if k == 0:
            docs = common.append_columns(docs, text, _searcher(shared, size), added)
        else:
            other = T.StructType([T.StructField(f"{prefix}{f.name}_{k}", f.dataType) for f in HITS])
            docs = _joined(common.append_columns(docs, text, _searcher(shared, size), other), prefix, k)
    return docs


def _searcher(shared, size: int) -> Callable:
    def make() -> Callable[[list], Iterable[tuple]]:
        matcher = Matcher(shared.value, size)

        def work(texts: list) -> Iterable[tuple]:
            for raw in texts:
                n, spans, items = matcher.search(raw)
                yield n, [list(x) for x in spans], sorted(items)

        return work

    return make


def _joined(docs: DataFrame, prefix: str, k: int) -> DataFrame:
    """Take up what pass k has found."""
    both = docs.withColumns(
        {
            f"{prefix}spans": F.array_sort(F.concat(f"{prefix}spans", f"{prefix}spans_{k}")),
            f"{prefix}items": F.array_sort(F.array_union(f"{prefix}items", f"{prefix}items_{k}")),
        }
    )
    return both.drop(*(f"{prefix}{f.name}_{k}" for f in HITS))


def covered(spans: str) -> Column:
    """How many words ordered ranges cover; those of several passes may overlap."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x[1] - F.greatest(x[0], acc["end"]))).cast("long").alias("n"), F.greatest(acc["end"], x[1]).alias("end")
        ),
        lambda acc: acc["n"],
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from those of find_overlaps()."""
    return found.withColumn("n_hit", covered("spans")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", common.utf8("text").alias("text"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return digest(find_overlaps(docs, items).drop("text"))


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", share: float = 0.0) -> DataFrame:
    """The rows of docs of whose words no more than that share lies within item windows, columns unchanged."""
    prefix = "hits_"
    while any(x.lower().startswith(prefix) for x in docs.columns):
        prefix = f"_{prefix}"
    found = find_overlaps(docs, items, text, prefix=prefix)
    return found.where(covered(f"{prefix}spans") <= share * F.col(f"{prefix}n_words")).select(docs.columns)


#: DuckDB: windows of item words joined with windows of as many document words, by equality.
ORACLE = """
WITH dw AS (
  SELECT rowid AS row_no, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM win), places AS (
  SELECT row_no, size, k, array_to_string(w[k : k + size - 1], ' ') AS win
  FROM (SELECT row_no, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM dw, sizes WHERE len(w) >= size)
), hits AS (SELECT p.row_no, p.size, p.k, win.item FROM places p JOIN win ON p.size = win.size AND p.win = win.win),
covered AS (SELECT row_no, count(DISTINCT pos) AS n FROM (SELECT row_no, unnest(range(k, k + size)) AS pos FROM hits) GROUP BY row_no),
found AS (SELECT row_no, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered c USING (row_no) LEFT JOIN found f USING (row_no)
"""
