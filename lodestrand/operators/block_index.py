"""Top-k search by score bounds: postings in blocks of documents, of which most are never read.

Documents are dealt to blocks by their length (in classes that differ by a quarter) and a hash of their id. The postings of a
term in a block are one row, and a small table of bounds has, for each, how many they are, their largest
frequency and their least length: what no document of the block can exceed in BM25, whatever the mean length and the number of documents
have become. A search sums these bounds per block, reads the best few blocks for a threshold that k documents reach, and then only
the blocks whose bound reaches it. The rows are those of lexical.bm25_topk.

The corpus's documents and total length, and the documents of each term, are sums that were made when the index was written: a search
reads no length and counts no posting. Indexes add up: the sums of several are the sums of all, and deleted documents are subtracted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.operators import lexical
from lodestrand.operators.lexical_index import BUCKETS, Sums, bucket_of, of_terms

#: Documents of a block, about; and how many of the classes of length are taken to be in use.
BLOCK_DOCS = 128
CLASSES_IN_USE = 8
LENGTH_STEP = 1.25
#: Blocks that are read first, for the threshold.
FIRST_BLOCKS = 32
#: Scores are rounded, and sums of doubles depend on their order: a block this much below the threshold is read too.
MARGIN = 1e-5
#: Files of a bucket at least: a very common term's blocks are spread over them.
LEAST_SPREAD = 2


def block_of(doc_id: Column, length: Column, n_docs: int) -> Column:
    """The block of a document in an index of that many."""
    parts = max(1, -(-n_docs // (BLOCK_DOCS * CLASSES_IN_USE)))
    kind = F.floor(F.log(length + F.lit(1.0)) / F.log(F.lit(LENGTH_STEP))).cast("long")
    return kind * F.lit(1 << 32) + F.pmod(F.xxhash64(doc_id), F.lit(parts))


def blocks_of(docs: DataFrame, n_docs: int, doc_id: str = "doc_id", text: str = "text", carry: Iterable[str] = ()) -> DataFrame:
    """(bucket, term, block, n, max_tf, min_length, sum_tf, docs), docs: structs of doc_id, length, tf and the carried columns.

    One shuffle, by the bucket and a part of the blocks; a group is the postings of a term in a block."""
    carry = list(carry)
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = max(LEAST_SPREAD, -(-tasks // BUCKETS))
    rows = lexical.postings(docs, doc_id, text, carry=carry).withColumn("block", block_of(F.col("doc_id"), F.col("length"), n_docs))
    rows = rows.select(bucket_of(F.col("term")).alias("bucket"), F.pmod(F.xxhash64("block"), F.lit(spread)).alias("spread"), "term", "block", F.struct("doc_id", "length", "tf", *carry).alias("doc"))
    groups = rows.repartition(tasks, "bucket", "spread").groupBy("bucket", "spread", "term", "block")
    made = groups.agg(
        F.count("*").alias("n"), F.max("doc.tf").alias("max_tf"), F.min("doc.length").alias("min_length"), F.sum("doc.tf").alias("sum_tf"), F.collect_list("doc").alias("docs")
    )
    return made.drop("spread")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """A folder per bucket, its files sorted by term: a search reads the row groups of its terms."""
    blocks.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(path)


def bounds_of(blocks: DataFrame) -> DataFrame:
    """What a search looks at before it reads a block; blocks: as stored, so that their documents are not read."""
    return blocks.select("bucket", "term", "block", "n", "max_tf", "min_length").repartition("bucket")


def totals_of(blocks: DataFrame, n_docs: int) -> DataFrame:
    """One row (n_docs, total_length): a document's length is the sum of its frequencies."""
    return blocks.agg(F.lit(n_docs).cast("long").alias("n_docs"), F.coalesce(F.sum("sum_tf"), F.lit(0)).cast("long").alias("total_length"))


def terms_of(bounds: DataFrame) -> DataFrame:
    """(bucket, term, df)"""
    return bounds.groupBy("bucket", "term").agg(F.sum("n").cast("long").alias("df"))


@dataclass
class BlockIndex:
    """blocks, bounds and sums may hold the rows of several indexes, whose blocks differ.

    live: what leaves out deleted documents from rows that have the columns of `kept` and the carried ones."""

    blocks: DataFrame
    bounds: DataFrame
    sums: Sums
    live: Callable[[DataFrame], DataFrame] = lambda rows: rows
    kept: tuple[str, ...] = ()

    @classmethod
    def write(cls, docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", carry: Iterable[str] = ()) -> BlockIndex:
        spark, n = docs.sparkSession, docs.count()
        own = blocks_of(docs, n, doc_id, text, carry)
        write_blocks(own, f"{path}/blocks")
        blocks = spark.read.schema(own.schema).parquet(f"{path}/blocks")
        made = {"bounds": bounds_of(blocks), "totals": totals_of(blocks, n)}
        write_blocks(made["bounds"], f"{path}/bounds")
        made["totals"].coalesce(1).write.parquet(f"{path}/totals")
        read = {name: spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in made.items()}
        return cls(blocks, read["bounds"], Sums(read["totals"], terms_of(read["bounds"])))

    # One query

    @staticmethod
    def _weights(times: dict[str, int], n: int, average: float, held: dict[str, int], tf: Column, length: Column) -> Column:
        """A row's weight, by its term."""
        out = F.lit(0.0)
        for t in sorted(times, reverse=True):
            own = F.lit(float(times[t])) * lexical.idf(F.lit(n), F.lit(held[t])) * lexical.weight(tf, length, F.lit(average))
            out = F.when(F.col("term") == t, own).otherwise(out)
        return out

    def bounded(self, query: str) -> DataFrame:
        """(block, bound) of the blocks that hold a word of the query."""
        times = Counter(lexical.query_terms(query))
        names = sorted(times)
        w = self._weights(times, *self.sums.facts(names), F.col("max_tf"), F.col("min_length"))
        return of_terms(self.bounds, names).groupBy("block").agg(F.sum(w).alias("bound"))

    def _scored(self, times: dict[str, int], facts: tuple, rows: DataFrame, digits: int | None) -> DataFrame:
        """(doc_id, score) of the documents in rows of blocks."""
        docs = self.live(rows.select("term", *self.kept, F.inline("docs")))
        w = self._weights(times, *facts, F.col("tf"), F.col("length"))
        # A sum in the terms' order, so that it does not depend on that of the rows.
        parts = docs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", w.alias("w")))).alias("parts"))
        score = F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["w"])
        return parts.select("doc_id", (F.round(score, digits) if digits is not None else score).alias("score"))

    def plan(self, query: str, k: int, digits: int | None = 6, facts: tuple | None = None) -> tuple[DataFrame, float]:
        """(the rows of blocks that a search has to read, the threshold): all others are proven to have none of the k best."""
        times = Counter(lexical.query_terms(query))
        names = sorted(times)
        facts = facts or self.sums.facts(names)
        w = self._weights(times, *facts, F.col("max_tf"), F.col("min_length"))
        bounds = of_terms(self.bounds, names).groupBy("block").agg(F.sum(w).alias("bound"))
        first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()]
        mine = of_terms(self.blocks, names)
        best = lexical.top_k(self._scored(times, facts, mine.where(F.col("block").isin(first)), digits), k, "doc_id").collect() if first else []
        least = best[-1].score - MARGIN if len(best) == k else 0.0
        return mine.join(bounds.where(F.col("bound") >= least).select("block"), "block", "left_semi"), least

    def topk(self, query: str, k: int, digits: int | None = 6) -> DataFrame:
        """(doc_id, score) of the k best documents; a term given twice counts twice, equal scores go by id."""
        times = Counter(lexical.query_terms(query))
        if not times or k < 1:
            return self.blocks.select(F.inline("docs")).select("doc_id", F.lit(0.0).alias("score")).limit(0)
        facts = self.sums.facts(sorted(times))
        rows, _ = self.plan(query, k, digits, facts)
        return lexical.top_k(self._scored(times, facts, rows, digits), k, "doc_id")

    # Many queries

    def batch(self, queries: DataFrame, k: int, query_id: str = "query_id", query: str = "query", digits: int = 6) -> DataFrame:
        """(query_id, doc_id, score, rank): the k best documents of each of many queries.

        A query and a block make one row with their bound, not a query and a document. Each query's best blocks give its
        threshold, and postings are joined for the blocks that reach it only."""
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(X.terms(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        words = asked.select(bucket_of(F.col("term")).alias("bucket"), "term").distinct()
        # At most BUCKETS numbers: folders of other buckets are not read.
        own = F.col("bucket").isin([r.bucket for r in words.select("bucket").distinct().collect()])
        n, average = self.sums.corpus
        held = self.sums.terms.where(own).join(words, ["bucket", "term"]).groupBy("bucket", "term").agg(F.sum("df").alias("df"))
        weighted = asked.join(held, "term").select("query_id", "bucket", "term", (F.col("qtf") * lexical.idf(F.lit(n), F.col("df"))).alias("w"))
        most = F.col("w") * lexical.weight(F.col("max_tf"), F.col("min_length"), F.lit(average))
        bounds = self.bounds.where(own).join(weighted, ["bucket", "term"]).groupBy("query_id", "block").agg(F.sum(most).alias("bound"))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        first = bounds.withColumn("number", F.row_number().over(order)).where(F.col("number") <= FIRST_BLOCKS)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")

        def ranked(pairs: DataFrame) -> DataFrame:
            wanted = pairs.select("query_id", "block").join(weighted, "query_id")
            docs = self.live(wanted.join(self.blocks.where(own).select("bucket", "term", "block", "docs", *self.kept), ["bucket", "term", "block"]).select("query_id", "w", *self.kept, F.inline("docs")))
            each = F.col("w") * lexical.weight(F.col("tf"), F.col("length"), F.lit(average))
            scored = docs.groupBy("query_id", "doc_id").agg(F.round(F.sum(each), digits).alias("score"))
            return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

        least = ranked(first).where(F.col("rank") == k).select("query_id", (F.col("score") - F.lit(MARGIN)).alias("least"))
        kept = bounds.join(least, "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)))
        return ranked(kept).select("query_id", "doc_id", "score", "rank")
