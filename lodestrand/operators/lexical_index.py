"""A stored inverted index: postings with positions, in buckets of terms and sorted by term.

A search reads the buckets of its terms only, and of those the row groups that may hold them. Lengths
are a table of their own, for queries that may match without a word. Both carry the columns by which rows
may be deleted or filtered. The number of documents, their total length and the documents of each term are sums, stored with the index. Scores are those of lexical.search and lexical.bm25 over the same documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.operators import lexical

#: Folders that the postings are dealt to by a hash of their term.
BUCKETS = 64


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def lengths_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: Iterable[str] = ()) -> DataFrame:
    """(doc_id, length, carried columns) of all documents."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.size(X.terms(F.coalesce(F.col(text), F.lit("")))).alias("length"), *carry)


def postings_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: Iterable[str] = ()) -> DataFrame:
    """(bucket, term, doc_id, length, tf, positions, carried columns)."""
    rows = lexical.postings(docs, doc_id, text, carry=carry)
    return rows.select(bucket_of(F.col("term")).alias("bucket"), "term", "doc_id", "length", "tf", "positions", *carry)


def write_postings(postings: DataFrame, path: str) -> None:
    """By ranges of (bucket, term, doc_id): files are sorted by term, and a very common term spreads over several."""
    order = ("bucket", "term", "doc_id")
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings.repartitionByRange(n, *order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(path)


def totals_of(lengths: DataFrame) -> DataFrame:
    """One row (n_docs, total_length)."""
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_length"))


def terms_of(postings: DataFrame) -> DataFrame:
    """(bucket, term, df)"""
    return postings.groupBy("bucket", "term").agg(F.count("*").alias("df"))


def of_terms(rows: DataFrame, terms: Iterable[str]) -> DataFrame:
    """The rows (bucket, term, ...) of some terms: other buckets are not listed, other terms not read."""
    wanted = sorted(set(terms))
    if not wanted:
        return rows.where(F.lit(False))
    return rows.where(F.col("bucket").isin([bucket_of(F.lit(x)) for x in wanted]) & F.col("term").isin(wanted))


@dataclass
class Sums:
    """What a corpus adds up to. The rows of several indexes are summed, and those of deleted documents are negative."""

    totals: DataFrame
    terms: DataFrame

    @cached_property
    def corpus(self) -> tuple[int, float]:
        """The number of documents and their mean length."""
        n, total = self.totals.agg(F.sum("n_docs"), F.sum("total_length")).first()
        return int(n or 0), float(total or 0) / n if n else 0.0

    def facts(self, names: list[str]) -> tuple[int, float, dict[str, int]]:
        """The corpus, and the documents of each of some terms: a row for each term."""
        held = {r.term: int(r.df) for r in of_terms(self.terms, names).groupBy("term").agg(F.sum("df").alias("df")).collect()} if names else {}
        return *self.corpus, {t: held.get(t, 0) for t in names}

    def row(self, names: list[str]) -> DataFrame:
        """One row: n_docs, avg_length, and d0, d1, ... documents that hold a term."""
        n, average, held = self.facts(names)
        schema = ", ".join(["n_docs long", "avg_length double", *(f"d{k} long" for k in range(len(names)))])
        return self.totals.sparkSession.createDataFrame([(n, average, *(held[t] for t in names))], schema)


@dataclass
class LexicalIndex:
    """sums: as stored; without them, statistics are those of the given lengths and postings."""

    postings: DataFrame
    lengths: DataFrame
    sums: Sums | None = None

    @classmethod
    def write(cls, docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", carry: Iterable[str] = ()) -> LexicalIndex:
        own = postings_of(docs, doc_id, text, carry)
        write_postings(own, f"{path}/postings")
        sizes = lengths_of(docs, doc_id, text, carry)
        sizes.write.parquet(f"{path}/lengths")
        read = docs.sparkSession.read
        postings, lengths = read.schema(own.schema).parquet(f"{path}/postings"), read.schema(sizes.schema).parquet(f"{path}/lengths")
        totals, terms = totals_of(lengths), terms_of(postings)
        totals.write.parquet(f"{path}/totals")
        terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
        return cls(postings, lengths, Sums(read.schema(totals.schema).parquet(f"{path}/totals"), read.schema(terms.schema).parquet(f"{path}/terms")))

    def of_terms(self, terms: Iterable[str]) -> DataFrame:
        return of_terms(self.postings, terms)

    def _stats(self, rows: DataFrame, terms: list[str]) -> DataFrame:
        """One row: n_docs, avg_length, and d0, d1, ... documents that hold a term."""
        if self.sums is not None:
            return self.sums.row(terms)
        found = rows.agg(*(F.count_if(F.col("term") == t).alias(f"d{k}") for k, t in enumerate(terms))) if terms else None
        stats = lexical.corpus_stats(self.lengths)
        return stats if found is None else stats.crossJoin(F.broadcast(found))

    def bm25(self, terms: Iterable[str], digits: int | None = None) -> DataFrame:
        """(doc_id, score) of the documents that hold one of the terms; a term given twice counts twice."""
        times = Counter(terms)
        names = sorted(times)
        rows = self.of_terms(names)
        both = rows.crossJoin(F.broadcast(self._stats(rows, names)))
        total = F.lit(0.0)
        for k, t in enumerate(names):
            own = F.lit(float(times[t])) * lexical.idf(F.col("n_docs"), F.col(f"d{k}")) * lexical.weight(F.col("tf"), F.col("length"), F.col("avg_length"))
            total = F.when(F.col("term") == t, own).otherwise(total)
        # A sum in the terms' order, so that it does not depend on that of the rows.
        parts = both.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", total.alias("w")))).alias("parts"))
        score = F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["w"])
        return parts.select("doc_id", (F.round(score, digits) if digits is not None else score).alias("score"))

    def topk(self, query: str, k: int, digits: int | None = 6) -> DataFrame:
        return lexical.top_k(self.bm25(lexical.query_terms(query), digits), k, "doc_id")

    def _held(self, terms: list[str], rows: DataFrame) -> DataFrame:
        """(doc_id, length, p0, p1, ...): where each term stands in the documents that hold one of them."""
        places = (F.coalesce(F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True), F.array().cast("array<int>")).alias(f"p{k}") for k, t in enumerate(terms))
        return rows.groupBy("doc_id").agg(F.first("length").alias("length"), *places)

    def phrase(self, phrase: str) -> DataFrame:
        """(doc_id, n): the documents in which the phrase's terms stand in a row, and how often."""
        words = lexical.query_terms(phrase)
        names = sorted(set(words))
        held = self._held(names, self.of_terms(names))
        return held.select("doc_id", _count(words, names).alias("n")).where("n > 0")

    def search(self, query: str, k: int, strict: bool = False, digits: int | None = 6) -> DataFrame:
        """(doc_id, score): the k best documents for a query in the grammar, as lexical.search gives them.

        Fields are those that the lengths carry. Only a query that may match without a word of its own reads
        the lengths of other documents too."""
        tree = lexical.parse_query(query, strict)
        own = lexical.leaves(tree)
        names = sorted({w for leaf in lexical.contents(tree) for w in leaf.words})
        rows = self.of_terms(names)
        held = self._held(names, rows)
        carried = [c for c in self.lengths.columns if c != "length"]
        if not lexical.needs_word(tree) or lexical.uses_fields(tree):
            how = "inner" if lexical.needs_word(tree) else "left"
            held = self.lengths.join(held.drop("length"), "doc_id", how)
            empty = F.array().cast("array<int>")
            held = held.withColumns({f"p{i}": F.coalesce(f"p{i}", empty) for i in range(len(names))})
        hit = lexical.matches(tree, lambda words: _count(words, names), carried)
        both = held.where(hit).crossJoin(F.broadcast(self._stats(rows, names)))
        total = F.lit(0.0)
        for leaf in own:
            rare = F.lit(0.0)
            for w in leaf.words:
                rare = rare + lexical.idf(F.col("n_docs"), F.col(f"d{names.index(w)}"))
            tf = _count(leaf.words, names)
            total = total + F.when(tf > 0, F.lit(leaf.boost) * rare * lexical.weight(tf, F.col("length"), F.col("avg_length"))).otherwise(F.lit(0.0))
        return lexical.top_k(both.select("doc_id", (F.round(total, digits) if digits is not None else total).alias("score")), k, "doc_id")


def _count(words: list[str], names: list[str]) -> Column:
    """How often words stand in a row, from the columns of where each stands."""
    if not words:
        return F.lit(0)
    here = F.col(f"p{names.index(words[0])}")
    for j, word in enumerate(words[1:], 1):
        here = F.array_intersect(here, F.transform(F.col(f"p{names.index(word)}"), _before(j)))
    return F.size(here)


def _before(n: int) -> Callable[[Column], Column]:
    return lambda x: x - F.lit(n)
