"""Reciprocal rank fusion of ranked legs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.config import RRF_OFFSET
from lodestrand.functions import ids
from lodestrand.functions import text as X


def ranked(hits: DataFrame, *keys: str, by: str | None = None, score: str = "score") -> DataFrame:
    """hits with rank, from 1 within each query (or over all hits of one), best first, ties by the key columns.

    A leg of one query is its top k, so the one partition that ranks it is as small."""
    window = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    return hits.withColumn("rank", F.row_number().over(window.orderBy(F.col(score).desc(), *keys)))


def filtered(hits: DataFrame, extensions: Iterable[str], path: str = "relative_path") -> DataFrame:
    wanted = list(extensions)
    return hits.where(X.matches_extension(F.col(path), wanted)) if wanted else hits


def fuse(legs: list[DataFrame], k: int, key: str = "doc_id", by: str | None = None, digits: int | None = 9) -> DataFrame:
    """(key, score, n_legs): sums of 1 / (60 + rank) over the legs' ranked hits, the k best."""
    columns = [key, *([by] if by else [])]
    both = legs[0].select(*columns, "rank")
    for leg in legs[1:]:
        both = both.unionByName(leg.select(*columns, "rank"))
    total = F.sum(F.lit(1.0) / (F.lit(RRF_OFFSET) + F.col("rank")))
    fused = both.groupBy(*columns).agg((F.round(total, digits) if digits is not None else total).alias("score"), F.count("*").cast("int").alias("n_legs"))
    if by is None:
        return fused.orderBy(F.col("score").desc(), key).limit(k)
    best = Window.partitionBy(by).orderBy(F.col("score").desc(), key)
    return fused.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


CHUNK = ["chunk_id", "content", "file_path", "relative_path", "start_line", "end_line", "language"]


def fuse_chunks(semantic: DataFrame, lexical: DataFrame, k: int, extensions: Iterable[str] = (), dedupe: bool = True) -> DataFrame:
    """The k best chunks of two legs of (chunk columns, score), filtered by extension first.

    A chunk that both legs have is one hit, with the attributes of the semantic leg and the first
    file_path that is not empty. dedupe=False keeps the legs' hits apart."""
    key: Column = ids.hit_key(F.col("chunk_id"), F.col("relative_path"), F.col("start_line"), F.col("end_line"), F.col("language"))
    wanted = list(extensions)
    legs = []
    for number, leg in enumerate((semantic, lexical)):
        own = filtered(leg, wanted).withColumn("key", key if dedupe else F.concat(F.lit(f"{number}:"), key))
        legs.append(ranked(own, "key").withColumn("leg", F.lit(number)))
    both = legs[0].unionByName(legs[1])
    first = {c: F.min_by(c, "leg").alias(c) for c in CHUNK if c != "file_path"}
    path = F.coalesce(F.min_by(F.nullif("file_path", F.lit("")), F.when(F.nullif("file_path", F.lit("")).isNotNull(), F.col("leg"))), F.lit(""))
    fused = both.groupBy("key").agg(*first.values(), path.alias("file_path"), F.sum(F.lit(1.0) / (F.lit(RRF_OFFSET) + F.col("rank"))).alias("score"))
    return fused.orderBy(F.round("score", 9).desc(), "key").limit(k).select(*CHUNK, "score")
