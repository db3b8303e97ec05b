"""Vector search: exact top-k by cosine, inner product or distance, for one query or many.

One query's vector is a literal in the plan. Many queries are broadcast in blocks of a stated size, and a scan of the vectors takes
several blocks at once, with a matrix product per Arrow batch and block; a task keeps its k best per
query over all its batches, so the shuffle carries k rows per query and task, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.functions import vectors as V
from lodestrand.shipping import ship

METRICS = {"cosine": (V.cosine, True), "ip": (V.inner_product, True), "l2": (V.l2, False)}
#: Queries of a block, and blocks that one scan of the vectors takes.
QUERY_BLOCK = 2048
BLOCKS_A_SCAN = 16
#: Rows whose scores with a block of queries a task holds at once.
ROWS_AT_ONCE = 512


def top_k(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", vector_id: str = "vec_id", vector: str = "embedding", digits: int | None = 6) -> DataFrame:
    """(vec_id, score) of the k best rows; equal scores by id. Rows without a distance are left out."""
    measure, falling = METRICS[metric]
    value = measure(F.col(vector), F.array(*(F.lit(float(x)) for x in query)).cast("array<double>"))
    scored = vectors.select(F.col(vector_id).alias("vec_id"), (F.round(value, digits) if digits is not None else value).alias("score")).where("score is not null")
    order = F.col("score").desc() if falling else F.col("score").asc()
    return scored.orderBy(order, "vec_id").limit(k)


def _scores(matrix: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        squares = (matrix**2).sum(1)[:, None] + (queries**2).sum(1)[None, :] - 2 * matrix @ queries.T
        return -np.sqrt(np.maximum(squares, 0))
    products = matrix @ queries.T
    if metric == "ip":
        return products
    norms = np.linalg.norm(matrix, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
    return np.divide(products, norms, out=np.zeros_like(products), where=norms > 0)


HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def batch_top_k(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", query_id: str = "query_id", vector_id: str = "vec_id", vector: str = "embedding", digits: int = 6
) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k best rows for each query vector. queries: (query_id, embedding).

    Vectors of other lengths than a query's score 0 (and have no distance)."""
    spark = vectors.sparkSession
    ship(spark)
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).alias("embedding")).where("query_id is not null and embedding is not null")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    rows = vectors.select(F.col(vector_id).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    hits = None
    for first in range(0, blocks, BLOCKS_A_SCAN):
        held = []
        for b in range(first, min(first + BLOCKS_A_SCAN, blocks)):
            groups: dict[int, tuple[list[int], list[list[float]]]] = {}
            for r in asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect():
                names, values = groups.setdefault(len(r.embedding), ([], []))
                names.append(r.query_id)
                values.append(r.embedding)
            held.append(spark.sparkContext.broadcast([(np.array(i), np.array(v, float)) for i, v in groups.values()]))
        own = rows.mapInArrow(_searcher(held, k, metric, digits), HITS)
        hits = own if hits is None else hits.unionAll(own)
    order = F.col("score").desc() if METRICS[metric][1] else F.col("score").asc()
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))).where(F.col("rank") <= k)


class Best:
    """The k best rows of each of some queries, over all batches of a task."""

    def __init__(self, names: np.ndarray, k: int):
        self.names, self.k = names, k
        #: What a row must reach to be among a query's k best so far.
        self.least = np.full(len(names), -np.inf)
        self.query, self.ids, self.scores = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row per query, a column per id; the greater the better."""
        n = len(ids)
        if not n or not self.k:
            return
        # A vector that is not a number anywhere is no hit.
        scores = np.where(np.isnan(scores), -np.inf, scores)
        reach = np.maximum(self.least, np.partition(scores, n - self.k, axis=1)[:, n - self.k]) if n > self.k else self.least
        at, column = np.nonzero((scores >= reach[:, None]) & (scores > -np.inf))
        query, found, values = np.concatenate([self.query, at]), np.concatenate([self.ids, ids[column]]), np.concatenate([self.scores, scores[at, column]])
        order = np.lexsort((found, -values, query))
        query, found, values = query[order], found[order], values[order]
        starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, int)
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        kept = place < self.k
        self.query, self.ids, self.scores = query[kept], found[kept], values[kept]
        last = place == self.k - 1
        self.least[query[last]] = values[last]

    def batch(self, sign: float) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.names[self.query]), pa.array(self.ids), pa.array(sign * self.scores + 0.0)], names=HITS.names)


def _searcher(held: list, k: int, metric: str, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {(b, g): Best(names, k) for b, shared in enumerate(held) for g, (names, _) in enumerate(shared.value)}
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            names = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            # A length's rows become a matrix once, for all blocks of queries.
            matrices: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for (b, g), own in best.items():
                queries = held[b].value[g][1]
                n = queries.shape[1]
                if n not in matrices:
                    same = np.flatnonzero(sizes == n) if n else np.zeros(0, int)
                    flat = lists.take(pa.array(same)).flatten().to_numpy(zero_copy_only=False)
                    matrices[n] = same, flat.astype(float).reshape(len(same), n)
                same, matrix = matrices[n]
                values, places = _scores(matrix, queries, metric), names[same]
                np.round(values, digits, out=values)
                if metric != "l2" and len(same) < len(sizes):
                    values = np.concatenate([values, np.zeros((len(sizes) - len(same), len(own.names)))])
                    places = np.concatenate([places, names[np.setdiff1d(np.arange(len(sizes)), same)]])
                own.add(places, values.T)
        for own in best.values():
            yield own.batch(-1.0 if metric == "l2" else 1.0)

    return run
