"""Inverted-file index with product quantization: vector search that reads a part of the rows.

Vectors, scaled to length one, are dealt to cells by their nearest of some centres; what is left after the centre is taken off is
coded by sub-vectors, a byte each, from code books. Centres and books are fitted by k-means on a bounded sample (SAMPLE rows, by a hash of their id); every row is
indexed. Lists are stored in a folder per cell, with each row's code, the length of its coding error, and its vector.

A search ranks the cells for each query and visits the nearest. In a cell, a table of the distances from the query to all code words gives every row's
approximate distance by sums of table entries. Only rows that this leaves in question are scored exactly: with `rerank`, that many
times k of the best; without, all whose distance may be among the k least, as an exact one differs from the approximate one by
no more than the coding error. So without rerank the rows are exactly the best of the visited cells, and those of a full scan if all are visited.

Scores are cosines, rounded before they are ranked; ties go by id. Null ids, vectors that are null, of another length than the first of the sample, zero or with null or
non-finite components are not indexed, and find nothing as queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.operators.vector_search import Best
from lodestrand.shipping import ship

#: Rows that centres and code books are fitted on, about; rounds of k-means.
SAMPLE = 20_000
ROUNDS = 12
#: Sample rows for each centre at least, and centres at most.
ROWS_A_CENTRE = 39
MOST_CELLS = 4096
PARTS = 16
CODES = 256
#: Rows of a list, and queries, that a task looks at together; larger lists and more queries are split.
LIST_ROWS = 32_768
QUERY_ROWS = 4096
#: Pairs of a query and a row whose distances a task holds at once.
PAIRS = 1 << 20
SEED = 5
#: By how much squared distances may lie beyond a bound, for rounded scores.
MARGIN = 4e-6

LISTS = T.StructType(
    [T.StructField("cell", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("code", T.BinaryType()), T.StructField("error", T.FloatType()), T.StructField("vector", T.ArrayType(T.DoubleType()))]
)
ASKED = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("query_id", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)[None], 0)


def k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """k centres of rows; one that loses all its rows moves to a row that is far from its own."""
    centres = rows[rng.choice(len(rows), k, replace=len(rows) < k)].copy()
    for _ in range(rounds):
        far = _distances(rows, centres)
        own = far.argmin(axis=1)
        sizes = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        empty = np.flatnonzero(sizes == 0)[: len(rows)]
        if len(empty):
            centres[empty] = rows[np.argsort(-far[np.arange(len(rows)), own], kind="stable")[: len(empty)]]
    return centres


@dataclass
class Model:
    centres: np.ndarray
    #: (parts, codes, length of a part)
    books: np.ndarray

    @classmethod
    def fit(cls, rows: np.ndarray, cells: int, parts: int) -> Model:
        rng = np.random.default_rng(SEED)
        cells = max(1, min(cells, len(rows) // ROWS_A_CENTRE or 1))
        centres = k_means(rows, cells, rng)
        left = rows - centres[_distances(rows, centres).argmin(axis=1)]
        pieces = cls._pieces(left, parts)
        return cls(centres, np.stack([k_means(pieces[:, m], CODES, rng) for m in range(pieces.shape[1])]))

    @staticmethod
    def _pieces(rows: np.ndarray, parts: int) -> np.ndarray:
        """(rows, parts, length); the last part is filled up with zeros."""
        each = -(-rows.shape[1] // parts)
        return np.pad(rows, ((0, 0), (0, each * parts - rows.shape[1]))).reshape(len(rows), parts, each)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's cell, code and coding error."""
        own = _distances(rows, self.centres).argmin(axis=1)
        pieces = self._pieces(rows - self.centres[own], len(self.books))
        codes = np.stack([_distances(pieces[:, m], book).argmin(axis=1) for m, book in enumerate(self.books)], axis=1)
        made = self.books[np.arange(len(self.books)), codes]
        return own, codes.astype(np.uint8), np.sqrt(((pieces - made) ** 2).sum(axis=(1, 2)))

    def nearest(self, rows: np.ndarray, cells: int) -> np.ndarray:
        """The nearest cells of each row, in order."""
        return np.argsort(_distances(rows, self.centres), axis=1, kind="stable")[:, :cells]

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """What the codes of a cell's rows stand for: products with it give the distances of approximate() for many queries."""
        own = self.books[np.arange(len(self.books)), codes].reshape(len(codes), -1)
        return own[:, : self.centres.shape[1]] + self.centres[cell]

    def approximate(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances from a query to the coded rows of a cell: a table of the query's distances to all code words, summed by code."""
        piece = self._pieces((query - self.centres[cell])[None], len(self.books))[0]
        table = ((piece[:, None] - self.books) ** 2).sum(axis=2)
        return table[np.arange(len(table)), codes].sum(axis=1)


def scaled(lists: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): the vectors that take part, scaled to length one."""
    held = [(k, x) for k, x in enumerate(lists.to_pylist()) if x is not None and len(x) == length and None not in x]
    rows, matrix = np.array([k for k, _ in held], int), np.array([x for _, x in held], float).reshape(len(held), length)
    with np.errstate(all="ignore"):
        most = np.abs(matrix).max(axis=1, initial=0)
        norms = most * np.sqrt(((matrix / most[:, None]) ** 2).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    return rows[good], matrix[good] / norms[good, None]


@dataclass
class IvfPq:
    model: Model
    lists: DataFrame
    #: Rows of each cell.
    sizes: dict[int, int] = field(default_factory=dict)

    @classmethod
    def write(cls, vectors: DataFrame, path: str, vector_id: str = "vec_id", vector: str = "embedding", cells: int | None = None, parts: int = PARTS) -> IvfPq:
        """Fit an index, and write it: the model's numbers as a table, and the lists by cell."""
        spark = vectors.sparkSession
        ship(spark)
        rows = vectors.select(F.col(vector_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id is not null and size(vector) > 0")
        n = rows.count()
        share = F.lit(int(min(1.0, SAMPLE / max(n, 1)) * 1_000_000))
        taken = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).limit(2 * SAMPLE).orderBy("id").toArrow()
        length = max((len(x) for x in taken["vector"].to_pylist()[:1]), default=1)
        _, sample = scaled(taken["vector"].combine_chunks(), length) if taken.num_rows else (None, np.zeros((0, length)))
        if not len(sample):
            sample = np.zeros((1, length))
        model = Model.fit(sample, cells or int(min(np.sqrt(max(n, 1)), MOST_CELLS)), min(parts, length))
        spark.createDataFrame([("centre", k, x.tolist()) for k, x in enumerate(model.centres)] + [("book", m, b.ravel().tolist()) for m, b in enumerate(model.books)], "kind string, number int, values array<double>").coalesce(1).write.parquet(f"{path}/model")
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, matrix = scaled(batch.column(1), length)
                own, codes, errors = shared.value.encode(matrix)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(0).take(pa.array(at)), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(errors.astype(np.float32)), pa.array(list(matrix), pa.list_(pa.float64()))], names=LISTS.names)

        # By ranges of cell and id: a task writes few cells, and a cell of a third of all rows is written by many.
        made = rows.mapInArrow(run, LISTS).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "id")
        made.sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{path}/lists")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> IvfPq:
        """An index that has been written. Goes to the driver: the model, and a number for each cell."""
        held = spark.read.parquet(f"{path}/model").orderBy("kind", "number").collect()
        centres = np.array([r["values"] for r in held if r.kind == "centre"])
        books = [np.array(r["values"]) for r in held if r.kind == "book"]
        model = Model(centres, np.stack([b.reshape(CODES, -1) for b in books]))
        lists = spark.read.schema(LISTS).parquet(f"{path}/lists")
        return cls(model, lists, {r.cell: r["count"] for r in lists.groupBy("cell").count().collect()})

    def probes_for(self, queries: DataFrame, target: float, k: int = 10, most: int = 64) -> int:
        """The least number of cells in which that share of the true neighbours of up to `most` queries lie: their k best by a full search."""
        few = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(most)
        found = self.search(few, k, len(self.model.centres))
        pairs = found.join(self.lists.select(F.col("id").alias("vec_id"), "cell"), "vec_id").select("query_id", "cell").collect()
        asked = few.collect()
        at, matrix = scaled(pa.array([r.embedding for r in asked], pa.list_(pa.float64())), self.model.centres.shape[1])
        order = {asked[k].query_id: np.argsort(x) for k, x in zip(at, self.model.nearest(matrix, len(self.model.centres)), strict=True)}
        places = [int(order[r.query_id][r.cell]) for r in pairs]
        return 1 + int(np.quantile(places, target, method="higher")) if places else 1

    def search(self, queries: DataFrame, k: int, probes: int, rerank: int | None = None, digits: int = 6) -> DataFrame:
        """(query_id, vec_id, score, rank): the k best rows of the `probes` nearest cells of each query (query_id, embedding)."""
        spark, model, sizes = self.lists.sparkSession, self.model, self.sizes
        ship(spark)
        length = model.centres.shape[1]
        shared = spark.sparkContext.broadcast(model)
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")).where("query_id is not null")
        blocks = max(1, -(-asked.count() // QUERY_ROWS))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, matrix = scaled(batch.column(1), length)
                cells = shared.value.nearest(matrix, probes)
                own = np.repeat(np.arange(len(at)), cells.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), batch.column(0).take(pa.array(at[own])), pa.array(list(matrix[own]), pa.list_(pa.float64()))], names=ASKED.names)

        # Large lists have parts, and each part meets each block of queries: all that a task holds is bounded.
        large = {c: -(-n // LIST_ROWS) for c, n in sizes.items() if n > LIST_ROWS}
        parts = F.coalesce(F.create_map(*(F.lit(x) for pair in large.items() for x in pair))[F.col("cell")], F.lit(1)) if large else F.lit(1)
        part = F.pmod(F.xxhash64("id"), parts).cast("int").alias("part")
        every = lambda n, name: F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias(name)
        left = self.lists.select("cell", part, "id", "code", "error", "vector").select("*", every(F.lit(blocks), "block"))
        right = asked.mapInArrow(ask, ASKED).select("*", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).select("*", every(parts, "part"))

        def meet(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(rows) and len(asks):
                cell, ids = int(rows["cell"].iloc[0]), rows["id"].to_numpy()
                codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
                errors, vectors = rows["error"].to_numpy().astype(float) + 1e-6, np.stack(rows["vector"])
                made = shared.value.decode(cell, codes)
                squares, m = (made**2).sum(axis=1), min(k, len(rows))
                names, asked_for = asks["query_id"].to_numpy(), np.stack(asks["vector"])
                step = max(1, PAIRS // len(rows))
                for at in range(0, len(names), step):
                    part = asked_for[at : at + step]
                    near = np.sqrt(np.maximum((part**2).sum(axis=1)[:, None] - 2 * part @ made.T + squares[None], 0))
                    if rerank is not None:
                        chosen = np.zeros(near.shape, bool)
                        np.put_along_axis(chosen, np.argsort(near, axis=1, kind="stable")[:, : rerank * k], True, axis=1)
                    else:
                        high = np.partition(near + errors, m - 1, axis=1)[:, m - 1 : m]
                        chosen = np.maximum(near - errors, 0) ** 2 <= high**2 + MARGIN
                    some = np.flatnonzero(chosen.any(axis=0))
                    scores = np.round(part @ vectors[some].T, digits) + 0.0
                    scores[~chosen[:, some]] = -np.inf
                    best = Best(names[at : at + step], k)
                    best.add(ids[some], scores)
                    out.append(pd.DataFrame({"query_id": best.names[best.query], "vec_id": best.ids, "score": best.scores}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

        keys = ["cell", "part", "block"]
        hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
