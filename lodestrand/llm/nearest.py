"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors are put on the unit sphere of one more dimension, so that the largest inner product with a query is the smallest distance to
its direction; bands of norms that differ by less than two are scaled each by its own largest norm. A table hashes a place by some
p-stable functions, floor((a.x + b) / width) with normal a, and the values together name a cell. A query visits, in each table, its own cell
and then those beside it, in the order of their estimated success: by the summed squares of the distances to the borders that
a neighbour would have crossed. How many it visits is fitted: the least number that finds TARGET of the true neighbours of SAMPLE queries, which are
searched for among all rows. Everything else covers all rows: each is in each table.

Cells are dealt to shards of about SHARD_ROWS rows; the few that are larger are split. A query goes to a shard once, with the cells that it visits
there; the shard's rows in them are scored exactly, and its best k leave the task. No pair but these is ever made. Queries that
have found fewer than k go to all shards of one table, as all rows then do count.

Defined results: rows with a null id, and vectors null, empty or zero, or with a null or non-finite component, take no part;
repeated rows (same id and vector) are one; of the same vector only its k + 1 smallest ids can be among the nearest and go on; ties go to the smaller id; vectors
of other lengths than a query's are none of its candidates; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm import common

NEAREST = 20
#: Width of a hash function's slots, on the unit sphere, where a function's values have a deviation of one.
WIDTH = 3.0
TABLES = 2
#: Functions of a table: so that its cells hold about this many rows, if all were used alike.
CELL_ROWS = 64
#: Queries whose true neighbours fit the number of visits, the share of these to be found, and the most visits a table tries.
SAMPLE = 96
TARGET = 0.95
MOST_VISITS = 4096
#: Rows of a shard; with very many rows a ten-thousandth of them, so that no more than TABLES * 10,000 cells are split.
SHARD_ROWS = 8192
SHARDS = 10_000
#: Norms below 2^-BANDS of the largest share a band.
BANDS = 40
SEED = 12

#: A row of a shard: a vector of one cell, or a query and the cells that it visits (none: all).
PLACED = T.StructType([T.StructField("shard", T.LongType()), T.StructField("asked", T.BooleanType()), T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("cells", T.ArrayType(T.LongType()))])
HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("query_hash", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


@dataclass(frozen=True)
class Plan:
    """What all tasks must know to hash alike. split: the parts of cells that are too large for a shard."""

    rows: int
    largest: float
    bands: tuple[int, ...]
    functions: int
    visits: int = 1
    tables: int = TABLES
    width: float = WIDTH
    shards: int = 1
    split: dict[int, int] = field(default_factory=dict)


@lru_cache(maxsize=64)
def _functions(table: int, length: int, number: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The p-stable functions of a table for vectors of a length (and the coordinate added to them)."""
    draw = np.random.default_rng([SEED, table, length])
    # Drawn function by function: more functions begin with the same ones.
    made = [(draw.standard_normal(length + 1), draw.uniform(0, width)) for _ in range(number)]
    return np.array([a for a, _ in made]).T, np.array([b for _, b in made])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, each mixed well."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(values: np.ndarray, table: int, band: np.ndarray | int, length: int) -> np.ndarray:
    """The names of cells, from the functions' values in the last dimension. Cells of the same name by chance are searched as one."""
    out = _mixed(np.uint64(table * 64 + 1) + np.asarray(band, np.int64).astype(np.uint64) * np.uint64(1 << 20) + np.uint64(length << 32) + np.zeros(values.shape[:-1], np.uint64))
    for k in range(values.shape[-1]):
        out = _mixed(out + values[..., k].astype(np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _norms(rows: np.ndarray) -> np.ndarray:
    """Lengths, for large and small components too."""
    most = np.abs(rows).max(axis=1)
    return most * np.sqrt(((rows / most[:, None]) ** 2).sum(axis=1))


def row_cells(rows: np.ndarray, plan: Plan) -> np.ndarray:
    """(rows, tables): the cell of each vector in each table."""
    norms = _norms(rows)
    band = np.clip(np.floor(np.log2(plan.largest / norms)), 0, BANDS).astype(np.int64)
    scaled = rows / (plan.largest * 0.5**band)[:, None]
    rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))
    place = np.concatenate([scaled, rest[:, None]], axis=1)
    out = []
    for t in range(plan.tables):
        a, b = _functions(t, rows.shape[1], plan.functions, plan.width)
        out.append(_cells(np.floor((place @ a + b) / plan.width), t, band, rows.shape[1]))
    return np.stack(out, axis=1)


def visits(inside: np.ndarray, most: int) -> np.ndarray:
    """(visits, functions): steps of -1, 0 or 1 from a query's cell to those that it visits, in the order of their estimated success.

    inside: how far the query lies in its slot of each function, from 0 to 1. A set of steps costs the sum of the squared
    distances to the borders; sets grow from the cheapest by a next step, or by moving their last one on."""
    n = len(inside)
    costs = np.concatenate([inside, 1 - inside]) ** 2
    order = np.argsort(costs, kind="stable")
    cost, step = costs[order].tolist(), [(int(k % n), -1 if k < n else 1) for k in order]
    out = np.zeros((most, n), np.int8)
    found, heap = 1, [(cost[0], (0,))]
    while heap and found < most:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * n:
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
            heapq.heappush(heap, (total + cost[last + 1] - cost[last], (*chosen[:-1], last + 1)))
        if len({step[k][0] for k in chosen}) == len(chosen):
            for k in chosen:
                out[found, step[k][0]] = step[k][1]
            found += 1
    return out[:found]


def query_cells(query: np.ndarray, plan: Plan, most: int | None = None) -> list[np.ndarray]:
    """For each table, the cells that a query visits, in order: (visits, bands)."""
    place = np.append(query / _norms(query[None])[0], 0.0)
    out = []
    for t in range(plan.tables):
        a, b = _functions(t, len(query), plan.functions, plan.width)
        at = (place @ a + b) / plan.width
        own = np.floor(at)
        around = own + visits(at - own, most or plan.visits)
        out.append(np.stack([_cells(around, t, band, len(query)) for band in plan.bands], axis=1))
    return out


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows that take part, in double precision, each once."""
    v = F.col("embedding")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).distinct()


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """rows without those that cannot be among a query's k nearest: of equal vectors, the k + 1 smallest ids stay."""
    same = Window.partitionBy("hash", "embedding").orderBy("vec_id")
    return rows.withColumn("hash", F.xxhash64("embedding")).withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("vec_id", "embedding")


def _matrix(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vectors."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        yield at, flat[starts[at][:, None] + np.arange(length)]


def _best(scores: np.ndarray, vectors: np.ndarray, query: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of a query's k best of some vectors, from scores that a matrix product gave; minus infinity: not one of them.

    A product may differ in its last bits by what it is computed with: those near the k-th are computed anew, row by row."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero((scores >= least - 1e-9 * max(1.0, abs(least))) & (scores > -np.inf)) if least > -np.inf else np.flatnonzero(scores > -np.inf)
    else:
        near = np.flatnonzero(scores > -np.inf)
    exact = (vectors[near] * query).sum(axis=1)
    order = np.lexsort((ids[near], -exact))[:k]
    return ids[near][order], exact[order]


def _truth(rows: DataFrame, sample: list, k: int) -> DataFrame:
    """(query, vec_id, score, embedding) of the k nearest of a bounded number of queries: each task keeps its k best."""
    shared = rows.sparkSession.sparkContext.broadcast([(r.vec_id, np.array(r.embedding)) for r in sample])
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.turn_to(__name__)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            out: list[tuple] = []
            for at, matrix in _matrix(batch.column(1)):
                for q, (own, query) in enumerate(shared.value):
                    if len(query) == matrix.shape[1]:
                        scores = np.where((ids[at] == own) & (matrix == query).all(axis=1), -np.inf, matrix @ query)
                        near = np.argsort(-scores, kind="stable")[:k]
                        out += [(q, int(ids[at][x]), float(scores[x]), matrix[x]) for x in near if scores[x] > -np.inf]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out), (pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())), strict=True)], names=schema.names)

    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return rows.mapInArrow(run, schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def fitted(rows: DataFrame, queries: DataFrame, k: int) -> Plan | None:
    """The plan for these rows; None if there are none. rows, queries: (vec_id, embedding), usable and written.

    Goes to the driver: three numbers of the rows, the numbers of the bands, SAMPLE queries and their k nearest."""
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    norm = most * F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + (x / most) * (x / most)))
    norms = rows.select(norm.alias("norm"))
    n, largest = norms.agg(F.count("*"), F.max("norm")).first()
    if not n:
        return None
    # Rounding may put a norm just above the largest: the functions clip.
    bands = norms.select(F.least(F.greatest(F.floor(F.log2(F.lit(largest) / F.col("norm"))), F.lit(0)), F.lit(BANDS)).alias("b")).distinct().collect()
    near = {b for r in bands for b in (r.b - 1, r.b, r.b + 1) if 0 <= b <= BANDS}
    functions = int(np.clip(round(np.log2(max(n, 1) / CELL_ROWS)), 3, 24))
    plan = Plan(n, float(largest), tuple(sorted(near)), functions)
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    found = _truth(rows, sample, k).select("query", "embedding").collect() if sample else []
    wanted: dict[int, list[np.ndarray]] = {}
    for r in found:
        wanted.setdefault(r["query"], []).append(row_cells(np.array([r.embedding]), plan)[0])
    # The first visit, in any table, that finds a neighbour.
    firsts: list[int] = []
    for q, cells in wanted.items():
        tables = [{int(c): i for i in range(len(x) - 1, -1, -1) for c in x[i]} for x in query_cells(np.array(sample[q].embedding), plan, MOST_VISITS)]
        firsts += [min(t.get(int(c), MOST_VISITS) for t, c in zip(tables, own, strict=True)) for own in cells]
    least = int(np.quantile(firsts, TARGET, method="higher")) + 1 if firsts else 1
    return replace(plan, visits=min(least, MOST_VISITS))


def _sized(rows: DataFrame, plan: Plan) -> Plan:
    """The plan with its shards, and the parts of the cells that are larger than one; these are counted over all rows."""
    held = max(SHARD_ROWS, -(-plan.rows // SHARDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.turn_to(__name__)
        for batch in batches:
            for _, matrix in _matrix(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(row_cells(matrix, plan).ravel())], names=["cell"])

    large = rows.select("embedding").mapInArrow(run, "cell long").groupBy("cell").count().where(F.col("count") > held).collect()
    return replace(plan, shards=max(1, -(-plan.rows // held)), split={r.cell: -(-r["count"] // held) for r in large})


def _shard(cells: np.ndarray, part: np.ndarray, table: int, plan: Plan) -> np.ndarray:
    """A table has shards of its own, so that none holds a vector twice."""
    return table * plan.shards + (_mixed(cells.view(np.uint64) + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(plan.shards)).astype(np.int64)


def _placed(rows: DataFrame, plan: Plan, tables: int) -> DataFrame:
    """The vectors as rows of shards, in the first tables."""
    sizes = np.array(sorted(plan.split), np.int64)
    parts = np.array([plan.split[c] for c in sizes.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.turn_to(__name__)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, matrix in _matrix(batch.column(1)):
                cells = row_cells(matrix, plan)
                own = batch.column(1).take(pa.array(at))
                for t in range(tables):
                    cell = np.ascontiguousarray(cells[:, t])
                    part = np.zeros(len(cell), np.int64)
                    if len(sizes):
                        k = np.minimum(np.searchsorted(sizes, cell), len(sizes) - 1)
                        part = np.where(sizes[k] == cell, (_mixed(ids[at].view(np.uint64)) % parts[k].astype(np.uint64)).astype(np.int64), 0)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1, dtype=np.int32)), pa.array(cell))
                    yield pa.RecordBatch.from_arrays([pa.array(_shard(cell, part, t, plan)), pa.array(np.zeros(len(cell), bool)), pa.array(ids[at]), own, lists], names=PLACED.names)

    return rows.mapInArrow(run, PLACED)


def _asked(queries: DataFrame, plan: Plan) -> DataFrame:
    """The queries as rows of the shards that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.turn_to(__name__)
        for part in common.slices(batches):
            shards, places, lists = [], [], []
            for k, query in enumerate(part.column(1).to_pylist()):
                for t, cells in enumerate(map(np.unique, query_cells(np.array(query), plan))):
                    many = np.array([plan.split.get(c, 1) for c in cells.tolist()], np.int64) if plan.split else np.ones(len(cells), np.int64)
                    each = np.repeat(cells, many)
                    where = _shard(each, np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many), t, plan)
                    order = np.argsort(where, kind="stable")
                    own, starts = np.unique(where[order], return_index=True)
                    shards += own.tolist()
                    places += [k] * len(own)
                    lists += np.split(each[order], starts[1:])
            columns = [pa.array(shards, pa.int64()), pa.array([True] * len(shards)), part.column(0).take(pa.array(places, pa.int64())), part.column(1).take(pa.array(places, pa.int64())), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=PLACED.names)

    return queries.select("vec_id", "embedding").mapInArrow(run, PLACED)


class _Shard:
    """The vectors of a shard, by length and sorted by cell, and the best of them for queries."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if not parts:
            return
        ids, cells = (np.concatenate([f(p).to_numpy() for p in parts]) for f in (lambda p: p.column(2), lambda p: p.column(4).flatten()))
        for at, matrix in _matrix(pa.concat_arrays([p.column(3) for p in parts])):
            order = np.argsort(cells[at], kind="stable")
            self.of[matrix.shape[1]] = (ids[at][order], cells[at][order], matrix[order])

    def search(self, ids: np.ndarray, hashes: np.ndarray, vectors: pa.Array, visited: list[np.ndarray], k: int) -> tuple[list, ...]:
        out: tuple[list, ...] = ([], [], [], [])
        for at, queries in _matrix(vectors):
            if queries.shape[1] not in self.of:
                continue
            own, cells, matrix = self.of[queries.shape[1]]
            names, starts = np.unique(cells, return_index=True)
            ends = np.append(starts[1:], len(cells))
            scores = np.full((len(at), len(own)), -np.inf)
            # Who visits which of the shard's cells.
            asks: dict[int, list[int]] = {}
            for row, x in enumerate(at):
                if not len(visited[x]):
                    scores[row] = matrix @ queries[row]
                    continue
                place = np.minimum(np.searchsorted(names, visited[x]), len(names) - 1)
                for c in place[names[place] == visited[x]].tolist():
                    asks.setdefault(c, []).append(row)
            for c, rows in asks.items():
                scores[rows, starts[c] : ends[c]] = queries[rows] @ matrix[starts[c] : ends[c]].T
            for row, x in enumerate(at):
                same = np.flatnonzero(own == ids[x])
                scores[row, same[(matrix[same] == queries[row]).all(axis=1)]] = -np.inf
                found, values = _best(scores[row], matrix, queries[row], own, k)
                out[0].extend([ids[x]] * len(found))
                out[1].extend([hashes[x]] * len(found))
                out[2].extend(found.tolist())
                out[3].extend(values.tolist())
        return out


#: Queries of a shard that are scored together, and hits that a task holds before it merges those of its shards.
TOGETHER = 256
HELD_HITS = 1 << 19


class _Merged:
    """A task's hits, of all its shards: of each query the k best."""

    def __init__(self, k: int):
        self.k = k
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, found: tuple[list, ...]) -> None:
        self.parts.append([np.array(c, f) for c, f in zip(found, (np.int64, np.int64, np.int64, np.float64), strict=True)])
        self.size += len(found[0])

    def merge(self) -> list[np.ndarray]:
        """What is left of the hits; a row that several tables have found has one score and counts once."""
        query, hashed, ids, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -score, hashed, query))
        query, hashed, ids, score = query[order], hashed[order], ids[order], score[order]
        other = np.concatenate([[True], (query[1:] != query[:-1]) | (hashed[1:] != hashed[:-1])])
        fresh = other | np.concatenate([[True], (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])])
        number = np.cumsum(fresh)
        kept = fresh & (number - number[np.flatnonzero(other)][np.cumsum(other) - 1] < self.k)
        self.parts = [[query[kept], hashed[kept], ids[kept], score[kept]]]
        self.size = int(kept.sum())
        return self.parts[0]

    def batch(self) -> pa.RecordBatch:
        columns = self.merge()
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=HITS.names)


def _searched(placed: DataFrame, k: int) -> DataFrame:
    """Hits of each shard: its vectors come first, and are held; its queries then stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.turn_to(__name__)
        at: int | None = None
        held: list[pa.RecordBatch] = []
        shard: _Shard | None = None
        merged = _Merged(k)
        for batch in batches:
            numbers, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (asked[1:] != asked[:-1])])) if len(numbers) else []
            for start, end in zip(cuts, np.append(cuts[1:], len(numbers)), strict=True):
                if numbers[start] != at:
                    at, held, shard = int(numbers[start]), [], None
                if not asked[start]:
                    held.append(batch.slice(start, end - start))
                    continue
                if shard is None:
                    shard, held = _Shard(held), []
                for s in range(start, end, TOGETHER):
                    part = batch.slice(s, min(TOGETHER, end - s))
                    lists = part.column(4)
                    sizes, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy()
                    visited = np.split(flat, np.cumsum(sizes)[:-1])
                    merged.add(shard.search(part.column(2).to_numpy(), part.column(5).to_numpy(), part.column(3), visited, k))
                    if merged.size >= HELD_HITS:
                        merged.merge()
                        if merged.size >= HELD_HITS // 2:
                            yield merged.batch()
        if merged.parts:
            yield merged.batch()

    rows = placed.withColumn("hash", F.when(F.col("asked"), F.xxhash64("vector")).otherwise(F.lit(0).cast("long")))
    return rows.repartition("shard").sortWithinPartitions("shard", "asked").mapInArrow(run, HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a row that several tables have found has one score and one rank."""
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.dense_rank().over(best)).where(F.col("rank") <= k).dropDuplicates(["query_id", "query_hash", "rank"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, plan: Plan | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, other than itself. vectors, queries: (vec_id, embedding).

    plan: tables that have been fitted before, to the same vectors."""
    spark = vectors.sparkSession
    common.prepare(spark)
    rows = common.written(candidates(usable(vectors), k), "vectors")
    asked = common.written(usable(queries), "queries")
    plan = plan or fitted(rows, asked, k)
    if plan is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plan = _sized(rows, plan)
    found = common.written(_ranked(_searched(_placed(rows, plan, plan.tables).unionAll(_asked(asked, plan)), k), k), "nearest")
    own = asked.withColumn("query_hash", F.xxhash64("embedding"))
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "query_hash")
    rest = common.written(own.join(full, ["vec_id", "query_hash"], "left_anti"), "rest")
    if not rest.isEmpty():
        everywhere = rest.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(plan.shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("asked"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.array().cast("array<long>").alias("cells"))
        exact = _ranked(_searched(_placed(rows, plan, 1).unionAll(everywhere), k), k)
        names = rest.select(F.col("vec_id").alias("query_id"), "query_hash")
        found = found.join(names, ["query_id", "query_hash"], "left_anti").unionByName(exact)
    return found.select("query_id", "rank", "vec_id", "score")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 20, against all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
