"""A graph of nearest neighbours in parts of bounded size, and a beam search over its partitions.

The nodes (vectors, scaled to length one; rows with the same vector are one node) are dealt to parts by a hash of their id. A part has some GROWTH * sqrt(n) nodes of one length, PART at
least and VALUES components at most. Each node has edges to its nearest nodes in its part, which a task finds by matrix products of a piece of the part with all of it; no step compares all
pairs. A part's task holds its vectors and edges.

A search asks all parts. In each it keeps a pool of the best nodes met for each query, its beam. It begins with the best of the nodes that lie on the query's sides of some random hyperplanes;
in each step the best of the beam that have not been looked at give their neighbours, and some of those that have them as neighbours, until all have been looked at. The best of the parts'
pools are a query's hits. Queries are broadcast in blocks of a stated size, and a part's queries may be shared out to several tasks. Before that, some queries are searched with several beams, and
the first beam by which their recall, against all nodes, reaches RECALL is used for all. With n nodes and queries in proportion to them, work grows as n ** 1.5 while parts may grow.

Scores are cosines, rounded before they are ranked; ties go by id. Null ids and vectors that are null, zero, or with null or non-finite components are no nodes
and find nothing; nodes of other lengths than a query's have no score for it; of rows that share an id the first by its vector is the node.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.operators import vector_search
from lodestrand.shipping import ship

DEGREE = 16
#: Nodes of a part: at least, for the square root of all, and components of its vectors at most.
PART = 4096
GROWTH = 40
VALUES = 2**23
#: Groups that are no parts and larger than this are compared in pieces; scores that a task holds at once.
MOST_GROUP = 128
SCORES_AT_ONCE = 2**22
#: The best nodes that a query looks at, at first and for the next trial, trials made at once, and nodes looked at in a step.
BEAM = 96
WIDER = 1.5
TRIALS = 6
LOOKED_AT = 32
#: Where a query begins in a part: the first nodes by a hash, groupings, nodes of a group, about, and those of them that are taken.
ENTRIES = 16
ENTRY_GROUPINGS = 4
LEAF = 512
ENTRIES_A_GROUP = 8
#: Queries of a search that are broadcast at once, and their components; those that a task searches at once, and for each node of the part.
QUERIES_AT_ONCE = 32768
COMPONENTS_AT_ONCE = 2**22
SEARCHED_AT_ONCE = 1024
MET_AT_ONCE = 2**23
#: Tasks of a search for each core, at least.
TASKS_A_CORE = 4
#: Queries that measure the recall, and the recall to reach.
MEASURED = 64
RECALL = 0.95

NODE = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
EDGES = T.StructType([T.StructField("id", T.LongType()), T.StructField("near", T.ArrayType(T.LongType())), T.StructField("score", T.ArrayType(T.FloatType()))])
#: The best nodes of a query, by the beam that found them.
HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])
TRIED = T.StructType([*HITS.fields, T.StructField("beam", T.LongType())])


def scaled(vectors: DataFrame, vector_id: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that can be nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for own, matrix in _by_length(part):
                # Nulls are not numbers here.
                most = np.abs(matrix).max(axis=1)
                good = np.isfinite(most) & (most > 0)
                matrix = matrix[good] / most[good, None]
                matrix = matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None] + 0.0
                yield pa.RecordBatch.from_arrays([own.column(0).filter(pa.array(good)), _lists(np.full(len(matrix), matrix.shape[1]), pa.array(matrix.ravel()))], names=NODE.names)

    rows = vectors.select(F.col(vector_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vector") > 0)).mapInArrow(run, NODE)
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether a row's keys differ from those of the row before."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    return np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])


def _places(starts: np.ndarray) -> np.ndarray:
    """Each row's place since the last start."""
    at = np.arange(len(starts))
    return at - np.maximum.accumulate(np.where(starts, at, 0)) if len(at) else at


def _whole(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by the first column, in batches that end where a key ends; most: or after a multiple of so many of a key's rows."""
    rest = None
    for part in batches:
        if not part.num_rows:
            continue
        rest = part if rest is None else pa.concat_batches([rest, part])
        last = int(np.flatnonzero(_starts(rest.column(0).to_numpy()))[-1])
        if most:
            last += (rest.num_rows - last) // most * most
        if last:
            yield rest.slice(0, last)
            rest = rest.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def _met(members: DataFrame, degree: int, most: int, groups: int | None = None) -> DataFrame:
    """Edges (id, near, score as lists) from members (group, id, vector, least): within each group, every node's nearest that score more than least. A task sorts its rows
    by group, and holds a batch and a piece of a group at a time. groups: if the groups are numbered from 0, how many there are; each has a task then."""

    def nearest(ids: np.ndarray, matrix: np.ndarray, least: np.ndarray) -> tuple:
        first = np.unique(ids, return_index=True)[1]
        if len(first) < len(ids):
            first.sort()
            ids, matrix, least = ids[first], matrix[first], least[first]
        k = min(degree, len(ids) - 1)
        at_once, found = max(1, SCORES_AT_ONCE // len(ids)), []
        for a in range(0, len(ids), at_once):
            scores = matrix[a : a + at_once] @ matrix.T
            rows = np.arange(len(scores))
            scores[rows, a + rows] = -np.inf
            # A copy, as a view would keep all of the piece.
            best = np.argpartition(scores, len(ids) - k, axis=1)[:, len(ids) - k :].copy() if k else np.zeros((len(scores), 0), int)
            found.append((best, np.take_along_axis(scores, best, 1)))
        best, values = (np.concatenate(x) for x in zip(*found, strict=True))
        good = values > least[:, None]
        counts = good.sum(1)
        return ids[counts > 0], counts[counts > 0], ids[best[good]], values[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole(batches, most):
            group, ids, least = (part.column(k).to_numpy() for k in (0, 1, 3))
            sizes, flat = _sizes(part.column(2)), _flat(part.column(2))
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            cuts = np.flatnonzero(_places(_starts(group)) % most == 0)
            out = []
            for a, b in zip(cuts, np.append(cuts[1:], len(ids)), strict=True):
                own = sizes[a:b]
                if own.min() == own.max():
                    out.append(nearest(ids[a:b], flat[bounds[a] : bounds[b]].reshape(b - a, -1), least[a:b]))
                    continue
                for length in np.unique(own):
                    at = a + np.flatnonzero(own == length)
                    out.append(nearest(ids[at], flat[bounds[at][:, None] + np.arange(length)], least[at]))
            names, counts, near, score = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), _lists(counts, pa.array(near, pa.int64())), _lists(counts, pa.array(score.astype(np.float32)))], names=EDGES.names)

    rows = members.select("group", "id", F.col("vector").cast("array<float>").alias("vector"), F.col("least").cast("float").alias("least"))
    dealt = rows.repartitionById(groups, F.col("group").cast("int")) if groups else rows.repartition("group")
    return dealt.sortWithinPartitions("group", F.xxhash64("id"), "id").mapInArrow(run, EDGES)


def _each(lists: DataFrame) -> DataFrame:
    """(id, near, score) of lists, an edge a row."""
    return lists.select("id", F.explode(F.arrays_zip("near", "score")).alias("x")).select("id", "x.near", "x.score")


def _compared(members: DataFrame, degree: int) -> DataFrame:
    """An edge a row from members (group, id, vector): within each group, every node's nearest."""
    return _each(_met(members.withColumn("least", F.lit(float("-inf"))), degree, MOST_GROUP))


def _nearest(lists: DataFrame, degree: int, schema: T.StructType = EDGES) -> DataFrame:
    """One row of each id, the first column: the best of all its lists (others, scores), the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole(batches):
            ids = np.repeat(part.column(0).to_numpy(), _sizes(part.column(1)))
            near, score = _flat(part.column(1)), _flat(part.column(2))
            order = np.lexsort((-score, near, ids))
            order = order[_starts(ids[order], near[order])]
            order = order[np.lexsort((near[order], -score[order], ids[order]))]
            order = order[_places(_starts(ids[order])) < degree]
            first = np.flatnonzero(_starts(ids[order]))
            counts = np.diff(np.append(first, len(order)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[order][first]), _lists(counts, pa.array(near[order])), _lists(counts, pa.array(score[order]))], names=schema.names)

    key = schema.names[0]
    return lists.select(*schema.names).repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _by_length(nodes: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of each length of a batch (id, vector, ...), and their vectors as a matrix."""
    sizes = _sizes(nodes.column(1))
    for length in np.unique(sizes):
        own = nodes.filter(pa.array(sizes == length)) if (sizes != length).any() else nodes
        yield own, _flat(own.column(1)).reshape(own.num_rows, length)


class Part:
    """A part's nodes in a task: their vectors, whom each links to, and groups of nodes by sides of hyperplanes."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, sizes: np.ndarray, near: np.ndarray):
        """sizes, near: how many neighbours each node has, and their ids."""
        self.ids, self.exact, self.matrix = ids, matrix, matrix.astype(np.float32)
        self.links = self._links(sizes, near)
        number = max(0, math.ceil(math.log2(len(ids) / LEAF)))
        rng = np.random.default_rng(matrix.shape[1])
        #: Of each grouping: its hyperplanes, their middle, and the nodes of each group.
        self.groupings = []
        for _ in range(ENTRY_GROUPINGS):
            normals = rng.standard_normal((matrix.shape[1], number)).astype(np.float32)
            middle = np.median(self.matrix @ normals, axis=0)
            self.groupings.append((normals, middle, self._split(self._sides(self.matrix, normals, middle))))

    def _links(self, sizes: np.ndarray, near: np.ndarray) -> np.ndarray:
        """A row of each node: its neighbours, and as many of those that name it as a node has neighbours, by a hash; then -1."""
        order = np.argsort(self.ids)
        row, to = np.repeat(np.arange(len(self.ids)), sizes), order[np.searchsorted(self.ids, near, sorter=order)]
        chance = self.ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort((chance, to))
        order = order[_places(_starts(to[order])) < sizes.max(initial=0)]
        row, to = np.concatenate([row, to[order]]), np.concatenate([to, row[order]])
        row, to = np.divmod(np.unique(row * len(self.ids) + to), len(self.ids))
        place = _places(_starts(row))
        links = np.full((len(self.ids), place.max(initial=-1) + 1), -1, np.int32)
        links[row, place] = to
        return links

    @staticmethod
    def _sides(matrix: np.ndarray, normals: np.ndarray, middle: np.ndarray) -> np.ndarray:
        return (matrix @ normals > middle) @ (1 << np.arange(normals.shape[1]))

    @staticmethod
    def _split(groups: np.ndarray) -> dict[int, np.ndarray]:
        order = np.argsort(groups, kind="stable")
        first = np.flatnonzero(_starts(groups[order]))
        return dict(zip(groups[order[first]].tolist(), np.split(order, first[1:]), strict=True))

    def _entries(self, queries: np.ndarray) -> np.ndarray:
        """Where queries begin, as keys: a query's row times the part's nodes, plus a node."""
        number = len(self.ids)
        keys = [(np.arange(len(queries))[:, None] * number + np.arange(min(ENTRIES, number))).ravel()]
        for normals, middle, inside in self.groupings:
            for group, rows in self._split(self._sides(queries, normals, middle)).items():
                nodes = inside.get(group)
                if nodes is not None:
                    k = min(ENTRIES_A_GROUP, len(nodes))
                    best = np.argpartition(queries[rows] @ self.matrix[nodes].T, len(nodes) - k, axis=1)[:, len(nodes) - k :]
                    keys.append((rows[:, None] * number + nodes[best]).ravel())
        return np.unique(np.concatenate(keys))

    def _scores(self, queries: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The scores of pairs, sorted by query."""
        out, first = np.empty(len(row), np.float32), np.flatnonzero(_starts(row))
        for a, b, r in zip(first.tolist(), [*first[1:].tolist(), len(row)], row[first].tolist(), strict=False):
            np.dot(self.matrix.take(node[a:b], axis=0), queries[r], out=out[a:b])
        return out

    def pools(self, queries: np.ndarray, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries' rows, nodes) of the pools in which all has been looked at; -1 is no node."""
        number, queries = len(self.ids), queries.astype(np.float32)
        if number <= beam:
            yield np.arange(len(queries)), np.tile(np.arange(number), (len(queries), 1))
            return
        active, met, keys = np.arange(len(queries)), np.zeros(len(queries) * number, bool), self._entries(queries)
        nodes, scores, looked = np.zeros((len(queries), 0), int), np.zeros((len(queries), 0), np.float32), np.zeros((len(queries), 0), bool)
        while len(active):
            met[keys] = True
            row, node = keys // number, keys % number
            value, at = self._scores(queries, row, node), np.searchsorted(active, row)
            if nodes.shape[1] == beam:
                good = value > scores[at, -1]
                node, value, at = node[good], value[good], at[good]
            place = _places(_starts(at))
            shape = (len(active), place.max(initial=-1) + 1)
            more, more_scores, more_looked = np.full(shape, -1), np.full(shape, -np.inf, np.float32), np.ones(shape, bool)
            more[at, place], more_scores[at, place], more_looked[at, place] = node, value, False
            nodes, scores, looked = (np.concatenate(x, axis=1) for x in ((nodes, more), (scores, more_scores), (looked, more_looked)))
            order = np.argsort(-scores, axis=1)[:, :beam]
            nodes, scores, looked = (np.take_along_axis(x, order, 1) for x in (nodes, scores, looked))
            done = looked.all(1)
            if done.any():
                yield active[done], nodes[done]
                active, nodes, scores, looked = active[~done], nodes[~done], scores[~done], looked[~done]
            look = ~looked & (np.cumsum(~looked, axis=1) <= LOOKED_AT)
            looked |= look
            row, column = np.nonzero(look)
            near = self.links[nodes[row, column]]
            keys = ((active[row] * number)[:, None] + near)[near >= 0]
            keys = np.sort(keys[~met[keys]])
            keys = keys[_starts(keys)]

    def hits(self, queries: np.ndarray, beam: int, k: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries' rows, ids, scores) of the k best of each pool, the best first, scored in double precision."""
        at_once = min(SEARCHED_AT_ONCE, max(1, MET_AT_ONCE // len(self.ids)))
        for a in range(0, len(queries), at_once):
            for rows, nodes in self.pools(queries[a : a + at_once], beam):
                at, column = np.nonzero(nodes >= 0)
                node = nodes[at, column]
                bounds = np.searchsorted(at, np.arange(len(rows) + 1)).tolist()
                score = np.concatenate([self.exact.take(node[x:y], axis=0) @ queries[a + r] for x, y, r in zip(bounds, bounds[1:], rows.tolist(), strict=False)])
                score = np.round(score, digits)
                order = np.lexsort((self.ids[node], -score, at))
                order = order[_places(_starts(at[order])) < k]
                yield a + rows[at[order]], self.ids[node[order]], score[order]


def _tried(parts: DataFrame, number: int, shared, beams: Sequence[int], k: int, digits: int, splits: int) -> DataFrame:  # noqa: ANN001
    """Rows of TRIED: the k best nodes of each part and beam for broadcast queries. Each of so many tasks of a part has its share of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole(batches):
            tasks = whole.column(0).to_numpy()
            first = np.flatnonzero(_starts(tasks))
            for a, b in zip(first.tolist(), np.append(first[1:], len(tasks)).tolist(), strict=True):
                own = whole.slice(a, b - a)
                matrix = _flat(own.column(2)).reshape(b - a, -1)
                if matrix.shape[1] not in shared.value:
                    continue
                names, queries = (x[tasks[a] % splits :: splits] for x in shared.value[matrix.shape[1]])
                part = Part(own.column(1).to_numpy(), matrix, _sizes(own.column(3)), _flat(own.column(3)))
                for beam in beams:
                    for rows, ids, scores in part.hits(queries, beam, k, digits):
                        at = np.flatnonzero(_starts(rows))
                        counts = np.diff(np.append(at, len(rows)))
                        yield pa.RecordBatch.from_arrays([pa.array(names[rows[at]]), _lists(counts, pa.array(ids)), _lists(counts, pa.array(scores)), pa.array(np.full(len(at), beam))], names=TRIED.names)

    split = F.explode(F.sequence(F.lit(0), F.lit(splits - 1))) if splits > 1 else F.lit(0)
    rows = parts.withColumn("split", split).select((F.col("part") * splits + F.col("split")).alias("task"), "id", "vector", "near")
    return rows.repartitionById(number * splits, F.col("task").cast("int")).sortWithinPartitions("task", F.xxhash64("id"), "id").mapInArrow(run, TRIED)


@dataclass
class NeighbourGraph:
    path: str
    #: (id, vector) of the different vectors, (id, copy) of all rows, with the node that stands for them, and nodes with their part and edges as lists.
    nodes: DataFrame
    copies: DataFrame
    parts: DataFrame
    #: How many parts there are.
    number: int

    @property
    def edges(self) -> DataFrame:
        return _each(self.parts)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, vector_id: str = "vec_id", vector: str = "embedding", degree: int = DEGREE, rounds: int | None = None) -> NeighbourGraph:
        """rounds: has no effect, as a part's edges are exact at once; they were found by rounds before."""
        spark = vectors.sparkSession
        ship(spark)
        # What is the same vector is one node, by the least id.
        rows = cls._kept(spark, scaled(vectors, vector_id, vector), f"{path}/rows")
        nodes = cls._kept(spark, rows.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector"), f"{path}/nodes")
        # Joined and sorted by a hash first, as vectors are long to compare.
        named, key = nodes.withColumnRenamed("id", "node"), F.xxhash64("vector").alias("key")
        copies = cls._kept(spark, rows.select("*", key).join(named.select("*", key), ["key", "vector"]).select(F.col("node").alias("id"), F.col("id").alias("copy")), f"{path}/copies")
        # Each length has its own parts, numbered on.
        dealt, number, most = [], 0, 1
        for r in nodes.groupBy(F.size("vector").alias("length")).count().orderBy("length").collect():
            size = max(1, min(max(PART, int(GROWTH * math.sqrt(r["count"]))), VALUES // r.length))
            dealt.append((r.length, number, -(-r["count"] // size)))
            number, most = number + dealt[-1][2], max(most, 2 * size)
        table = spark.createDataFrame(dealt, "length int, first int, own int")
        part = F.col("first") + F.pmod(F.xxhash64("id"), F.col("own")).cast("int")
        members = nodes.join(F.broadcast(table), F.size("vector") == F.col("length")).select(part.alias("part"), "id", "vector")
        met = _met(members.withColumnRenamed("part", "group").withColumn("least", F.lit(float("-inf"))), degree, most, number)
        own = members.join(met, "id", "left").select("part", "id", "vector", *(F.coalesce(c, F.array().cast(EDGES[c].dataType)).alias(c) for c in ("near", "score")))
        return cls(path, nodes, copies, cls._kept(spark, own, f"{path}/parts"), number)

    @staticmethod
    def _kept(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def search(self, queries: DataFrame, k: int, beam: int = BEAM, digits: int = 6) -> DataFrame:
        """(query_id, vec_id, score, rank): the k best rows that a beam of at least k nodes in each part has met for each query (query_id, embedding)."""
        spark, base = self.nodes.sparkSession, f"{self.path}/search-{uuid.uuid4().hex}"
        asked = self._kept(spark, scaled(queries, "query_id", "embedding").select(F.col("id").alias("query_id"), F.col("vector").alias("embedding")), f"{base}/queries")
        size = asked.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("components")).first()
        blocks = max(1, -(-size["rows"] // QUERIES_AT_ONCE), -(-size["components"] // COMPONENTS_AT_ONCE))
        splits = max(1, -(-TASKS_A_CORE * spark.sparkContext.defaultParallelism // max(1, self.number)))
        beam = self._fitted(asked.orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED), k, max(beam, k), digits, base)
        found = None
        for b in range(blocks):
            block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            own = self._kept(spark, _nearest(self._hits(block, [beam], k, digits, splits), k, HITS), f"{base}/{b}")
            found = own if found is None else found.unionAll(own)
        hits = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
        # Of a node's rows the first k by id may be among the best.
        firsts = self.copies.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("copy"))).where(F.col("n") <= k)
        rows = hits.join(firsts, "id").select("query_id", F.col("copy").alias("vec_id"), "score")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def _hits(self, asked: DataFrame, beams: Sequence[int], k: int, digits: int, splits: int) -> DataFrame:
        """What queries that fit into a broadcast find in each part."""
        spark, table = self.nodes.sparkSession, asked.toArrow().combine_chunks()
        lengths = {m.shape[1]: (own.column(0).to_numpy(), m) for part in table.to_batches() for own, m in _by_length(part)}
        return _tried(self.parts, max(1, self.number), spark.sparkContext.broadcast(lengths), beams, k, digits, splits)

    def _fitted(self, sample: DataFrame, k: int, beam: int, digits: int, base: str) -> int:
        """The first beam, each WIDER than the one before, by which a sample of queries reaches the recall; one of a part's nodes looks at all."""
        spark = self.nodes.sparkSession
        sample = self._kept(spark, sample, f"{base}/sample")
        least = self._least(sample, k, digits)
        largest = self.parts.groupBy("part").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        while True:
            beams = [math.ceil(beam * WIDER**n) for n in range(TRIALS)]
            tried = self._kept(spark, self._hits(sample, beams, k, digits, 1), f"{base}/beams-{beam}")
            for own in beams:
                if own >= largest or self._recall(_nearest(tried.where(F.col("beam") == own), k, HITS), least) >= RECALL:
                    return own
            beam = math.ceil(beams[-1] * WIDER)

    def _least(self, sample: DataFrame, k: int, digits: int) -> dict[int, list[float]]:
        """The scores of the k best nodes of some queries, of all nodes of their length."""
        length = {r.query_id: len(r.embedding) for r in sample.collect()}
        out: dict[int, list[float]] = {q: [] for q in length}
        for n in set(length.values()):
            nodes = self.nodes.where(F.size("vector") == n).withColumnRenamed("vector", "embedding")
            own = vector_search.batch_top_k(nodes, sample.where(F.size("embedding") == n), k, vector_id="id", digits=digits)
            for r in own.collect():
                out[r.query_id].append(r.score)
        return out

    @staticmethod
    def _recall(hits: DataFrame, want: dict[int, list[float]]) -> float:
        got = {r.query_id: r.scores for r in hits.collect()}
        of = sum(len(x) for x in want.values())
        return sum(sum(s >= min(x) for s in got.get(q, [])) for q, x in want.items() if x) / of if of else 1.0
