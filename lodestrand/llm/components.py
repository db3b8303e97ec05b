"""Distributed connected components by alternating large-star and small-star steps.

Each task first unites the edges that it holds anyway, a bounded number at a time, so that rounds of
shuffles are needed only for what lies across tasks. There is one path for graphs of all sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm import common

#: Steps double what a label has travelled; this many serve any graph that a cluster can hold.
MOST_ROUNDS = 100
#: Edges that a task unites at once: some 50 MB.
HELD_EDGES = 100_000


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node of each node's component, for all nodes of the edges.

    Edges with a null end are ignored; a node that is only its own neighbour is a component. Rounds are
    written to the checkpoint folder and end as soon as each node has one neighbour, a root. A node with
    many edges is never gathered: minima are aggregated before they move, and joins broadcast the nodes
    with the most edges."""
    spark = edges.sparkSession
    common.ensure_checkpoints(spark)
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    stars = _united(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).distinct().checkpoint()
    for _ in range(MOST_ROUNDS):
        if _settled(stars):
            break
        stars = _small_star(_large_star(stars).checkpoint()).checkpoint()
    else:
        raise RuntimeError("connected components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct()).distinct()


def _settled(stars: DataFrame) -> bool:
    """Whether each node hangs on one other, which hangs on none."""
    ends = stars.where("u <> v").select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("above")), F.struct(F.col("v").alias("node"), F.lit(0).alias("above")))).alias("x"))
    kept = ends.groupBy("x.node").agg(F.sum("x.above").alias("above"), F.min("x.above").alias("least"))
    return kept.where("above > 1 or above = 1 and least = 0").isEmpty()


def _united(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that join the same nodes: of each HELD_EDGES edges of a task, from each node to the smallest it is joined with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        held = 0

        def top(x):  # noqa: ANN001, ANN202
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        def flush(schema: pa.Schema) -> pa.RecordBatch:
            nodes = list(above)
            roots = [top(x) for x in nodes]
            children = {r for x, r in zip(nodes, roots, strict=True) if x != r}
            rows = [(x, r) for x, r in zip(nodes, roots, strict=True) if x != r or x not in children]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], schema.field(0).type), pa.array([r for _, r in rows], schema.field(1).type)], names=["u", "v"])

        schema = None
        for batch in batches:
            schema = batch.schema
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                above.setdefault(u, u)
                above.setdefault(v, v)
                a, b = top(u), top(v)
                above[max(a, b)] = min(a, b)
            held += batch.num_rows
            if held >= HELD_EDGES:
                yield flush(schema)
                above.clear()
                held = 0
        if above:
            yield flush(schema)

    return edges.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in edges.schema]))


def _large_star(stars: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (or itself)."""
    both = stars.union(stars.select("v", "u")).where("u <> v")
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    own = stars.where("u = v").select("u", "v")
    moved = common.hot_join(both.where("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(own).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, move to its smallest neighbour."""
    down = stars.where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = common.hot_join(down, least, "u", "n").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).union(stars.where("u = v")).distinct()
