"""The neighbour graph: its edges and its searches against full scans."""

import numpy as np

from lodestrand import queries
from lodestrand.operators import neighbour_graph, vector_search
from lodestrand.operators.neighbour_graph import NeighbourGraph
from tests.conftest import DATA
from tests.test_ivf_pq import found, made, recall


def test_recall_of_edges_and_searches(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(25, 12))[rng.integers(0, 25, 1200)] + rng.normal(0, 0.5, size=(1200, 12))
    # A node that many have as neighbour, and copies.
    x[:40] = x[0]
    rows = made(spark, x * rng.uniform(0.2, 4, size=(1200, 1)))
    graph = NeighbourGraph.build(rows, str(tmp_path / "g"), degree=12, rounds=4)
    sizes = [r["count"] for r in graph.edges.groupBy("id").count().collect()]
    assert len(sizes) == 1200 and max(sizes) == 12 and graph.edges.where("id = near").count() == 0
    ask = rows.where("vec_id % 20 = 1").selectExpr("vec_id as query_id", "embedding")
    want = found(vector_search.batch_top_k(rows, ask, 10))
    got = found(graph.search(ask, 10))
    assert set(got) == set(want) and recall(got, want) >= 0.9
    exact = {(q, i): s for q, x in found(vector_search.batch_top_k(rows, ask, 1200)).items() for i, s in x}
    assert all(abs(exact[q, i] - s) <= 1.1e-6 for q, x in got.items() for i, s in x)
    true = {(q, i) for q, x in found(vector_search.batch_top_k(rows, ask, 13)).items() for i, _ in x if i != q}
    edges = {(r.id, r.near) for r in graph.edges.where("id % 20 = 1").collect()}
    assert len(edges & true) / len(edges) >= 0.85


def test_odd_rows(spark, tmp_path):
    rows = [(k, [float(k % 7), 1.0, -float(k)]) for k in range(60)] + [(60, None), (61, []), (62, [0.0, 0.0, 0.0]), (63, [None, 1.0, 1.0]), (64, [float("inf"), 0.0, 1.0]), (65, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (5, [9.0, 9.0, 9.0]), (66, [1e300, 1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    graph = NeighbourGraph.build(df, str(tmp_path / "g"), rounds=1)
    assert graph.nodes.count() == 62
    got = found(graph.search(df.where("vec_id > 50").selectExpr("vec_id as query_id", "embedding"), 3))
    assert set(got) == {*range(51, 60), 65, 66} and got[65] == [(65, 1.0)] and got[66][0] == (66, 1.0) and len(got[51]) == 3
    none = NeighbourGraph.build(df.limit(0), str(tmp_path / "none"), rounds=1)
    assert none.search(df.selectExpr("vec_id as query_id", "embedding"), 3).count() == 0


def test_groups_are_bounded(spark, monkeypatch):
    """A group of many is compared in pieces, and no row is lost."""
    monkeypatch.setattr(neighbour_graph, "MOST_GROUP", 16)
    rng = np.random.default_rng(1)
    members = spark.createDataFrame([(1, k, [float(y) for y in rng.normal(size=4)]) for k in range(100)], "group long, id long, vector array<double>")
    edges = neighbour_graph._compared(members, 5).collect()
    assert {r.id for r in edges} == set(range(100)) and len(edges) == 500 - 5 * 4 + 4 * 3


def test_recall_on_the_tables(spark):
    want = found(queries.cosine_batch_topk(spark, DATA))
    assert recall(found(queries.graph_topk(spark, DATA)), want) >= 0.9


def test_copies_are_one_node(spark, tmp_path):
    """groups of copies larger than a node's edges are not cut off from all else, and give their rows by id."""
    rng = np.random.default_rng(4)
    rows = made(spark, np.repeat(rng.normal(size=(150, 8)), 40, axis=0))
    graph = NeighbourGraph.build(rows, str(tmp_path / "g"), degree=8, rounds=2)
    assert graph.nodes.count() == 150 and graph.edges.where("id = near").count() == 0
    ask = rows.where("vec_id % 100 = 7").selectExpr("vec_id as query_id", "embedding")
    got, want = found(graph.search(ask, 60)), found(vector_search.batch_top_k(rows, ask, 60))
    assert recall(got, want) >= 0.9 and all([i for i, _ in x[:40]] == [i for i, _ in got[q][:40]] for q, x in want.items())


def test_the_beam_grows_to_the_recall(spark, tmp_path, monkeypatch):
    """a beam that finds too little is doubled, and many queries go in blocks."""
    monkeypatch.setattr(neighbour_graph, "QUERIES_AT_ONCE", 60)
    rows = made(spark, np.random.default_rng(5).normal(size=(2500, 48)))
    graph = NeighbourGraph.build(rows, str(tmp_path / "g"), rounds=1)
    ask = rows.where("vec_id % 20 = 3").selectExpr("vec_id as query_id", "embedding")
    assert recall(found(graph.search(ask, 10, beam=10)), found(vector_search.batch_top_k(rows, ask, 10))) >= 0.9


def test_edges_are_one_row_of_a_node_and_better_than_those_known(spark):
    """what a round gives on is a row of each node that gets better, not one of each pair."""
    rng = np.random.default_rng(1)
    rows = [(k // 30, k, [float(y) for y in rng.normal(size=4)], 2.0**40 if k % 3 else -1e9) for k in range(300)]
    lists = neighbour_graph._met(spark.createDataFrame(rows, "group long, id long, vector array<double>, least double"), 5, 128).collect()
    assert sorted(r.id for r in lists) == list(range(0, 300, 3)) and all(len(r.near) == len(r.score) == 5 and {n // 30 for n in r.near} == {r.id // 30} for r in lists)


def test_a_search_is_one_pass_over_parts(spark, tmp_path, monkeypatch):
    """queries are searched inside parts of bounded size, each by a task, not by a join and a table for each step."""
    monkeypatch.setattr(neighbour_graph, "PART", 150, raising=False)
    monkeypatch.setattr(neighbour_graph, "GROWTH", 1, raising=False)
    rng = np.random.default_rng(8)
    rows = made(spark, rng.normal(size=(1200, 16)) + np.repeat(rng.normal(size=(40, 16)) * 2, 30, axis=0))
    short = spark.createDataFrame([(5000 + k, [float(x) for x in rng.normal(size=5)]) for k in range(200)], "vec_id long, embedding array<double>")
    rows = rows.select("vec_id", "embedding").unionAll(short)
    graph = NeighbourGraph.build(rows, str(tmp_path / "g"))
    ask = rows.where("vec_id % 10 = 3").selectExpr("vec_id as query_id", "embedding")
    got = found(graph.search(ask, 10))
    of_length = [rows.where(f"size(embedding) = {n}") for n in (16, 5)]
    want = {q: x for r in of_length for q, x in found(vector_search.batch_top_k(r, r.where("vec_id % 10 = 3").selectExpr("vec_id as query_id", "embedding"), 10)).items()}
    assert set(got) == set(want) and recall(got, want) >= 0.9
    assert len(list((tmp_path / "g").glob("search-*/**/_SUCCESS"))) <= 5
    parts = graph.parts.collect()
    assert graph.number == len({r.part for r in parts}) == 8 + 2 and len(parts) == len({r.id for r in parts}) == 1400
    # Edges are the nearest of a part.
    own = [r for r in parts if r.part == parts[0].part]
    matrix = np.array([r.vector for r in own])
    for r in own[:20]:
        order = np.argsort(-(matrix @ np.array(r.vector)))
        assert {own[k].id for k in order[:17]} - {r.id} == set(r.near) and len(r.near) == 16


def test_groups_are_compared_in_pieces(spark, monkeypatch):
    """F1: a task holds the scores of a piece of a group, and the nearest are those of the whole."""
    rng = np.random.default_rng(2)
    rows = [(0, k, [float(y) for y in rng.normal(size=6)], -1e9) for k in range(300)]
    members = spark.createDataFrame(rows, "group long, id long, vector array<double>, least double")
    whole = {r.id: sorted(r.near) for r in neighbour_graph._met(members, 7, 600).collect()}
    monkeypatch.setattr(neighbour_graph, "SCORES_AT_ONCE", 4000)
    pieces = {r.id: sorted(r.near) for r in neighbour_graph._met(members, 7, 600, 1).collect()}
    assert len(whole) == 300 and pieces == whole


def test_vectors_are_scaled(spark):
    """by numpy, in time that grows with a vector's length, not with its square."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 2000)) * 10.0 ** rng.integers(-200, 200, size=(20, 1))
    rows = [(k, [float(y) for y in v]) for k, v in enumerate(x)] + [(20, [-0.0, 3.0, 4.0]), (21, [0.0, None]), (22, [float("nan"), 1.0])]
    got = {r.id: r.vector for r in neighbour_graph.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()}
    assert set(got) == set(range(21)) and got[20] == [0.0, 0.6, 0.8] and str(got[20][0]) == "0.0"
    for k, v in enumerate(x):
        v = v / np.abs(v).max()
        assert np.allclose(got[k], v / np.linalg.norm(v), rtol=1e-12, atol=0)
