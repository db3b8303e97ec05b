"""Nearest neighbours: every result against brute force, exact where all rows must count, and by recall elsewhere."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestrand.llm import nearest
from tests.conftest import DATA


def stored(folder, rows):
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float32())), *(pa.array([7] * len(rows), pa.int32()) for _ in range(4))]
    pq.write_table(pa.table(columns, names=["vec_id", "embedding", "label", "shard", "hash", "rank"]), folder / "embeddings.parquet")
    return str(folder)


def brute(rows, k=20):
    """{query_id: [(vec_id, score)]} of the contract."""
    own = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    out = {}
    for i, q in own:
        if i % 20 == 0:
            found = [(j, float((np.array(v, float) * np.array(q, float)).sum())) for j, v in own if (j, v) != (i, q) and len(v) == len(q)]
            out[i] = sorted(found, key=lambda x: (-x[1], x[0]))[:k]
    return out


def results(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(found, want):
    hits = [len({i for i, _ in found[q]} & {i for i, _ in x}) / len(x) for q, x in want.items() if x]
    return float(np.mean(hits))


def as32(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def test_all_candidates_where_few(spark, tmp_path):
    odd = [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [1.0, None]), (120, [float("nan"), 1.0]), (140, [float("inf"), 1.0]), (None, [1.0, 1.0]), (160, [1.0, 2.0, 3.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [-1.0, 7.0]), (200, [5.0])]
    rows = [(i, as32(v)) for i, v in odd]
    found = results(nearest.op12_nearest_neighbours(spark, stored(tmp_path, rows)))
    assert found == {q: x for q, x in brute(rows).items() if x}


def test_no_rows(spark, tmp_path):
    assert nearest.op12_nearest_neighbours(spark, stored(tmp_path, [])).count() == 0
    (tmp_path / "odd").mkdir()
    assert nearest.op12_nearest_neighbours(spark, stored(tmp_path / "odd", [(20, None), (40, [0.0])])).count() == 0


def test_copies_and_ties(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(3, 8))
    rows = [(k, as32(base[k % 3])) for k in range(300)] + [(7, as32(base[1]))] * 50 + [(1000 + k, as32(rng.normal(size=8))) for k in range(60)]
    found, want = results(nearest.op12_nearest_neighbours(spark, stored(tmp_path, rows))), brute(rows)
    assert set(found) == set(want)
    # A query's own copies are its nearest, unless others are longer in its direction.
    assert recall(found, want) >= 0.95
    assert all(x == sorted(x, key=lambda h: (-h[1], h[0])) for x in found.values())


@pytest.mark.parametrize("kind", ["sphere", "norms", "clusters", "near copies"])
def test_recall(spark, tmp_path, monkeypatch, kind):
    # Small shards: cells are split, and queries go to several.
    monkeypatch.setattr(nearest, "SHARD_ROWS", 150)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2400, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "norms":
        x *= np.exp(rng.normal(0, 1.5, size=2400))[:, None]
    elif kind == "clusters":
        x = x[rng.integers(0, 12, 2400)] + rng.normal(0, 0.1, size=(2400, 24))
    elif kind == "near copies":
        x[:1200] = x[0] + rng.normal(0, 0.002, size=(1200, 24))
    rows = [(k, as32(v)) for k, v in enumerate(x)]
    found, want = results(nearest.op12_nearest_neighbours(spark, stored(tmp_path, rows))), brute(rows)
    assert set(found) == set(want)
    assert recall(found, want) >= 0.9
    exact = {(q, i): s for q in want for i, s in [(j, float((np.array(rows[j][1]) * np.array(rows[q][1])).sum())) for j, _ in found[q]]}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, x in found.items() for i, s in x)


def test_recall_on_the_tables(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{DATA}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pylist()]
    found, want = results(nearest.op12_nearest_neighbours(spark, DATA)), brute(rows)
    assert {q: len(x) for q, x in found.items()} == {q: len(x) for q, x in want.items()}
    assert recall(found, want) >= 0.9


def test_visits_in_order_of_cost():
    inside = np.array([0.1, 0.45, 0.8])
    cost = lambda steps: sum((inside[k] if s < 0 else 1 - inside[k]) ** 2 for k, s in enumerate(steps) if s)
    want = sorted(cost(s) for s in itertools.product((-1, 0, 1), repeat=3))
    got = nearest.visits(inside, 100)
    assert len({tuple(x) for x in got.tolist()}) == 27
    assert np.allclose([cost(s) for s in got], want)


def test_cells_of_equal_vectors_and_long_ones():
    plan = nearest.Plan(3, 4.0, (0, 1, 2), 6, 30)
    rows = np.array([[4.0, 0, 0], [0, 1e-3, 0], [0, 1e-3, 0]])
    cells = nearest.row_cells(rows, plan)
    assert (cells[1] == cells[2]).all() and (cells[0] != cells[1]).all()
    # A query visits its own direction's cell first.
    assert nearest.query_cells(np.array([0.5, 0, 0]), plan)[0][0, 0] == cells[0, 0]
