"""The inverted file with product quantization: exact with all cells, recall with few, bounds that hold."""

import numpy as np
import pytest

from lodestrand import queries
from lodestrand.operators import ivf_pq, vector_search
from lodestrand.operators.ivf_pq import IvfPq, Model
from tests.conftest import DATA

K = 10


def made(spark, x):
    return spark.createDataFrame([(k, [float(np.float32(y)) for y in v]) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 20))[rng.integers(0, 40, 3000)] + rng.normal(0, 0.25, size=(3000, 20))
    return made(spark, x * rng.uniform(0.1, 5, size=(3000, 1))).cache()


def found(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in x}) / len(x) for q, x in want.items()])


def asked(df):
    return df.where("vec_id % 60 = 0").selectExpr("vec_id as query_id", "embedding")


def test_exact_with_all_cells_and_recall_with_few(spark, clustered, tmp_path, monkeypatch):
    # Small lists and blocks: large cells have parts, and queries several blocks.
    monkeypatch.setattr(ivf_pq, "LIST_ROWS", 50)
    monkeypatch.setattr(ivf_pq, "QUERY_ROWS", 20)
    index = IvfPq.write(clustered, str(tmp_path / "i"), parts=5)
    cells = len(index.model.centres)
    assert cells > 30 and sum(index.sizes.values()) == 3000 and max(index.sizes.values()) > 50
    want = found(vector_search.batch_top_k(clustered, asked(clustered), K))
    assert found(index.search(asked(clustered), K, cells)) == want
    few = index.probes_for(asked(clustered), 0.97, K)
    assert few <= cells / 3
    assert recall(found(index.search(asked(clustered), K, few)), want) >= 0.95
    assert recall(found(index.search(asked(clustered), K, few, rerank=4)), want) >= 0.9
    # Read again from its files.
    again = IvfPq.open(spark, str(tmp_path / "i"))
    assert again.sizes == index.sizes and np.array_equal(again.model.books, index.model.books)


def test_plan_reads_lists_by_cell(spark, clustered, tmp_path):
    index = IvfPq.write(clustered, str(tmp_path / "i"), cells=8)
    assert len(list((tmp_path / "i" / "lists").glob("cell=*"))) == len(index.sizes) <= 8


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    model = Model.fit(x, 12, 5)
    cell, codes, errors = model.encode(x)
    for q in x[:20]:
        for c in range(len(model.centres)):
            own = np.flatnonzero(cell == c)
            near = np.sqrt(model.approximate(q, c, codes[own]))
            true = np.linalg.norm(x[own] - q, axis=1)
            assert (np.abs(near - true) <= errors[own] + 1e-9).all()


def test_odd_rows(spark, tmp_path):
    rows = [(k, [float(k % 5), 1.0, -1.0]) for k in range(90)] + [(90, None), (91, []), (92, [0.0, 0.0, 0.0]), (93, [None, 1.0, 2.0]), (94, [float("nan")] * 3), (95, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (96, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = IvfPq.write(df, str(tmp_path / "i"))
    assert sum(index.sizes.values()) == 91
    ask = df.selectExpr("vec_id as query_id", "embedding").where("query_id >= 85")
    got = found(index.search(ask, 3, 99))
    assert set(got) == {85, 86, 87, 88, 89, 96} and got[85][0] == (0, 1.0) and got[96] == [(96, 1.0), (4, round(4 / 18**0.5, 6)), (9, round(4 / 18**0.5, 6))]
    none = IvfPq.write(df.limit(0), str(tmp_path / "none"))
    assert none.search(ask, 3, 5).count() == 0


def test_recall_on_the_tables(spark):
    want = found(queries.cosine_batch_topk(spark, DATA))
    assert recall(found(queries.ivf_pq_topk(spark, DATA)), want) >= 0.9


def test_decoded_rows_give_the_distances_of_the_tables():
    """What a search takes by products for many queries at once is what the tables of one query give."""
    import numpy as np

    from lodestrand.operators.ivf_pq import Model

    rng = np.random.default_rng(1)
    rows = rng.standard_normal((900, 10))
    model = Model.fit(rows, 4, 4)
    own, codes, errors = model.encode(rows)
    for cell in range(len(model.centres)):
        made = model.decode(cell, codes[own == cell])
        assert np.allclose(np.linalg.norm(rows[own == cell] - made, axis=1), errors[own == cell])
        assert np.allclose(((rows[7] - made) ** 2).sum(axis=1), model.approximate(rows[7], cell, codes[own == cell]))
