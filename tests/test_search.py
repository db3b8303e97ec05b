"""Vector search and fusion."""

import numpy as np

from lodestrand.operators import chunking, fusion, vector_search


def test_batch_equals_one_by_one(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=5)]) for k in range(60)] + [(60, [0.0] * 5), (61, [1.0]), (62, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    for metric in ("cosine", "ip", "l2"):
        got = {}
        for r in vector_search.batch_top_k(df, asked, 4, metric).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 4)))
        for q, vector in rows[:61:20]:
            own = [(r.vec_id, round(r.score, 4)) for r in vector_search.top_k(df, vector, 4, metric).collect()]
            assert [i for i, _ in got[q]] == [i for i, _ in own], metric


def hits(spark, rows):
    return spark.createDataFrame([(i, i, path, rel, 1, 1, "x", s) for i, path, rel, s in rows], "chunk_id string, content string, file_path string, relative_path string, start_line int, end_line int, language string, score double")


def test_fusion(spark):
    semantic = hits(spark, [("a", "", "a.rs", 0.9), ("b", "/r/b.py", "b.py", 0.8)])
    lexical = hits(spark, [("a", "/r/a.rs", "a.rs", 3.0), ("c", "", "c.md", 2.0)])
    got = fusion.fuse_chunks(semantic, lexical, 10).collect()
    assert [r.chunk_id for r in got] == ["a", "b", "c"] and abs(got[0].score - 2 / 61) < 1e-12 and got[0].file_path == "/r/a.rs" and abs(got[1].score - 1 / 62) < 1e-12
    assert [r.chunk_id for r in fusion.fuse_chunks(semantic, lexical, 2).collect()] == ["a", "b"]
    assert [r.chunk_id for r in fusion.fuse_chunks(semantic, lexical, 9, [".RS"]).collect()] == ["a"]
    assert len(fusion.fuse_chunks(semantic, lexical, 9, dedupe=False).collect()) == 4
    assert chunking.COLUMNS == fusion.CHUNK


def test_scores_of_few_rows_are_held_at_once(monkeypatch):
    """A large Arrow batch is scored in parts of bounded size; the hits are those of one product."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from lodestrand.operators import vector_search

    rng = np.random.default_rng(3)
    rows, queries = rng.standard_normal((5000, 8)), rng.standard_normal((4, 8))
    held, seen, scores = [SimpleNamespace(value=[(np.arange(4), queries)])], [], vector_search._scores
    monkeypatch.setattr(vector_search, "_scores", lambda m, q, metric: seen.append(len(m)) or scores(m, q, metric))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5000)), pa.array(list(rows))], names=["vec_id", "embedding"])
    (own,) = vector_search._searcher(held, 3, "cosine", 6)(iter([batch]))
    want = np.round(scores(rows, queries, "cosine"), 6)
    assert sum(seen) == 5000 and max(seen) <= 512
    for q in range(4):
        best = np.lexsort((np.arange(5000), -want[:, q]))[:3]
        assert [i for i, x in zip(own.column(1).to_pylist(), own.column(0).to_pylist(), strict=True) if x == q] == best.tolist()
