"""Searches by the bounds of blocks give the rows of a full scan, and leave most blocks unread."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrand import queries
from lodestrand.operators import block_index, lexical
from lodestrand.operators.block_index import BlockIndex
from tests.conftest import DATA


@pytest.fixture(scope="module")
def docs(spark):
    """Many texts with common words, some short ones that say a word often, and awkward ones."""
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(40)], k=rnd.randint(20, 400))) + " rare" * (k % 2)) for k in range(1500)]
    rows += [(2000 + k, "w0 w0 rare rare rare") for k in range(30)] + [(3000, None), (3001, ""), (3002, "lone"), (3003, "w0 " * 5000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return BlockIndex.write(docs, str(tmp_path_factory.mktemp("blocks") / "i"))


@pytest.mark.parametrize("query", ["w0", "w7 rare", "rare", "w39", "w3 w3 w5 lone", "none", "", "w0 w1 w2 w3 w4 w5 w6"])
@pytest.mark.parametrize("k", [1, 12, 400])
def test_same_as_a_scan(docs, index, query, k):
    assert index.topk(query, k).collect() == lexical.bm25_topk(docs, query, k).collect()


def test_no_limit(index):
    assert index.topk("w0", 0).count() == 0


def read(index, query, k):
    rows, least = index.plan(query, k)
    return rows.select("block").distinct().count(), index.bounded(query).count(), least


def test_most_blocks_are_not_read(docs, index, monkeypatch):
    monkeypatch.setattr(block_index, "FIRST_BLOCKS", 3)
    few, of_all, least = read(index, "rare", 10)
    assert least > 0 and few <= of_all / 4
    # Each block that is left out has no document that reaches the threshold.
    left = index.blocks.join(index.plan("rare", 10)[0].select("block").distinct(), "block", "left_anti").select(F.inline("docs")).select("doc_id").distinct()
    best = lexical.bm25(docs, ["rare"]).join(left, "doc_id").agg(F.max("score")).first()[0]
    assert best < least
    # More than k documents reach the lowest score: all blocks count.
    assert read(index, "w0", 5000)[2] == 0.0


def test_bounds_hold(index):
    rows = index.blocks.select("term", "block", "n", "max_tf", "min_length", "sum_tf", F.inline("docs"))
    bad = rows.where("tf > max_tf or length < min_length").count()
    sums = rows.groupBy("term", "block").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.sum("tf").alias("s"), F.first("sum_tf").alias("t")).where("m <> n or s <> t").count()
    assert bad == sums == 0


def test_stored_sums_and_plan(spark, docs, index):
    n, average, held = index.sums.facts(["w0", "lone", "none"])
    want = lexical.corpus_stats(lexical.lengths(docs)).first()
    assert (n, held["lone"], held["none"]) == (want.n_docs, 1, 0) and abs(average - want.avg_length) < 1e-12
    plan = index.topk("w0 w7", 5)._jdf.queryExecution().executedPlan().toString()
    # The postings are scanned once, in the buckets of two words, without lengths of other documents.
    assert plan.count("/blocks]") == 1 and "/lengths" not in plan
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and "PartitionFilters: []" not in plan


def test_batch(spark, docs, index):
    asked = spark.createDataFrame([(1, "w0 w7"), (2, "w39 lone"), (3, "none"), (4, ""), (5, None), (6, "w3 w3 w5")], "query_id long, query string")
    got = {}
    for r in index.batch(asked, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert set(got) == {1, 2, 6}
    for q, text in ((1, "w0 w7"), (2, "w39 lone"), (6, "w3 w3 w5")):
        assert got[q] == [tuple(r) for r in lexical.bm25_topk(docs, text, 7).collect()]


def test_empty(spark, tmp_path):
    own = BlockIndex.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "i"))
    assert own.topk("a b", 3).count() == 0
    assert own.batch(spark.createDataFrame([(1, "a")], "query_id long, query string"), 3).count() == 0


def test_index_of_a_changed_table(spark, tmp_path):
    """A table that is written anew in a session is indexed anew."""
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    first = queries.bm25_topk(spark, str(tmp_path)).collect()
    few = whole.where("doc_id % 7 = 3")
    few.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    found = queries.bm25_topk(spark, str(tmp_path)).collect()
    assert found == lexical.bm25_topk(few, queries.QUERY, queries.K).collect() != first
