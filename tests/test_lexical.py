"""BM25, phrases, and the query grammar."""

import pytest

from lodestrand.operators import lexical
from lodestrand.operators.block_index import BlockIndex
from lodestrand.operators.lexical_index import LexicalIndex
from tests.conftest import DATA

DOCS = [("a", "fn target_keyword() {}", "x.rs"), ("b", "the quick brown fox", "y.md"), ("c", "a fox, a quick fox", "z.md"), ("d", "", "w.md"), ("e", None, "v.md")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id string, text string, relative_path string")


def found(df):
    return [r.doc_id for r in df.collect()]


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return LexicalIndex.write(docs, str(tmp_path_factory.mktemp("index") / "i"), carry=["relative_path"])


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("target_keyword", ["a"]),
        ("quick", {"b", "c"}),
        ('"quick fox"', ["c"]),
        ("quick -brown", ["c"]),
        ("quick AND brown", ["b"]),
        ("fox NOT quick", []),
        ("+fox +the", ["b"]),
        ("(brown OR target) relative_path:x.rs", {"a", "b"}),
        ("relative_path:[w.md TO y.md]", {"a", "b", "d"}),
        ("fox^3 brown", {"b", "c"}),
        ("nothing", []),
        ("", []),
        ("-quick", []),
    ],
)
def test_grammar(docs, index, query, want):
    got = lexical.search(docs, query, 10).collect()
    assert ({r.doc_id for r in got} == want) if isinstance(want, set) else [r.doc_id for r in got] == want
    assert index.search(query, 10).collect() == got


@pytest.mark.parametrize("query", ["start_line:[a TO b] fox", "fox start_line:[a TO b]"])
def test_bounds_that_are_no_numbers(spark, query):
    df = spark.createDataFrame([(1, "a fox", 3)], "doc_id long, text string, start_line int")
    assert lexical.search(df, query, 3).count() == 1


def test_index_equals_texts(spark, tmp_path):
    """Scores from stored postings against those from the texts, and the rows that a search reads."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    own = LexicalIndex.write(docs, str(tmp_path / "i"), carry=["lang"])
    for text in ("that thon inere", "that that the", "", "nothere"):
        assert own.topk(text, 20).collect() == lexical.bm25_topk(docs, text, 20).collect()
    for text in ('+the (thon OR tion) -der "in the"', '"of the"^2 the', "language:en that", "-the that"):
        assert own.search(text, 20).collect() == lexical.search(docs, text, 20).collect()
    assert sorted(own.phrase("of the").collect()) == sorted(lexical.phrase_matches(docs, "of the").collect())
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").limit(9)
    blocks = BlockIndex.write(docs, str(tmp_path / "b"))
    both = [x.orderBy("query_id", "rank").select("query_id", "doc_id", "score", "rank").collect() for x in (blocks.batch(items, 4, "item_id", "text"), lexical.bm25_batch(docs, items, 4, query_id="item_id", query="text"))]
    assert both[0] == both[1] and len(both[0]) > 9
    plan = own.topk("that thon", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan and "documents.parquet" not in plan


def test_postings(spark):
    df = spark.createDataFrame([(1, "a b a", "x"), (2, "", "y"), (3, None, "z"), (4, "b", None)], "doc_id long, text string, tag string").coalesce(1)
    got = sorted((r.doc_id, r.tag, r.length, r.term, r.tf, r.positions) for r in lexical.postings(df, carry=["tag"]).collect())
    assert got == [(1, "x", 3, "a", 2, [0, 2]), (1, "x", 3, "b", 1, [1]), (4, None, 1, "b", 1, [0])]
    assert [r.term for r in lexical.postings(df, only=["b", "q"]).orderBy("doc_id").collect()] == ["b", "b"]


def test_strict_and_lenient(docs):
    for bad in ('"open', "a AND", "nofield:x", "(a"):
        with pytest.raises(lexical.QueryError):
            lexical.parse_query(bad, strict=True)
        lexical.search(docs, bad, 3).collect()


def test_limits_and_ties(docs):
    assert found(lexical.bm25_topk(docs, "fox", 0)) == []
    assert found(lexical.bm25_topk(docs, "fox", 1)) == ["c"]
    assert all(r.score > 0 for r in lexical.bm25_topk(docs, "fox quick", 5).collect())
    assert lexical.bm25(docs, []).count() == 0


def test_phrases_overlap(spark):
    df = spark.createDataFrame([(1, "a a a b a a")], "doc_id long, text string")
    assert lexical.phrase_matches(df, "a a").first().n == 3 and lexical.phrase_matches(df, "a").first().n == 5 and lexical.phrase_matches(df, "").count() == 0


def test_single_searches_write_no_index(spark, tmp_path):
    """Without a held index a search cuts the texts into terms once, and its rows are those of the index."""
    from lodestrand import queries
    from tests.conftest import DATA

    spark.read.parquet(f"{DATA}/documents.parquet").write.parquet(str(tmp_path / "documents.parquet"))
    path, names = str(tmp_path), ("bm25_topk", "phrase_search", "boolean_search")
    held = dict(queries._indexes)
    scans = {n: queries.QUERIES[n](spark, path) for n in names}
    for n, df in scans.items():
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 1, n
    scans = {n: sorted(df.collect()) for n, df in scans.items()}
    assert queries._indexes == held
    queries.index_of(spark, path), queries.blocks_of(spark, path)
    assert all(sorted(queries.QUERIES[n](spark, path).collect()) == scans[n] != [] for n in names)


def test_batch_makes_no_row_for_a_query_and_a_document(spark):
    """Queries in several blocks, words that none holds, nulls: the rows of single searches, without a join."""
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "z z"), (5, "a c c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a a"), (2, "c b"), (3, "none"), (4, None), (None, "a"), (6, "z")], "query_id long, query string")
    lexical_block, lexical.QUERY_BLOCK = lexical.QUERY_BLOCK, 2
    try:
        got = lexical.bm25_batch(docs, items, 2)
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
        rows = {}
        for r in got.orderBy("query_id", "rank").collect():
            rows.setdefault(r.query_id, []).append((r.doc_id, r.score))
    finally:
        lexical.QUERY_BLOCK = lexical_block
    assert rows == {q: [tuple(r) for r in lexical.bm25_topk(docs, t, 2).collect()] for q, t in ((1, "a a"), (2, "c b"), (6, "z"))}
