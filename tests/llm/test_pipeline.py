"""The pipeline's stages: columns, decisions, and rows by hand."""

import corpus_pipeline
from lodestrand.llm import common, decontaminate, jaccard, linededup
from tests.llm.conftest import corpus


def test_stages(spark, odd):
    docs = common.documents(spark, odd)
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, odd), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == names
    rows = corpus()
    known = [r.doc_id for r in seen["language"].collect()]
    assert not {1000, 1001, 1002, 1003} & set(known) and len(known) >= len(rows) - 8
    texts = {r.doc_id: r for r in seen["lines"].collect()}
    assert texts[1100].text == "own 0" and texts[1100].n_chars == 5 and texts[1106].text.count("\n") == 2
    left = seen["near_duplicates"].collect()
    # The copies of one line lost it to the last of them; what is left of them is empty, and one row of those stays.
    assert len([r for r in left if r.doc_id is not None and 1200 <= r.doc_id < 1400 and r.text]) == 1
    assert sum(r.text == "" for r in left) == 1 and [r.doc_id for r in left].count(1007) == 2
    clean = [r.text for r in seen["decontamination"].collect()]
    matcher = decontaminate.Matcher([(str(r.item_id), (r.text or "").encode()) for r in spark.read.parquet(f"{odd}/benchmark.parquet").collect()])
    assert all(not matcher.search(t.encode())[2] for t in clean)
    kept = {r.doc_id for r in left if not matcher.search((r.text or "").encode())[2]}
    assert {r.doc_id for r in seen["decontamination"].collect()} == kept
    assert {r.doc_id for r in seen["packing"].select("doc_id").distinct().collect()} == kept


def test_empty_and_run(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_filters_leave_rows_alone(spark, odd):
    docs = common.documents(spark, odd)
    same = linededup.line_dedup(docs)
    assert same.count() == docs.count() and same.where("doc_id = 1000").first().text is None
    rows = docs.where("doc_id < 1000").limit(40)
    kept = jaccard.without_near_duplicates(rows.union(rows))
    assert kept.count() == jaccard.without_near_duplicates(rows).count() and kept.columns == docs.columns
