"""Hybrid search: a lexical and a semantic leg, fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.operators import fusion, lexical, vector_search
from lodestrand.operators.block_index import BlockIndex
from lodestrand.operators.lexical_index import LexicalIndex


def hybrid_documents(
    docs: DataFrame, vectors: DataFrame, query: str, vector: Sequence[float], k: int, leg: int, extensions: Iterable[str] = (), prefilter: bool = False, index: BlockIndex | LexicalIndex | None = None
) -> DataFrame:
    """(doc_id, score, n_legs, source, lang) of the k best documents; vec_id is doc_id.

    Each leg gives its `leg` best. The extension filter comes after that, so fewer than k may be left;
    prefilter=True lets only matching documents into the legs. docs needs relative_path for a filter. index: of
    docs, read instead of their texts, but for prefilter, whose statistics are those of the matching documents."""
    wanted = list(extensions)
    if wanted and prefilter:
        docs = fusion.filtered(docs, wanted)
        vectors = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    semantic = vector_search.top_k(vectors, vector, leg).withColumnRenamed("vec_id", "doc_id")
    words = index.topk(query, leg) if index is not None and not (wanted and prefilter) else lexical.bm25_topk(docs, query, leg)
    if wanted and not prefilter:
        paths = docs.select("doc_id", "relative_path")
        # A leg is at most `leg` rows: the optimizer sends it to the documents.
        semantic, words = (fusion.filtered(paths.join(F.broadcast(x), "doc_id"), wanted).select("doc_id", "score") for x in (semantic, words))
    best = fusion.fuse([fusion.ranked(semantic, "doc_id"), fusion.ranked(words, "doc_id")], k)
    return docs.select("doc_id", "source", "lang").join(F.broadcast(best), "doc_id").select("doc_id", "score", "n_legs", "source", "lang")
