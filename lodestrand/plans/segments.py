"""The lexical tables of a collection's segments, written alike by runs and streams, and the searches over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.operators import block_index, lexical, lexical_index
from lodestrand.operators.block_index import BlockIndex
from lodestrand.operators.lexical_index import LexicalIndex, Sums
from lodestrand.sources.store import Collection, Derived, Writers

#: Columns of a chunk that a lexical query may ask for, beside its text.
FIELDS = ["relative_path", "language", "start_line", "end_line"]
#: Blocks of a segment are told from another's by its number above their own.
SEGMENT_BLOCKS = 1 << 48

WRITERS: Writers = {"postings": lexical_index.write_postings, "blocks": block_index.write_blocks, "bounds": block_index.write_blocks}


def lexical_tables(chunks: DataFrame) -> dict[str, DataFrame]:
    return {"lengths": lexical_index.lengths_of(chunks, "chunk_id", "content", FIELDS), "postings": lexical_index.postings_of(chunks, "chunk_id", "content", FIELDS)}


def _blocks(written: dict[str, DataFrame]) -> DataFrame:
    return block_index.blocks_of(written["chunks"], written["chunks"].count(), "chunk_id", "content", ["relative_path"])


#: Made from a segment's tables as written, and again when segments are merged: without any deleted row.
DERIVED: Derived = {
    "blocks": _blocks,
    "bounds": lambda written: block_index.bounds_of(written["blocks"]),
    "totals": lambda written: lexical_index.totals_of(written["lengths"]),
    "terms": lambda written: block_index.terms_of(written["bounds"]),
}


def gone_tables(collection: Collection, stale: DataFrame) -> dict[str, DataFrame]:
    """What the rows of stale paths have added to the sums so far, with the sign turned round. Their chunks are read, not the index."""
    chunks = collection.table("chunks")
    if chunks is None or collection.raw("totals") is None:
        return {}
    old = chunks.join(stale.select("relative_path").distinct(), "relative_path", "left_semi")
    lengths = lexical_index.lengths_of(old, "chunk_id", "content")
    totals = lexical_index.totals_of(lengths).select((-F.col("n_docs")).alias("n_docs"), (-F.col("total_length")).alias("total_length"))
    terms = lexical.document_frequencies(old, "chunk_id", "content")
    return {"gone_totals": totals, "gone_terms": terms.select(lexical_index.bucket_of(F.col("term")).alias("bucket"), "term", (-F.col("df")).alias("df"))}


def _all(collection: Collection, name: str) -> DataFrame:
    rows, gone = collection.raw(name).drop("_segment"), collection.raw(f"gone_{name}")
    return rows if gone is None else rows.unionByName(gone.drop("_segment"))


def sums(collection: Collection) -> Sums | None:
    """The sums over all segments; None for collections that have none stored."""
    if collection.raw("totals") is None:
        return None
    return Sums(_all(collection, "totals"), _all(collection, "terms"))


def blocks(collection: Collection) -> BlockIndex | None:
    own = sums(collection)
    if own is None:
        return None
    placed = (F.col("block") + F.col("_segment").cast("long") * F.lit(SEGMENT_BLOCKS)).alias("block")
    held = [collection.raw(name) for name in ("blocks", "bounds")]
    rows, bounds = (df.select(*(placed if c == "block" else c for c in df.columns)) for df in held)
    return BlockIndex(rows, bounds, own, collection.live, ("_segment",))


def postings(collection: Collection) -> LexicalIndex:
    return LexicalIndex(collection.table("postings"), collection.table("lengths"), sums(collection))


def search(collection: Collection, query: str, limit: int, strict: bool = False) -> DataFrame:
    """(doc_id, score) of the best chunks. Plain words are searched by the bounds of blocks; other queries read the postings of their words."""
    tree = lexical.parse_query(query, strict)
    own = blocks(collection) if lexical.plain_words(tree) else None
    return own.topk(query, limit) if own is not None else postings(collection).search(query, limit, strict)
