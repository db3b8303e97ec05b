"""From documents to packed training sequences, in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet,
and read again as the next stage's docs. All but the last return the columns of documents, and extra ones as they are, whatever their names.
An empty table gives an empty one in each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm import common
from lodestrand.llm.decontaminate import decontaminated
from lodestrand.llm.jaccard import without_near_duplicates
from lodestrand.llm.language import with_known_language
from lodestrand.llm.linededup import line_dedup
from lodestrand.llm.packing import TOKENIZER, pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in which no language is found, go.

    Null and empty texts have no letter. Repeated rows, null ids and texts of any length are judged each by its whole text alone; the
    network learns from a bounded sample of rows with a language, and where none has one all documents go."""
    return with_known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters that 5 documents hold stay in the last of these alone.

    Null texts stay null. Rows that share an id are one document; those with the largest all keep the line, and a null id is
    smaller than any other. Rows are never dropped, however little is left of their text."""
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays.

    It is the first in the table's order, whatever its id, null ones and repeated rows too. Texts without words are near
    nothing but texts of the same bytes; null and empty ones are copies of each other."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; so do repeated rows, each judged alone. Items without words are not looked for; those
    without an id are."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, each a piece of one document whose length is a power of two.

    Null and empty texts are their end id alone; repeated rows are packed one by one; a null id stays null; longer texts have more pieces."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: No SQL: a trained network and a tokenizer decide. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
