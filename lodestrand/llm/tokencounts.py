"""Token counts by the whole-token shortcut.

Before any text is read, each string of the vocabulary is tried with the library: those that encode
alone to the one token are proven whole tokens. A text is cut into pre-tokens; each that is proven
counts one, and only the rest are merged by the library, each distinct one once per worker.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted one by
one; an empty table gives an empty one; extra columns are left alone. Special strings inside texts
count as the library takes them by default; such texts, and texts with two white space characters
in a row, are cut as a whole, all others first at single spaces, where pre-tokens always begin. A vocabulary that
cuts or normalises texts in another way than PRE_TOKENS is refused with a ValueError.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lodestrand.llm import common
from lodestrand.llm.tokens import MEMO

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512

#: Fixed value: the pattern that splits text into pre-tokens in byte-level vocabularies.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def whole_tokens(vocabulary: str) -> frozenset[str]:
    """The strings that the library encodes alone as one token, tried one by one."""
    library = Tokenizer.from_file(vocabulary)
    rules = json.loads(library.to_str())
    cut = rules["pre_tokenizer"] or {}
    if rules["normalizer"] is not None or (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) != ("ByteLevel", True, False):
        raise ValueError(f"{vocabulary} does not cut texts by the pattern of byte-level vocabularies alone")
    ids = sorted(set(library.get_vocab(with_added_tokens=False).values()))
    special = set(library.get_added_tokens_decoder())
    strings = [library.decode([x], skip_special_tokens=False) for x in ids if x not in special]
    strings = [x for x in strings if x and "�" not in x]
    coded = library.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(x for x, c in zip(strings, coded, strict=True) if len(c.ids) == 1)


class Counter:
    """Token counts of texts."""

    def __init__(self, vocabulary: str, proven: frozenset[str], memo: int = MEMO):
        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split = regex.compile(PRE_TOKENS).findall
        self.spaces = regex.compile(r"\s\s").search
        #: Characters on which libraries may differ about letters, numbers and white space.
        self.odd = regex.compile(r"[\x1c-\x1f\x85]|\p{Cn}|\p{Co}").search
        self.proven, self.limit = proven, memo
        self.memo: dict[str, int] = {}

    def _merged(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def count(self, texts: list[str]) -> list[int]:
        out, cuts, whole = [0] * len(texts), [], []
        for k, text in enumerate(texts):
            if any(x in text for x in self.specials) or self.odd(text):
                whole.append(k)
            elif self.spaces(text):
                cuts.append((k, self.split(text)))
            else:
                first, *rest = text.split(" ")
                cuts.append((k, [first, *(f" {x}" for x in rest)]))
        memo, proven = self.memo, self.proven
        new = {x for _, c in cuts for x in c if x not in memo and x not in proven}
        # A chunk that is no proven token: its pre-tokens, and of those the ones to be merged.
        parts = {x: self.split(x) for x in new}
        rest = list({p for c in parts.values() for p in c if p not in proven and p not in memo})
        merged = dict(zip(rest, self._merged(rest), strict=True))
        known = {x: sum(1 if p in proven else merged[p] if p in merged else memo[p] for p in c) for x, c in parts.items()}
        if len(memo) + len(known) <= self.limit:
            memo |= known
        for k, c in cuts:
            out[k] = sum(1 if x in proven else known[x] if x in known else memo[x] for x in c)
        for k, n in zip(whole, self._merged([texts[k] for k in whole]), strict=True):
            out[k] = n
        return out


@lru_cache(maxsize=4)
def _counter(vocabulary: str, proven: frozenset[str]) -> Counter:
    return Counter(common.local_file(vocabulary), proven)


common.remembers(__name__, _counter.cache_clear)


COUNTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", added: T.StructType = COUNTS, drop: Iterable[str] = ()) -> DataFrame:
    """docs with the bytes and tokens of each text; no shuffle."""
    spark = common.prepare(docs.sparkSession)
    proven = spark.sparkContext.broadcast(whole_tokens(vocabulary))

    def make() -> Callable[[list], Iterable[tuple]]:
        counter = _counter(vocabulary, proven.value)

        def work(texts: list) -> Iterable[tuple]:
            return zip((len(x or b"") for x in texts), counter.count([common.text_of(x) for x in texts]), strict=True)

        return work

    return common.append_columns(docs, text, make, added, drop)


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = common.documents(spark, sf_dir).select("doc_id", common.utf8("text").alias("text"))
    counted = token_counts(docs, vocabulary or public_tokenizers.path(TOKENIZER), drop=["text"])
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
