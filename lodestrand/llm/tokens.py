"""Tokenising whole texts with a public tokenizers file, through a memo of the chunks between spaces.

Texts are cut where the tokenizer's own rules always cut, the library encodes each distinct chunk
once per worker, and a text's ids are its chunks' ids put together. Chunks of words and signs are
cut further, so that the library gets a word once, whatever stands behind it. Texts that may hold anything
for which that is not proven (special strings, white space beside white space, characters that
normalisation may join) go through the library whole. So the ids are always the library's.
"""

from __future__ import annotations

import os
import re
import string
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from lodestrand.llm import common

#: Chunks that a worker remembers at most; later ones are encoded anew with each batch.
MEMO = 750_000

#: Rows that are encoded together, up to common.BATCH_BYTES: the more, the fewer distinct chunks a text has.
ROWS = 4096
#: Words that the library gets as one text.
TOGETHER = 1024

#: Signs that stand behind words, and words whose letters all libraries know for letters: pre-tokens of both kinds of vocabulary
#: begin at such a word, at the signs after it and at a line's end.
_SIGNS = string.punctuation
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+\\Z").match

#: Characters that NFC leaves alone whatever stands beside them, and white space as all libraries see it.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*\\Z")

# A Spark task has one core.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class Chunked:
    """Ids of texts, as bytes of little-endian numbers of the given width.

    The texts of a call are cut and their distinct chunks found in Arrow's code; each distinct chunk is looked up
    once, and the ids of all of them are gathered at once from a pool."""

    def __init__(self, path: str, lowered: bool, dtype: str, memo: int = MEMO):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Lower-case vocabularies cut at any white space; others only at a space alone between two other characters.
        self.lowered, self.dtype, self.limit = lowered, dtype, memo
        self.unsafe = re.compile(r"\s\s")
        #: Which ids begin a word after a space, or end a word: with these, words encoded as one text are told apart.
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(1 + max(vocabulary.values()), bool)
        self.edge[[k for x, k in vocabulary.items() if (x.endswith("</w>") if lowered else x.startswith("Ġ"))]] = True
        #: Entries of words, signs and chunks with the space before them, and of what has none: texts' first chunks, signs, lines' first words.
        self.memo: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        #: An entry's ids lie in the pool, from its start on. The entries up to `kept` stay for later calls.
        self.starts, self.sizes, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, dtype)
        self.entries = self.used = self.kept = self.kept_ids = 0

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of all texts, and how many each has."""
        coded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(x.ids for x in coded), self.dtype, int(sizes.sum())), sizes

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _encode, of words of letters with the space before them: many as one text, as the library cuts between them."""
        ids, _ = self._encode(["".join(f" {x}" for x in words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)])
        edges = np.flatnonzero(self.edge[ids])
        sizes = np.diff(edges + 1, prepend=0) if self.lowered else np.diff(edges, append=len(ids))
        if len(sizes) == len(words) and sizes.sum() == len(ids):
            return ids, sizes
        return self._encode([x if self.lowered else f" {x}" for x in words])

    def chunks(self, text: str) -> str | None:
        """The text as it may be cut at its spaces (or all white space), so that the library may encode the chunks one by one, all but
        the first of them with a space before; None where only the whole text is safe."""
        # The library looks for special strings before it lowers a text: one that only lowering makes must not reach it as a chunk.
        small = text.lower() if self.lowered else text
        if any(x in text or x in small for x in self.specials):
            return None
        if self.lowered:
            return small if _PLAIN.match(text) else None
        return None if self.unsafe.search(text) else text

    def _add(self, names: list[str], flat: np.ndarray, sizes: np.ndarray, memo: dict[str, int]) -> dict[str, int]:
        """Entries for chunks that have none, of so many of the ids each; they are remembered while there is room."""
        first, n = self.entries, len(names)
        while first + n > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.starts[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + n] = sizes
        self.pool[self.used : self.used + len(flat)] = flat
        self.entries, self.used = first + n, self.used + len(flat)
        new = dict(zip(names, range(first, first + n), strict=True))
        # Entries that stay lie before those that go.
        if self.kept == first and len(memo) + n <= self.limit:
            memo.update(new)
            self.kept, self.kept_ids = self.entries, self.used
        return new

    def _known(self, chunks: set[str], memo: dict[str, int], space: str) -> dict[str, int]:
        """The entries of words, signs and uncut chunks, from the memo or the library."""
        known = {x: memo[x] for x in chunks if x in memo}
        missing = [x for x in chunks if x not in known]
        words = [x for x in missing if x.isalpha()] if memo is self.memo else []
        if words:
            known.update(self._add(words, *self._encode_words(words), memo))
            missing = [x for x in missing if x not in known]
        if missing:
            known.update(self._add(missing, *self._encode([space + x for x in missing]), memo))
        return known

    def _gathered(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries one behind the other, and where each begins (and the last ends)."""
        sizes = self.sizes[entries]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.pool[np.repeat(self.starts[entries] - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def _missing(self, chunks: list[str], space: str) -> dict[str, int]:
        """Entries of chunks with the space before them that are not remembered; the ids of words and signs are put together from their parts'."""
        words, bare, cut = set(), set(), []
        for x in chunks:
            if x.isalpha():
                words.add(x)
                continue
            line, end, rest = x.partition("\n")
            word = line.rstrip(_SIGNS)
            if not _WORD(word) or end and not _WORD(rest.rstrip(_SIGNS)):
                words.add(x)
                continue
            words.add(word)
            if end:
                other = rest.rstrip(_SIGNS)
                cut.append((x, word, line[len(word) :], end, other, rest[len(other) :]))
                bare.update(cut[-1][2:])
            else:
                cut.append((x, word, line[len(word) :]))
                bare.add(cut[-1][2])
        known, heads = self._known(words, self.memo, space), self._known(bare, self.heads, "")
        parts = np.fromiter((entry for x in cut for entry in (known[x[1]], *map(heads.__getitem__, x[2:]))), np.int64)
        ids, ends = self._gathered(parts)
        # A chunk ends with its last part.
        last = ends[np.cumsum(np.fromiter((len(x) - 1 for x in cut), np.int64, len(cut)))]
        known.update(self._add([x[0] for x in cut], ids, np.diff(last, prepend=0), self.memo))
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        self.entries, self.used = self.kept, self.kept_ids
        ready = [self.chunks(x) for x in texts]
        whole = [k for k, x in enumerate(ready) if x is None]
        rows = pa.array([x for x in ready if x is not None], pa.large_string())
        cut = pc.ascii_split_whitespace(rows) if self.lowered else pc.split_pattern(rows, " ")
        flat, bounds = cut.flatten(), cut.offsets.to_numpy()
        coded = flat.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        space = "" if self.lowered else " "
        get = self.memo.get
        found = [get(x, -1) for x in names]
        if missing := [x for x, entry in zip(names, found, strict=True) if entry < 0]:
            new = self._missing(missing, space)
            found = [new[x] if entry < 0 else entry for x, entry in zip(names, found, strict=True)]
        which = np.array(found, np.int64)[coded.indices.to_numpy()]
        if not self.lowered and len(rows):
            first = flat.take(pa.array(bounds[:-1])).to_pylist()
            heads = self._known(set(first), self.heads, "")
            which[bounds[:-1]] = [heads[x] for x in first]
        ids, ends = self._gathered(which)
        ends = ends[bounds]
        own = iter(range(len(rows)))
        out = [b"" if x is None else ids[ends[k := next(own)] : ends[k + 1]].tobytes() for x in ready]
        if whole:
            ids, sizes = self._encode([texts[k] for k in whole])
            for k, x in zip(whole, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                out[k] = x.tobytes()
        return out


@lru_cache(maxsize=4)
def _chunked(path: str, lowered: bool, dtype: str) -> Chunked:
    return Chunked(common.local_file(path), lowered, dtype)


common.remembers(__name__, _chunked.cache_clear)


def chunked(path: str, lowered: bool, dtype: str) -> Chunked:
    """The worker's encoder; it and its memo serve all tasks of the worker, until it turns to other work."""
    common.turn_to(__name__)
    return _chunked(path, lowered, dtype)
