"""Embedders: texts to vectors, in Arrow batches.

An embedder has a name, a dimension, and embed(texts) -> vectors; it is sent to the executors.
HashedEmbedder needs no service and gives equal vectors everywhere. HttpEmbedder posts to a service;
its limits are shared out over the partitions that call it.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.config import Settings
from lodestrand.functions import ids
from lodestrand.operators.lexical import query_terms
from lodestrand.shipping import ship

#: Chunks that are embedded together, attempts, and the service's time limit in seconds.
CHUNKS_PER_BATCH = 100
ATTEMPTS = 6
TIMEOUT = 120


class Embedder(Protocol):
    name: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class HashedEmbedder:
    """Signed hashes of a text's terms, of length 1."""

    dimension: int = 384

    @property
    def name(self) -> str:
        return f"hashed-{self.dimension}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        import xxhash

        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for term in query_terms(text):
                h = xxhash.xxh3_64_intdigest(term)
                row[h % self.dimension] += 1 if h >> 63 else -1
            length = float(np.sqrt((row * row).sum()))
            if length:
                row /= length
        return out.tolist()


@dataclass
class Throttle:
    """Requests and tokens a minute; 0 is no limit. A cost above a whole minute's waits for a full store."""

    per_minute: float
    level: float = field(default=-1.0)
    at: float = 0.0

    def wait(self, cost: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        if self.per_minute <= 0:
            return
        cost = min(cost, self.per_minute)
        now = clock()
        self.level = self.per_minute if self.level < 0 else min(self.per_minute, self.level + (now - self.at) * self.per_minute / 60)
        self.at = now
        if self.level < cost:
            sleep((cost - self.level) * 60 / self.per_minute)
            self.level, self.at = cost, clock()
        self.level -= cost

    def drain(self) -> None:
        self.level = 0.0 if self.per_minute > 0 else self.level


@dataclass
class HttpEmbedder:
    """A service that takes {"input": [...], "model": ...} and returns {"data": [{"embedding": [...]}]}."""

    url: str
    model: str
    dimension: int
    api_key: str | None = None
    batch_size: int = 32
    requests: Throttle = field(default_factory=lambda: Throttle(400))
    tokens: Throttle = field(default_factory=lambda: Throttle(1_600_000))
    sleep: Callable[[float], None] = time.sleep

    @property
    def name(self) -> str:
        return self.model

    @classmethod
    def of(cls, settings: Settings, partitions: int = 1) -> HttpEmbedder:
        url = (settings.embedding_url or "").rstrip("/")
        url = url if url.endswith("/embeddings") else f"{url}/embeddings" if url.endswith("/v1") else f"{url}/v1/embeddings"
        share = max(partitions, 1)
        return cls(
            url, settings.embedding_model, settings.embedding_dimension, settings.embedding_api_key, settings.batch_size,
            Throttle(settings.embedding_rpm / share), Throttle(settings.embedding_tpm / share),
        )

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for k in range(0, len(texts), self.batch_size):
            out += self._post(texts[k : k + self.batch_size])
        return out

    def _post(self, texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        body = json.dumps({"input": texts, "model": self.model}).encode()
        for attempt in range(ATTEMPTS):
            self.requests.wait(1)
            self.tokens.wait(sum(len(x.encode()) // 4 for x in texts))
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=TIMEOUT) as answer:
                    found = [row["embedding"] for row in json.load(answer)["data"]]
                if len(found) != len(texts):
                    raise ValueError(f"{len(texts)} texts were sent and {len(found)} vectors came back")
                return found
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500 or attempt + 1 == ATTEMPTS:
                    raise
                self.requests.drain()
                after = e.headers.get("Retry-After", "")
                self.sleep(float(after) if after.isdigit() else 2.0**attempt)
            except (urllib.error.URLError, TimeoutError):
                if attempt + 1 == ATTEMPTS:
                    raise
                self.sleep(2.0**attempt)
        raise AssertionError


VECTORS = T.StructType(
    [
        T.StructField("vector_id", T.LongType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("file_path", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("language", T.StringType()),
    ]
)


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """A vector row per chunk. A batch with fewer or more vectors than texts, or a vector of another length, fails."""
    ship(chunks.sparkSession)
    rows = chunks.select(ids.vector_id(F.col("chunk_id")).alias("vector_id"), *(c for c in VECTORS.names if c not in ("vector_id", "vector")))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNKS_PER_BATCH):
                part = batch.slice(k, CHUNKS_PER_BATCH)
                texts = part.column(names.index("content")).to_pylist()
                found = embedder.embed(texts)
                if len(found) != len(texts) or any(len(v) != embedder.dimension for v in found):
                    raise ValueError(f"the embedder {embedder.name} returned vectors of another number or length")
                columns = {n: part.column(names.index(n)) for n in names} | {"vector": pa.array(found, pa.list_(pa.float32()))}
                yield pa.RecordBatch.from_arrays([columns[n] for n in VECTORS.names], names=VECTORS.names)

    return rows.mapInArrow(run, VECTORS)
