"""Collections in a vector service: a Spark data source that reads and writes them, and searches by the service.

spark.read.format("remote_collection") reads ranges of ids in parallel and hands filters on vector_id and relative_path to the service.
df.write.format("remote_collection").mode("append") inserts batches of rows that carry the write's and the attempt's name: when the
write commits, rows of attempts that do not count are deleted, and when it aborts, all of its rows, so a failed task leaves none.
Options of both: url, token, collection; partitions and page for reading.

The service speaks JSON over HTTP: {"code": 0, "data": ...}. Its filters are comparisons, `in` and `and`, with strings quoted as in JSON.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import datasource as D

from lodestrand.operators import chunking
from lodestrand.shipping import ship
from lodestrand.sources.embedding import VECTORS

FORMAT = "remote_collection"
RETRIES = 3
TIMEOUT = 60.0
BATCH_ROWS = 500
PATHS_A_FILTER = 100
#: Ids are numbers from 0 on below this.
IDS = 1 << 63
#: What a row keeps beside its id, text and vector.
FACTS = [n for n in VECTORS.names if n not in ("vector_id", "content", "vector")]


class ServiceError(RuntimeError):
    """The service has answered with an error."""


def any_of(name: str, values: Iterable) -> str:
    """A filter for some values; strings are quoted as in JSON."""
    return f"{name} in [{', '.join(json.dumps(v, ensure_ascii=False) for v in values)}]"


@dataclass
class VectorService:
    """Calls of a vector service. Failures that may pass (429, 5xx, no connection) are tried again, three times, after 0.5, 1 and 2 seconds."""

    url: str
    token: str | None = None
    database: str = "default"
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def call(self, path: str, **body: object) -> object:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        request = urllib.request.Request(f"{self.url.rstrip('/')}/v2/vectordb/{path}", json.dumps({"dbName": self.database, **body}).encode(), headers)
        for attempt in range(RETRIES + 1):
            try:
                with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                    found = json.load(answer)
                break
            except urllib.error.HTTPError as e:
                if attempt == RETRIES or e.code != 429 and e.code < 500:
                    raise
            except (urllib.error.URLError, TimeoutError):
                if attempt == RETRIES:
                    raise
            self.sleep(0.5 * 2**attempt)
        if found.get("code", 0) != 0:
            raise ServiceError(f"{path}: {found.get('message') or found['code']}")
        return found.get("data")

    def create(self, name: str, dimension: int) -> None:
        self.call("collections/create", collectionName=name, dimension=dimension, metricType="COSINE", primaryFieldName="id", vectorFieldName="vector")

    def has(self, name: str) -> bool:
        return bool((self.call("collections/has", collectionName=name) or {}).get("has"))

    def drop(self, name: str) -> bool:
        """Whether it was there."""
        found = self.has(name)
        if found:
            self.call("collections/drop", collectionName=name)
        return found

    def names(self) -> list[str]:
        return sorted(self.call("collections/list") or [])

    def count(self, name: str) -> int:
        return int((self.call("collections/get_stats", collectionName=name) or {}).get("rowCount", 0))

    def insert(self, name: str, rows: list[dict]) -> None:
        if rows:
            self.call("entities/insert", collectionName=name, data=rows)

    def delete(self, name: str, where: str) -> None:
        self.call("entities/delete", collectionName=name, filter=where)

    def query(self, name: str, where: str, limit: int, offset: int, fields: list[str]) -> list[dict]:
        return list(self.call("entities/query", collectionName=name, filter=where, limit=limit, offset=offset, outputFields=fields) or [])

    def search(self, name: str, vector: list[float], limit: int) -> list[dict]:
        """The nearest entities: those of the first query, whether the service groups hits by query or not."""
        found = list(self.call("entities/search", collectionName=name, data=[vector], annsField="vector", limit=limit, outputFields=["id", "content", "metadata"]) or [])
        return list(found[0]) if found and isinstance(found[0], list) else found


def entity(row: Row, **more: object) -> dict:
    """A row (a document with its vector) as the service keeps it."""
    return {"id": row["vector_id"], "content": row["content"], "vector": [float(x) for x in row["vector"]], "metadata": {n: row[n] for n in FACTS} | more}


def facts_of(found: dict) -> dict:
    """An entity's columns; what its metadata lacks is empty, or 0 for line numbers."""
    held = found.get("metadata") or {}
    held = json.loads(held) if isinstance(held, str) else held
    out = {n: held.get(n) if held.get(n) is not None else 0 if n.endswith("_line") else "" for n in FACTS}
    # Entities that others have written may have no chunk_id: their own id stands for it.
    return out | {"chunk_id": out["chunk_id"] or str(found["id"]), "content": found.get("content") or ""}


@dataclass
class IdRange(D.InputPartition):
    low: int
    high: int

    def __post_init__(self) -> None:
        super().__init__(self.low)


class CollectionReader(D.DataSourceReader):
    COMPARED = {D.EqualTo: "==", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}

    def __init__(self, service: VectorService, name: str, partitions: int, page: int):
        self.service, self.name, self.n, self.page = service, name, partitions, page
        self.where: list[str] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        """Comparisons of ids, and equality of paths, go to the service; all others come back to Spark."""
        for f in filters:
            column = {("vector_id",): "id", ("relative_path",): 'metadata["relative_path"]'}.get(getattr(f, "attribute", None))
            if column and isinstance(f, D.In):
                self.where.append(any_of(column, f.value))
            elif column and type(f) in self.COMPARED and (column == "id" or isinstance(f, D.EqualTo)):
                self.where.append(f"{column} {self.COMPARED[type(f)]} {json.dumps(f.value, ensure_ascii=False)}")
            else:
                yield f

    def partitions(self) -> list[IdRange]:
        bounds = [IDS * k // self.n for k in range(self.n + 1)]
        return [IdRange(a, b - 1) for a, b in zip(bounds, bounds[1:], strict=False)]

    def read(self, partition: IdRange) -> Iterator[tuple]:
        where = " and ".join([f"id >= {partition.low}", f"id <= {partition.high}", *self.where])
        offset = 0
        while found := self.service.query(self.name, where, self.page, offset, ["id", "content", "vector", "metadata"]):
            for x in found:
                own = facts_of(x) | {"vector_id": int(x["id"]), "vector": [float(v) for v in x["vector"]]}
                yield tuple(own[n] for n in VECTORS.names)
            offset += len(found)
            if len(found) < self.page:
                return


@dataclass
class Written(D.WriterCommitMessage):
    attempt: str


class CollectionWriter(D.DataSourceWriter):
    def __init__(self, service: VectorService, name: str):
        self.service, self.name, self.write_id = service, name, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        attempt, held = uuid.uuid4().hex, []
        for row in iterator:
            held.append(entity(row, write=self.write_id, attempt=attempt))
            if len(held) == BATCH_ROWS:
                self.service.insert(self.name, held)
                held = []
        self.service.insert(self.name, held)
        return Written(attempt)

    def _own(self) -> str:
        return f'metadata["write"] == {json.dumps(self.write_id)}'

    def commit(self, messages: list[Written | None]) -> None:
        """Rows of attempts that failed, or came second, go."""
        self.service.delete(self.name, f"{self._own()} and not ({any_of('metadata[\"attempt\"]', sorted(m.attempt for m in messages if m))})")

    def abort(self, messages: list[Written | None]) -> None:
        self.service.delete(self.name, self._own())


class RemoteCollection(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):  # noqa: ANN201
        return VECTORS

    def _service(self) -> VectorService:
        return VectorService(self.options["url"], self.options.get("token"))

    def reader(self, schema) -> CollectionReader:  # noqa: ANN001
        return CollectionReader(self._service(), self.options["collection"], int(self.options.get("partitions", 8)), int(self.options.get("page", 1000)))

    def writer(self, schema, overwrite: bool) -> CollectionWriter:  # noqa: ANN001
        return CollectionWriter(self._service(), self.options["collection"])


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(RemoteCollection)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def _options(service: VectorService, name: str) -> dict[str, str]:
    return {"url": service.url, "collection": name} | ({"token": service.token} if service.token else {})


def read(spark: SparkSession, service: VectorService, name: str, **options: object) -> DataFrame:
    return register(spark).read.format(FORMAT).options(**_options(service, name), **options).load()


def append(vectors: DataFrame, service: VectorService, name: str) -> None:
    register(vectors.sparkSession)
    vectors.select(VECTORS.names).write.format(FORMAT).options(**_options(service, name)).mode("append").save()


def delete_paths(paths: DataFrame, service: VectorService, name: str) -> None:
    """Delete the rows of relative paths, from the tasks that hold the paths; a task that runs again deletes nothing more."""
    ship(paths.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0).to_pylist()
            for k in range(0, len(held), PATHS_A_FILTER):
                service.delete(name, any_of('metadata["relative_path"]', held[k : k + PATHS_A_FILTER]))
        yield from ()

    paths.select("relative_path").where("relative_path is not null").mapInArrow(run, "n int").write.format("noop").mode("overwrite").save()


def top_k(spark: SparkSession, service: VectorService, name: str, vector: list[float], k: int) -> DataFrame:
    """Chunks and scores of the k nearest; none where there is no such collection."""
    hits = service.search(name, vector, k) if service.has(name) else []
    rows = [tuple(own[c] for c in chunking.COLUMNS) + (float(x.get("distance", x.get("score", 0.0))),) for x in hits for own in [facts_of(x)]]
    return spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c.endswith('_line') else 'string'}" for c in chunking.COLUMNS) + ", score double")
