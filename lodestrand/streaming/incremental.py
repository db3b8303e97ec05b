"""Indexing as rows arrive: file versions from a stream are merged into a collection that the engine can search.

Each path's newest version counts, whatever batch it arrives in: the versions that a collection has taken up are a table of
its segments, deletions included, and a row that is not newer than what is known of its path is left out. A micro-batch adds a segment with the new rows of
paths whose bytes changed, and makes their old rows void. So batches that arrive in another order, or twice, give the rows of one run over
all of them. The header has the batch's number as well: a batch that runs again after a failure, from Structured Streaming's checkpoint, is taken up once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lodestrand.config import PIPELINE, SplitConfig
from lodestrand.operators import chunking
from lodestrand.plans import segments
from lodestrand.sources.embedding import Embedder, embed_chunks
from lodestrand.sources.store import LOCK_SECONDS, Collection, Lock, Lost, Store


def newest(batch: DataFrame) -> DataFrame:
    """(relative_path, version, sha256, content): of each path the row of the highest version, and of equal ones that of the
    greatest hash. A null content deletes, and gives way to an equal version with one; a null version is older than all."""
    prints = F.coalesce(F.sha2(F.col("content").cast("binary"), 256), F.lit(""))
    order = F.struct(F.coalesce("version", F.lit(-(1 << 63))).cast("long").alias("version"), prints.alias("sha256"))
    last = batch.groupBy("relative_path").agg(F.max(order).alias("at"), F.max_by(F.struct("content"), order).alias("row"))
    return last.select("relative_path", "at.version", "at.sha256", F.col("row.content").alias("content"))


OBSERVED = "taken_up"
COUNTERS = ("batches", "rows", "texts", "bytes")


class _Listener(StreamingQueryListener):
    """Adds up what each batch has observed while it ran, without a job of its own, and writes the sums to a small file that any process may read."""

    def __init__(self, store: Store, path: str):
        self.store, self.path, self.queries = store, path, set()
        self.sums = {**dict.fromkeys(COUNTERS, 0), **(store.load(path) or {})}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        found = event.progress.observedMetrics.get(OBSERVED)
        if str(event.progress.id) in self.queries and found is not None and event.progress.batchId > self.sums.get("batch", -1):
            self.sums |= {"batch": event.progress.batchId, "batches": self.sums["batches"] + 1} | {c: self.sums[c] + int(found[c] or 0) for c in COUNTERS[1:]}
            self.store.save(self.path, self.sums)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass


class StreamIndex:
    """Merges versions (relative_path, content, version) into a collection; a null content deletes."""

    def __init__(self, spark: SparkSession, workspace: str, name: str, split: SplitConfig = PIPELINE, embedder: Embedder | None = None, lock_seconds: float = LOCK_SECONDS):
        self.spark, self.split, self.embedder, self.lock_seconds = spark, split, embedder, lock_seconds
        self.store = Store(spark, workspace)
        self.collection = Collection(self.store, name)
        self._listener: _Listener | None = None

    def merge(self, batch: DataFrame, number: int) -> None:
        """Take up a micro-batch, unless it has been. Only one run at a time may change a collection; Lost: another does now."""
        lock = Lock(self.store, f"{self.collection.name}.lock", self.lock_seconds)
        if not lock.take({"batch": number}):
            raise Lost(f"{self.collection.name} is being indexed by another run")
        self.collection.owned = lock.ours
        try:
            self.collection.refresh()
            if not self.collection.exists or self.collection.header.get("batch", -1) < number:
                self._merge(batch, number)
        finally:
            lock.give_back()

    def _merge(self, batch: DataFrame, number: int) -> None:
        before = self.collection.table("versions")
        new, gone = newest(batch), None
        if before is not None:
            known = before.groupBy("relative_path").agg(F.max(F.struct("version", "sha256")).alias("known"))
            new = new.join(known, "relative_path", "left").where(F.col("known").isNull() | (F.struct("version", "sha256") > F.col("known")))
            new = new.withColumn("held", F.coalesce("known.sha256", F.lit(""))).drop("known")
        else:
            new = new.withColumn("held", F.lit(""))
        new = new.persist()
        chunks = None
        try:
            changed = new.where(F.col("sha256") != F.col("held"))
            if before is not None:
                gone = changed.where("held <> ''").select("relative_path")
            files = changed.where("sha256 <> ''")
            chunks = chunking.split(files.select("relative_path", "content"), self.split).persist()
            tables = {"manifest": files.select("relative_path", "sha256"), "versions": new.select("relative_path", "version", "sha256"), "chunks": chunks}
            tables |= segments.lexical_tables(chunks)
            if self.embedder is not None:
                tables["vectors"] = embed_chunks(chunks, self.embedder)
            sums = None if gone is None else segments.gone_tables(self.collection, gone)
            self.collection.append(tables, gone, {"batch": number}, segments.WRITERS, segments.DERIVED, sums)
        finally:
            new.unpersist()
            if chunks is not None:
                chunks.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Follow a stream of versions; once: what is there now, and then end. progress() tells meanwhile what has been taken up."""
        counted = stream.observe(OBSERVED, F.count("*").alias("rows"), F.count("content").alias("texts"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
        if self._listener is None:
            self._listener = _Listener(self.store, self.status_path)
            self.spark.streams.addListener(self._listener)
        query = self._started(counted, checkpoint, once)
        self._listener.queries.add(str(query.id))
        return query

    def _started(self, stream: DataFrame, checkpoint: str, once: bool) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

    @property
    def status_path(self) -> str:
        return f"{self.collection.name}.stream.json"

    def progress(self) -> dict:
        """batches, rows, texts and bytes that the stream has brought since it was first started, as last written by the listener."""
        return self.store.load(self.status_path) or dict.fromkeys(COUNTERS, 0)

    def stop_listening(self) -> None:
        if self._listener is not None:
            self.spark.streams.removeListener(self._listener)
            self._listener = None

    def chunks(self) -> DataFrame | None:
        self.collection.refresh()
        return self.collection.table("chunks")
