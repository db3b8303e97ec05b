"""The engine: index a folder, search it, and look after its collections."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.config import Settings
from lodestrand.functions import ids
from lodestrand.operators import chunking, fusion, manifests, vector_search
from lodestrand.operators.lexical_index import LexicalIndex
from lodestrand.plans import segments
from lodestrand.sources import files as F_
from lodestrand.sources import remote
from lodestrand.sources import store as S
from lodestrand.sources.embedding import Embedder, HttpEmbedder, embed_chunks

IDLE, INDEXING, COMPLETED, FAILED = "idle", "indexing", "completed", "failed"
DEFAULT_LIMIT = 10
HIT = ["file_path", "relative_path", "content", "start_line", "end_line", "language", "score"]


@dataclass
class IndexStatus:
    total_files: int = 0
    processed_files: int = 0
    total_chunks: int = 0
    embeddings_generated: int = 0
    vectors_inserted: int = 0
    status: str = IDLE


@dataclass
class IndexResult:
    files: int
    chunks: int
    embeddings: int
    vectors: int
    lexical_only: bool
    duration_ms: int
    message: str = ""
    warnings: list[str] = field(default_factory=list)


class Busy(RuntimeError):
    """Another run indexes the same path."""


class Engine:
    """Indexing and search over one workspace.

    Without an embedder (and without a service in the settings) search is lexical only. An embedder
    that fails makes a search fail."""

    def __init__(self, spark: SparkSession, workspace: str, settings: Settings | None = None, embedder: Embedder | None = None, home: str | None = None, lock_seconds: float = S.LOCK_SECONDS):
        self.spark, self.settings, self.home, self.lock_seconds = spark, settings or Settings(), home, lock_seconds
        self.store = S.Store(spark, workspace)
        #: Where vectors are, if not in the workspace.
        self.service = remote.VectorService(self.settings.vector_url, self.settings.vector_token) if self.settings.vector_url else None
        self.embedder = embedder or (HttpEmbedder.of(self.settings, spark.sparkContext.defaultParallelism) if self.settings.embedding_url else None)

    @classmethod
    def from_environment(cls, spark: SparkSession, workspace: str) -> Engine:
        return cls(spark, workspace, Settings.from_environment())

    # Names

    def name_of(self, path: str) -> str:
        """The collection of a path."""
        return self.spark.range(1).select(ids.collection_name(F.lit(path))).first()[0]

    def _collection(self, path: str) -> S.Collection:
        return S.Collection(self.store, self.name_of(path))

    @staticmethod
    def _absolute(path: str) -> str:
        if not path.startswith("/"):
            raise ValueError(f"the path must be absolute: {path}")
        return path

    def inputs(self) -> dict:
        """What an index depends on beside the files: a change of it means a full run."""
        split = self.settings.split
        return {
            "chunk_size": split.max_chunk_bytes,
            "overlap_lines": split.overlap_lines,
            "min_chunk_lines": split.min_chunk_lines,
            "target_chunk_lines": split.target_chunk_lines,
            "extensions": list(self.settings.extensions),
            "ignore_patterns": list(self.settings.ignore_patterns),
            "embedder": self.embedder.name if self.embedder else None,
            "dimension": self.embedder.dimension if self.embedder else None,
            "service": self.settings.vector_url,
        }

    # Indexing

    def index(self, path: str, force: bool = False) -> IndexResult:
        """Bring the path's index up to date. Only new and modified files are split and embedded;
        rows of modified and deleted ones go. force, other inputs or no index yet: all files.

        Files whose bytes are no text give a warning, and are not tried again until they change."""
        began = time.time()
        root = str(F_.checked_root(path))
        name = self.name_of(root)
        lock = S.Lock(self.store, f"{name}.lock", self.lock_seconds)
        if not lock.take({"path": root}):
            raise Busy(f"{root} is being indexed")
        collection = S.Collection(self.store, name, lock.ours)
        try:
            collection.refresh()
            self._save_status(collection, IndexStatus(status=INDEXING))
            result, status = self._run(root, collection, force)
        except BaseException:
            self._save_status(collection, IndexStatus(status=FAILED))
            raise
        finally:
            lock.give_back()
        self._save_status(collection, status)
        result.duration_ms = int((time.time() - began) * 1000)
        return result

    def _run(self, root: str, collection: S.Collection, force: bool) -> tuple[IndexResult, IndexStatus]:
        paths = F_.walk(root, self.settings, self.home)
        files = F_.read(self.spark, root, paths)
        current = manifests.fingerprints(files, content="bytes").persist()
        held = [current]
        try:
            before = None if force or not collection.exists or collection.header.get("inputs") != self.inputs() else collection.table("manifest")
            changes = None
            if before is not None:
                changes = manifests.diff(before, current).persist()
                held.append(changes)
                if changes.isEmpty():
                    counts = collection.header["counts"]
                    status = IndexStatus(len(paths), len(paths), counts["chunks"], 0, 0, COMPLETED)
                    return IndexResult(len(paths), 0, 0, 0, self.embedder is None, 0, "already up to date"), status
            work = files if changes is None else manifests.changed(files, changes)
            self._save_status(collection, IndexStatus(total_files=len(paths), status=INDEXING))
            warnings = [r.relative_path for r in F_.unreadable(work).orderBy("relative_path").collect()]
            chunks = chunking.split(F_.texts(work), self.settings.split).persist()
            held.append(chunks)
            n_chunks = chunks.count()
            self._save_status(collection, IndexStatus(len(paths), len(paths), n_chunks, status=INDEXING))
            # Only new rows are written; those of changed and deleted files become void by their paths.
            tables = {"manifest": current if changes is None else manifests.changed(current, changes), "chunks": chunks}
            tables |= segments.lexical_tables(chunks)
            n_vectors = 0
            if self.embedder is not None:
                n_vectors = n_chunks
                if self.service is None:
                    tables["vectors"] = embed_chunks(chunks, self.embedder)
            facts = {"path": root, "inputs": self.inputs(), "counts": {"files": len(paths), "chunks": n_chunks}}
            stale = None if changes is None else manifests.stale(changes)
            gone = None if stale is None else segments.gone_tables(collection, stale)
            if self.embedder is not None and self.service is not None:
                self._send(collection.name, chunks, stale)
            collection.append(tables, stale, facts, segments.WRITERS, segments.DERIVED, gone)
            # The chunks that count are a sum that the index keeps.
            collection.header["counts"]["chunks"] = segments.sums(collection).corpus[0]
            self.store.save(f"{collection.name}/current.json", collection.header)
        finally:
            for df in held:
                df.unpersist()
        result = IndexResult(len(paths), n_chunks, n_vectors, n_vectors, self.embedder is None, 0, "indexed", warnings)
        return result, IndexStatus(len(paths), len(paths), n_chunks, n_vectors, n_vectors, COMPLETED)

    def _send(self, name: str, chunks: DataFrame, stale: DataFrame | None) -> None:
        """Bring the service's collection up to date; a run that fails after this is done again over the same files, as the manifest is not written yet."""
        if stale is None or not self.service.has(name):
            self.service.drop(name)
            self.service.create(name, self.embedder.dimension)
        paths = chunks.select("relative_path").distinct()
        remote.delete_paths(paths if stale is None else paths.union(stale.select("relative_path")).distinct(), self.service, name)
        remote.append(embed_chunks(chunks, self.embedder), self.service, name)

    # Search

    def search(self, path: str, query: str, limit: int = DEFAULT_LIMIT, extensions: Iterable[str] = (), prefilter: bool = False, strict: bool = False, dedupe: bool = True) -> DataFrame:
        """The best chunks: file_path, relative_path, content, start_line, end_line, language, score.

        Each leg gives its `limit` best, then the extension filter and the fusion follow, so fewer
        hits than limit may remain; prefilter=True filters before the legs are cut."""
        root = str(F_.checked_root(path))
        if limit < 1:
            raise ValueError("the limit must be at least 1")
        wanted = list(extensions)
        collection = self._collection(root)
        chunks, vectors = collection.table("chunks"), collection.table("vectors")
        legs = []
        empty = self.spark.createDataFrame([], chunking.CHUNK).withColumn("score", F.lit(0.0))
        if self.embedder is not None:
            asked = self.embedder.embed([query])[0]
            if self.service is not None:
                # The service knows no extensions: its best are filtered after they are found.
                legs.append(remote.top_k(self.spark, self.service, collection.name, asked, limit))
            else:
                legs.append(self._semantic(vectors, asked, limit, wanted if prefilter else []) if vectors is not None else empty)
        else:
            legs.append(empty)
        legs.append(self._lexical(collection, chunks, query, limit, wanted if prefilter else [], strict) if chunks is not None else empty)
        hits = fusion.fuse_chunks(legs[0], legs[1], limit, wanted, dedupe)
        path_column = F.when(F.col("file_path") == "", F.concat(F.lit(root.rstrip("/") + "/"), F.col("relative_path"))).otherwise(F.col("file_path"))
        return hits.withColumn("file_path", path_column).select(HIT)

    @staticmethod
    def _semantic(vectors: DataFrame, asked: list[float], limit: int, wanted: list[str]) -> DataFrame:
        rows = fusion.filtered(vectors, wanted)
        best = vector_search.top_k(rows, asked, limit, vector_id="chunk_id", vector="vector")
        return rows.join(F.broadcast(best.withColumnRenamed("vec_id", "chunk_id")), "chunk_id").select(*chunking.COLUMNS, "score")

    @staticmethod
    def _lexical(collection: S.Collection, chunks: DataFrame, query: str, limit: int, wanted: list[str], strict: bool) -> DataFrame:
        """The postings of the query's terms are read, and then the hits' chunks. A filter before the search has statistics of its own."""
        if wanted:
            best = LexicalIndex(fusion.filtered(collection.table("postings"), wanted), fusion.filtered(collection.table("lengths"), wanted)).search(query, limit, strict)
        else:
            best = segments.search(collection, query, limit, strict)
        rows = fusion.filtered(chunks, wanted)
        # The lexical leg knows no file_path; fusion or the search fills it in.
        return rows.join(F.broadcast(best.withColumnRenamed("doc_id", "chunk_id")), "chunk_id").withColumn("file_path", F.lit("")).select(*chunking.COLUMNS, "score")

    # Administration

    def _save_status(self, collection: S.Collection, status: IndexStatus) -> None:
        self.store.save(f"{collection.name}.status.json", asdict(status))

    def status(self, path: str) -> IndexStatus:
        found = self.store.load(f"{self.name_of(self._absolute(path))}.status.json")
        return IndexStatus(**found) if found else IndexStatus()

    def clear(self, path: str) -> None:
        """Remove the path's tables, its manifest and its status."""
        collection = self._collection(self._absolute(path))
        collection.drop()
        if self.service is not None:
            self.service.drop(collection.name)
        self.store.delete(f"{collection.name}.status.json")

    def list_collections(self) -> DataFrame:
        """(name, row_count): vectors, or chunks where nothing is embedded."""
        found = {name: self._rows(S.Collection(self.store, name)) for name in self.store.names() if self.store.exists(f"{name}/current.json")}
        return S.row_counts(self.spark, found)

    @staticmethod
    def _rows(collection: S.Collection) -> DataFrame | None:
        vectors = collection.table("vectors")
        return vectors if vectors is not None else collection.table("chunks")

    def collection_stats(self, name: str) -> int:
        """The number of rows; 0 for a collection that is not there."""
        rows = self._rows(S.Collection(self.store, name))
        return 0 if rows is None else rows.count()

    def drop_collection(self, name: str) -> bool:
        """Whether it was there."""
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"no name of a collection: {name!r}")
        self.store.delete(f"{name}.status.json")
        gone = self.service.drop(name) if self.service is not None else False
        return S.Collection(self.store, name).drop() or gone


