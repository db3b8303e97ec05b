"""Walking, indexing, searching and administration on small trees."""

import json
import os
import random
import time

import pytest

from lodestrand.config import Settings
from lodestrand.operators import lexical, lexical_index, manifests
from lodestrand.plans import segments
from lodestrand.plans.engine import Busy, Engine
from lodestrand.sources import files as files_of
from lodestrand.sources import store as S
from lodestrand.sources.embedding import HashedEmbedder, HttpEmbedder, Throttle, embed_chunks
from lodestrand.streaming.incremental import StreamIndex


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    """Small indexes are written many times here: 4 folders each instead of 64."""
    monkeypatch.setattr(lexical_index, "BUCKETS", 4)


def tree(root, **texts):
    for name, text in texts.items():
        put(root, name, text)


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def walked(root, **settings):
    return [p[len(str(root)) + 1 :] for p in files_of.walk(str(root), Settings(**settings), home=str(root / ".home"))]


@pytest.mark.parametrize(
    ("files", "want"),
    [
        ({"main.rs": "", "x.log": "", ".hidden.py": "", ".d/a.py": "", "Dockerfile": "", "README": "", "A.RS": ""}, ["Dockerfile", "main.rs"]),
        ({".git/HEAD": "", ".gitignore": "*.js\n!keep.js\n", "a.js": "", "keep.js": "", "b.py": ""}, ["b.py", "keep.js"]),
        ({".gitignore": "*.js\n", "a.js": ""}, ["a.js"]),
        ({".git/HEAD": "", ".gitignore": "target/\n", "target/a.rs": "", "src/target/b.rs": "", "c.rs": ""}, ["c.rs"]),
        ({".git/HEAD": "", ".gitignore": "/only.py\nbuild/**\n", "only.py": "", "d/only.py": "", "build/x/y.js": ""}, ["d/only.py"]),
        ({".git/HEAD": "", ".gitignore": "*.py\n", "src/.gitignore": "!a.py\n*.rs\n", "src/a.py": "", "src/b.rs": "", "c.py": "", "d.rs": ""}, ["d.rs", "src/a.py"]),
        ({".contextignore": "generated/\n", "src/main.rs": "", "generated/o.rs": ""}, ["src/main.rs"]),
        ({".home/.context/.contextignore": "secret.*\n", "secret.py": "", "a.py": ""}, ["a.py"]),
        ({".git/HEAD": "", ".git/info/exclude": "x?.py\n", "xa.py": "", "xbc.py": ""}, ["xbc.py"]),
        ({".git/HEAD": "", ".gitignore": "**/deep/*.c\n[ab].h\n", "x/deep/q.c": "", "deep/r.c": "", "a.h": "", "c.h": "", "x/q.c": ""}, ["c.h", "x/q.c"]),
        ({"node_modules/a.js": "", "ü b.py": "", "1/2/3/4/5.go": ""}, ["1/2/3/4/5.go", "node_modules/a.js", "ü b.py"]),
    ],
)
def test_walk(tmp_path, files, want):
    tree(tmp_path, **files)
    assert walked(tmp_path) == want


def test_walk_options(tmp_path):
    tree(tmp_path, **{"node_modules/a.js": "", "b.py": "x" * 50, "c.py": ""})
    assert walked(tmp_path, apply_default_ignores=True) == ["b.py", "c.py"]
    assert walked(tmp_path, apply_max_file_size=True, max_file_size=10) == ["c.py", "node_modules/a.js"]
    for bad in ("relative", str(tmp_path / "none"), str(tmp_path / "b.py")):
        with pytest.raises(ValueError):
            files_of.walk(bad)


def test_engine(spark, tmp_path):
    root, space = tmp_path / "my repo", tmp_path / "space"
    tree(root, **{"a.py": "def calculate_score(x):\n    return x\n", "b.md": "# Title\nabout score\n## Two\nmore\n", "c.rs": "fn hello() {}\n", "[d].yml": "a: 1\n", "Makefile": "all:\n"})
    engine = Engine(spark, str(space), embedder=HashedEmbedder(32), home=str(tmp_path))
    first = engine.index(str(root))
    assert (first.files, first.chunks, first.vectors, first.lexical_only) == (5, 5, 5, False)
    assert engine.index(str(root)).message == "already up to date"
    best = engine.search(str(root), "calculate_score", 5).collect()
    assert best[0].relative_path == "a.py" and abs(best[0].score - 2 / 61) < 1e-9 and best[0].file_path == str(root / "a.py")
    (root / "c.rs").unlink()
    tree(root, **{"a.py": "def other(): return 1\n", "bad.py": b"\xff\xfe"})
    again = engine.index(str(root))
    assert (again.chunks, again.warnings) == (1, ["bad.py"])
    paths = {r.relative_path for r in engine.search(str(root), "hello other score", 10).collect()}
    assert "c.rs" not in paths and {"a.py", "b.md"} <= paths
    assert {r.relative_path for r in engine.search(str(root), "score", 10, ["md"]).collect()} == {"b.md"}
    assert engine.index(str(root), force=True).chunks == 4
    name = engine.name_of(str(root))
    assert engine.collection_stats(name) == 4 and [tuple(r) for r in engine.list_collections().collect()] == [(name, 4)]
    assert engine.status(str(root)).status == "completed"
    # Another embedder is another input: a full run.
    assert Engine(spark, str(space), embedder=HashedEmbedder(16), home=str(tmp_path)).index(str(root)).vectors == 4
    for call in (lambda: engine.search(str(root), "x", 0), lambda: engine.status("relative"), lambda: engine.drop_collection("../x")):
        with pytest.raises(ValueError):
            call()
    engine.clear(str(root))
    assert engine.status(str(root)).status == "idle" and engine.collection_stats(name) == 0 and not engine.drop_collection(name)


def test_lexical_only_busy_and_failure(spark, tmp_path):
    root = tmp_path / "r"
    tree(root, **{"a.py": "def f(): pass\n"})
    engine = Engine(spark, str(tmp_path / "w"), home=str(tmp_path))
    result = engine.index(str(root))
    assert result.lexical_only and result.chunks == 1 and result.vectors == 0
    assert len(engine.search(str(root), "f").collect()) == 1
    engine.store.create_alone(f"{engine.name_of(str(root))}.lock", {})
    with pytest.raises(Busy):
        engine.index(str(root))
    # A lock that nobody renews is void: here, after no time at all.
    time.sleep(0.05)
    Engine(spark, str(tmp_path / "w"), home=str(tmp_path), lock_seconds=0.01).index(str(root))
    assert not engine.store.exists(f"{engine.name_of(str(root))}.lock")

    class Broken:
        name, dimension = "broken", 4

        def embed(self, texts):
            return [[0.0] * 4][: len(texts) - 1]

    failing = Engine(spark, str(tmp_path / "w"), embedder=Broken(), home=str(tmp_path))
    with pytest.raises(Exception, match="another number"):
        failing.index(str(root))
    assert failing.status(str(root)).status == "failed" and engine.collection_stats(engine.name_of(str(root))) == 1


def test_manifest_diff(spark):
    before = spark.createDataFrame([("kept", "1"), ("modified", "2"), ("deleted", "3")], "relative_path string, sha256 string")
    after = spark.createDataFrame([("kept", "1"), ("modified", "4"), ("added", "5")], "relative_path string, sha256 string")
    changes = manifests.diff(before, after)
    assert {tuple(r) for r in changes.collect()} == {("modified", "modified"), ("deleted", "deleted"), ("added", "added")}
    assert {r[0] for r in manifests.stale(changes).collect()} == {"modified", "deleted"}
    assert {r[0] for r in manifests.without_paths(before, manifests.stale(changes)).collect()} == {"kept"}


def test_throttle_and_http(monkeypatch):
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limit = Throttle(60)
    for _ in range(61):
        limit.wait(1, lambda: now[0], sleep)
    assert slept == [1.0]
    limit.wait(1000, lambda: now[0], sleep)
    Throttle(0).wait(5, sleep=sleep)
    calls = []

    class Answer:
        def __init__(self, n):
            self.n = n

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return None

        def read(self, *a):
            return json.dumps({"data": [{"embedding": [1.0, 0.0]}] * self.n}).encode()

    def opened(request, timeout):
        calls.append(json.loads(request.data))
        if len(calls) == 1:
            import urllib.error

            raise urllib.error.HTTPError("u", 503, "busy", {"Retry-After": "0"}, None)
        return Answer(len(calls[-1]["input"]))

    monkeypatch.setattr("urllib.request.urlopen", opened)
    service = HttpEmbedder("http://x/v1/embeddings", "m", 2, batch_size=2, sleep=lambda s: None)
    assert len(service.embed(["a", "b", "c"])) == 3 and len(calls) == 3
    assert HttpEmbedder.of(Settings(embedding_url="http://x")).url == "http://x/v1/embeddings"


def test_vectors_go_with_their_chunks(spark):
    from lodestrand.operators import chunking

    rows = [(f"c{k}", f"word{k}", "", "f.py", k, k, "python") for k in range(250)]
    got = embed_chunks(spark.createDataFrame(rows, chunking.CHUNK), HashedEmbedder(8)).collect()
    embedder = HashedEmbedder(8)
    assert len(got) == 250 and all([round(x, 5) for x in r.vector] == [round(x, 5) for x in embedder.embed([r.content])[0]] for r in got[:20])


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    schema = "relative_path string, content string, version long"
    index = StreamIndex(spark, str(tmp_path / "w"), "s")

    def send(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(inbox))
        index.start(spark.readStream.schema(schema).json(str(inbox)), str(tmp_path / "c"), once=True).awaitTermination()
        return {(r.relative_path, r.content) for r in index.chunks().collect()}

    assert send(("a.yml", "x: 1", 1), ("a.yml", "x: 2", 2), ("b.md", "# t", 1)) == {("a.yml", "x: 2"), ("b.md", "# t")}
    assert send(("a.yml", "x: 2", 3), ("b.md", None, 2), ("c.yml", "y: 1", 1)) == {("a.yml", "x: 2"), ("c.yml", "y: 1")}


def test_locks_are_renewed_and_owned(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    lock, other = S.Lock(store, "x.lock", 0.4), S.Lock(store, "x.lock", 0.4)
    assert lock.take({}) and not other.take({})
    time.sleep(1.2)
    assert not other.take({})
    other.give_back()
    assert store.exists("x.lock")
    lock.give_back()
    assert not store.exists("x.lock") and other.take({})
    other.give_back()


def test_runs_write_new_rows_only(spark, tmp_path, monkeypatch):
    """Segments: what a run adds, what readers of an earlier state see, compaction, and vacuum."""
    monkeypatch.setattr(S, "MOST_SEGMENTS", 3)
    root, space = tmp_path / "r", tmp_path / "w"
    tree(root, **{f"f{k}.yml": f"word{k} common" for k in range(6)})
    engine = Engine(spark, str(space), home=str(tmp_path))
    engine.index(str(root))
    early = engine.search(str(root), "common", 20)
    name = engine.name_of(str(root))
    state = lambda: S.Collection(engine.store, name)
    for run in range(4):
        tree(root, **{"f0.yml": f"common changed{run}", f"new{run}.yml": f"fresh{run} common"})
        if run == 2:
            (root / "f5.yml").unlink()
        before = {x["id"] for x in state().header["segments"]}
        assert engine.index(str(root)).chunks == 2
        after = state().header
        if run < 2:
            added = [x["id"] for x in after["segments"] if x["id"] not in before]
            assert len(added) == 1 and before < {x["id"] for x in after["segments"]}
            assert {r.relative_path for r in spark.read.parquet(f"{space}/{name}/{added[0]}/chunks").collect()} == {"f0.yml", f"new{run}.yml"}
        want = {f"f{k}.yml" for k in range(6 if run < 2 else 5)} | {f"new{k}.yml" for k in range(run + 1)}
        for table in ("manifest", "chunks", "lengths"):
            assert sorted(r.relative_path for r in state().table(table).collect()) == sorted(want)
        assert {r.relative_path for r in engine.search(str(root), "common", 20).collect()} == want
        assert [r.relative_path for r in engine.search(str(root), f"changed{run}", 20).collect()] == ["f0.yml"]
        assert engine.search(str(root), "word0", 20).count() == 0
    assert len(state().header["segments"]) <= 3 and state().header["retired"]
    # Planned before the first change: its segment is there yet.
    assert {r.relative_path for r in early.collect()} == {f"f{k}.yml" for k in range(6)}
    now = state()
    now.vacuum(0)
    assert sorted(x for x in os.listdir(space / name) if not x.startswith((".", "current"))) == sorted(x["id"] for x in now.header["segments"])
    assert engine.collection_stats(name) == 9


def test_search_by_fields(spark, tmp_path):
    root = tmp_path / "r"
    tree(root, **{"a.yml": "one fox", "b.md": "# t\nfox fox\n", "c.json": "none"})
    engine = Engine(spark, str(tmp_path / "w"), home=str(tmp_path))
    engine.index(str(root))
    found = lambda q, **k: [r.relative_path for r in engine.search(str(root), q, 9, **k).collect()]
    assert found("fox") == ["b.md", "a.yml"] and found("fox AND language:yaml") == ["a.yml"] and set(found("relative_path:[a TO c]")) == {"a.yml", "b.md"}
    assert found("fox", extensions=["yml"], prefilter=True) == ["a.yml"]


def test_one_breaks_an_old_lock(spark, tmp_path):
    """Two runs find the same old lock; the second has read its age before the first took over."""
    store = S.Store(spark, str(tmp_path))
    store.create_alone("x.lock", {"owner": "gone"})
    first, second = S.Lock(store, "x.lock", 0.01), S.Lock(store, "x.lock", 0.01)
    time.sleep(0.1)
    age, held = store.age("x.lock"), store.load("x.lock")
    first.seconds = 60
    assert first._break("gone") and store.create_alone("x.lock", {"owner": first.owner})
    second.store = type("Late", (), {"age": lambda self, p: age, "load": lambda self, p: held if p == "x.lock" and not self.__dict__.setdefault("read", []) and not self.read.append(1) else store.load(p), "__getattr__": lambda self, n: getattr(store, n)})()
    assert not second.take({})
    assert first.ours() and store.load("x.lock")["owner"] == first.owner
    second.give_back()
    assert store.exists("x.lock")


def test_a_lost_owner_cannot_publish(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", 1)], "relative_path string, n int")
    lock = S.Lock(store, "c.lock", 60)
    assert lock.take({})
    mine = S.Collection(store, "c", lock.ours)
    mine.append({"t": rows}, None, {})
    # Another run has published since this one has read the header.
    other = S.Collection(store, "c")
    other.append({"t": rows.withColumn("n", rows.n + 1)}, None, {})
    with pytest.raises(S.Lost):
        mine.append({"t": rows}, None, {})
    mine.refresh()
    assert [r.n for r in mine.table("t").collect()] == [2] and len([x for x in store.names("c")]) == 2
    # The lock has gone to another.
    store.delete("c.lock")
    with pytest.raises(S.Lost):
        mine.append({"t": rows}, None, {})


VERSIONS = "relative_path string, content string, version long"


def test_stream_of_late_and_repeated_versions(spark, tmp_path):
    """Batches in any order, and twice, give the rows of one batch of all; the engine's sums and searches agree with a scan."""
    rnd = random.Random(8)
    rows = [(f"f{k % 9}.yml", None if rnd.random() < 0.2 else f"word{rnd.randint(0, 3)} common x{k}", k) for k in range(40)] + [("same.yml", "x", 1), ("same.yml", "x", 5), ("same.yml", "y", 3), ("tie.yml", "a", 2), ("tie.yml", "b", 2), ("null.yml", "n", None)]

    def indexed(name, batches):
        index = StreamIndex(spark, str(tmp_path / "w"), name)
        for n, batch in enumerate(batches):
            index.merge(spark.createDataFrame(batch, VERSIONS).coalesce(1), n)
        return index

    whole = indexed("one", [rows])
    want = sorted(map(tuple, whole.chunks().collect()))
    assert any(r[3] == "same.yml" and r[1] == "x" for r in want)
    mixed = rows + rows[:20]
    rnd.shuffle(mixed)
    parts = indexed("many", [mixed[k : k + 9] for k in range(0, len(mixed), 9)])
    assert sorted(map(tuple, parts.chunks().collect())) == want
    for index in (whole, parts):
        own = segments.blocks(index.collection)
        docs = index.chunks().select("chunk_id", "content")
        for query in ("common word1", "x", "word2 word2"):
            scan = lexical.bm25_topk(docs, query, 4, "chunk_id", "content").collect()
            assert own.topk(query, 4).collect() == scan
            assert segments.postings(index.collection).search(query, 4).collect() == scan


def test_engine_searches_streamed_collections(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    engine = Engine(spark, str(tmp_path / "w"), home=str(tmp_path))
    index = StreamIndex(spark, str(tmp_path / "w"), engine.name_of(str(root)))
    index.merge(spark.createDataFrame([("a.yml", "needle one", 2), ("b.yml", "two", 1)], VERSIONS), 0)
    index.merge(spark.createDataFrame([("a.yml", "old needle two", 1), ("b.yml", "needle needle", 4)], VERSIONS), 1)
    assert [(r.relative_path, r.content) for r in engine.search(str(root), "needle").collect()] == [("b.yml", "needle needle"), ("a.yml", "needle one")]
    assert engine.search(str(root), '+needle -"needle needle"').first().relative_path == "a.yml"


def test_sums_after_deletes_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MOST_SEGMENTS", 2)
    root = tmp_path / "r"
    tree(root, **{f"f{k}.yml": f"word{k} common common" for k in range(6)})
    engine = Engine(spark, str(tmp_path / "w"), home=str(tmp_path))
    seen = set()
    for step in range(4):
        engine.index(str(root))
        collection = engine._collection(str(root))
        seen.add(len(collection.header["segments"]))
        docs = collection.table("chunks").select("chunk_id", "content")
        want = lexical.corpus_stats(lexical.lengths(docs, "chunk_id", "content")).first()
        n, average, held = segments.sums(collection).facts(["common", "word1", "late"])
        assert (n, round(average, 9)) == (want.n_docs, round(want.avg_length, 9)) and collection.header["counts"]["chunks"] == n
        assert held == {t: docs.where(docs.content.contains(t)).count() for t in held}
        scan = lexical.bm25_topk(docs, "common late", 3, "chunk_id", "content").collect()
        assert segments.search(collection, "common late", 3).collect() == scan
        (root / f"f{step}.yml").unlink()
        put(root, f"f{step + 1}.yml", f"late common {step}")
        put(root, f"g{step}.yml", "late common late")
    assert seen == {1, 2}


def test_progress_of_a_live_stream(spark, tmp_path):
    """Counters rise from batch to batch while the stream lives, and another reader of the workspace sees them."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    index = StreamIndex(spark, str(tmp_path / "w"), "s")
    assert index.progress()["rows"] == 0
    query = index.start(spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", 1).json(str(inbox)), str(tmp_path / "c"))
    seen = []
    try:
        for k in range(3):
            (inbox / f"{k}.json").write_text("".join(json.dumps({"relative_path": f"f{k}{j}.yml", "content": None if j == 2 else "text", "version": k}) + "\n" for j in range(3)))
            for _ in range(300):
                if index.progress()["rows"] == 3 * (k + 1):
                    break
                time.sleep(0.2)
            seen.append(StreamIndex(spark, str(tmp_path / "w"), "s").progress())
            assert query.isActive
    finally:
        query.stop()
        index.stop_listening()
    assert [(x["batches"], x["rows"], x["texts"], x["bytes"]) for x in seen] == [(1, 3, 2, 8), (2, 6, 4, 16), (3, 9, 6, 24)]


def test_status_while_a_run_lives(spark, tmp_path, monkeypatch):
    root = tmp_path / "r"
    tree(root, **{f"f{k}.yml": f"word{k}" for k in range(4)})
    engine = Engine(spark, str(tmp_path / "w"), home=str(tmp_path))
    states = []
    save = engine._save_status
    monkeypatch.setattr(engine, "_save_status", lambda collection, status: (save(collection, status), states.append(engine.status(str(root)))))
    engine.index(str(root))
    assert [(s.status, s.total_files, s.processed_files, s.total_chunks) for s in states] == [("indexing", 0, 0, 0), ("indexing", 4, 0, 0), ("indexing", 4, 4, 4), ("completed", 4, 4, 4)]
