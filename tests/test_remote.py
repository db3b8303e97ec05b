"""Remote collections against a small service in this process."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.config import Settings
from lodestrand.plans.engine import Engine
from lodestrand.sources import remote
from lodestrand.sources.embedding import VECTORS, HashedEmbedder


class Service:
    """Entities in memory; filters are read as Python expressions."""

    def __init__(self):
        self.held, self.filters, self.errors, self.token, self.nested = {}, [], [], None, False

    def keeps(self, where):
        self.filters.append(where)
        code = compile(re.sub(r'metadata\["(\w+)"\]', r'metadata.get("\1")', where), "filter", "eval")
        return lambda x: eval(code, {"__builtins__": {}}, {"id": x["id"], "metadata": x["metadata"]})

    def answer(self, path, body):
        name = body.get("collectionName")
        if path == "collections/create":
            self.held[name] = []
        elif path == "collections/has":
            return {"has": name in self.held}
        elif path == "collections/drop":
            del self.held[name]
        elif path == "collections/list":
            return list(self.held)
        elif path == "collections/get_stats":
            return {"rowCount": len(self.held[name])}
        elif path == "entities/insert":
            self.held[name] += body["data"]
        elif path == "entities/delete":
            keeps = self.keeps(body["filter"])
            self.held[name] = [x for x in self.held[name] if not keeps(x)]
        elif path == "entities/query":
            found = [x for x in self.held[name] if self.keeps(body["filter"])(x)]
            return found[body["offset"] : body["offset"] + body["limit"]]
        elif path == "entities/search":
            q = np.array(body["data"][0])
            found = [x | {"distance": float(np.dot(q, x["vector"]) / (np.linalg.norm(q) * np.linalg.norm(x["vector"]) or 1))} for x in self.held[name]]
            best = sorted(found, key=lambda x: -x["distance"])[: body["limit"]]
            return [best] if self.nested else best
        return {}


@pytest.fixture
def served():
    service, lock = Service(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                status = 401 if service.token and self.headers.get("Authorization") != f"Bearer {service.token}" else service.errors.pop(0) if service.errors else 200
                try:
                    out = {"code": 0, "data": service.answer(self.path.removeprefix("/v2/vectordb/"), body)} if status == 200 else {}
                except KeyError as e:
                    out = {"code": 100, "message": f"no collection {e}"}
            raw = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    service.url = f"http://127.0.0.1:{server.server_port}"
    yield service
    server.shutdown()


def rows(n):
    return [(k * (2**63 // n), f"c{k}", f"text {k}", [float(k), 1.0], "", f'd "{k % 5}"/é.py', k, k + 1, "python") for k in range(n)]


def test_round_trip_and_pushed_filters(spark, served):
    client = remote.VectorService(served.url)
    client.create("c", 2)
    df = spark.createDataFrame(rows(1234), VECTORS).repartition(5)
    remote.append(df, client, "c")
    assert client.count("c") == 1234 and client.names() == ["c"] and client.has("c") and not client.has("d")
    got = remote.read(spark, client, "c", partitions=4, page=100)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    served.filters.clear()
    path = 'd "3"/é.py'
    some = got.where((F.col("relative_path") == path) & (F.col("vector_id") < 2**62) & F.col("content").endswith("8"))
    assert sorted(r.chunk_id for r in some.collect()) == sorted(f"c{k}" for k in range(617) if k % 5 == 3 and k % 10 == 8)
    assert any(json.dumps(path, ensure_ascii=False) in f and f"id < {2**62}" in f for f in served.filters)
    remote.delete_paths(spark.createDataFrame([(path,), ('d "0"/é.py',), (None,)], "relative_path string"), client, "c")
    assert client.count("c") == sum(k % 5 not in (0, 3) for k in range(1234))
    assert client.drop("c") and not client.drop("c")


def test_a_failed_task_leaves_no_rows(spark, served):
    client = remote.VectorService(served.url)
    client.create("c", 2)
    remote.append(spark.createDataFrame(rows(20), VECTORS), client, "c")
    bad = spark.createDataFrame(rows(3000), VECTORS).coalesce(1).withColumn("content", F.when(F.col("chunk_id") == "c2900", F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        remote.append(bad, client, "c")
    assert client.count("c") == 20
    # Attempts that do not count go with the commit.
    writer = remote.CollectionWriter(client, "c")
    first, second = (writer.write(iter(spark.createDataFrame(rows(7), VECTORS).collect())) for _ in range(2))
    assert client.count("c") == 34 and first.attempt != second.attempt
    writer.commit([second, None])
    assert client.count("c") == 27


def test_retries_tokens_and_errors(served):
    waits = []
    client = remote.VectorService(served.url, "secret", sleep=waits.append)
    served.token = "secret"
    served.errors += [503, 429]
    client.create("c", 2)
    assert waits == [0.5, 1.0]
    served.errors += [500] * 4
    with pytest.raises(Exception, match="500"):
        client.names()
    served.errors += [400]
    with pytest.raises(Exception, match="400"):
        client.names()
    with pytest.raises(remote.ServiceError, match="no collection"):
        client.insert("missing", [{"id": 1}])
    with pytest.raises(Exception, match="401"):
        remote.VectorService(served.url).names()


@pytest.mark.parametrize("nested", [False, True])
def test_engine_with_a_service(spark, served, tmp_path, nested):
    served.nested = nested
    root = tmp_path / "r"
    root.mkdir()
    for k in range(6):
        (root / f"f{k}.yml").write_text(f"word{k} common")
    settings = Settings(vector_url=served.url)
    engine = Engine(spark, str(tmp_path / "w"), settings, HashedEmbedder(32), home=str(tmp_path))
    assert engine.index(str(root)).vectors == 6
    name = engine.name_of(str(root))
    assert engine.service.count(name) == 6
    assert engine.search(str(root), "word3 common", 3).first().relative_path == "f3.yml"
    (root / "f0.yml").write_text("word0 changed")
    (root / "f1.yml").unlink()
    engine.index(str(root))
    held = sorted((x["metadata"]["relative_path"], x["content"]) for x in served.held[name])
    assert held == sorted([("f0.yml", "word0 changed"), *((f"f{k}.yml", f"word{k} common") for k in range(2, 6))])
    engine.clear(str(root))
    assert not engine.service.has(name)
    assert remote.top_k(spark, engine.service, name, [1.0] * 32, 3).count() == 0
