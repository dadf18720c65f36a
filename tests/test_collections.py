import json
import os
import threading
import time
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.functions.metadata import Filter
from halyard.model import BadRequest, CorruptData, DimensionMismatch, EngineConfig, EngineError, HnswParams, IndexType, Metric, NotFound
from halyard.plans.collection import Collection, Engine
from halyard.service import Service, http_server
from halyard.sources import vecfile
from halyard.sources.store import read_log_records
from halyard.streaming.flush import FlushWorker
from halyard.streaming.ingest import ingest, stop


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, EngineConfig(data_dir=str(tmp_path / "data")))


def label(x):
    return {"label": x}


AXES = [([1, 0, 0], label("x-axis"), "ext-1"), ([0, 1, 0], label("y-axis"), ""), ([1, 1, 0], label("diagonal"), None)]


def test_insert_search_get(engine):
    c = engine.create("axes", 3, Metric.COSINE)
    assert c.is_empty() and c.search([1, 0, 0], 3).collect() == []
    assert [c.insert(*AXES[0]), c.insert_many(AXES[1:])] == [0, 1] and len(c) == 3
    out = c.search([1, 0, 0], 3).collect()
    assert [r["id"] for r in out] == [0, 2, 1] and [r["external_id"] for r in out] == ["ext-1", None, None]
    assert out[0]["metadata"] == {"label": '"x-axis"'} and list(out[0]["vector"]) == [1, 0, 0]
    assert [r["id"] for r in c.search([1, 0, 0], 1, Filter.eq("label", "y-axis")).collect()] == [1]
    assert c.get(2).first()["external_id"] is None and c.get(9).collect() == []
    assert c.detail() == {"id": c.id, "name": "axes", "dimension": 3, "metric": "cosine", "vector_count": 3}
    assert engine.create("axes", 3, Metric.COSINE).id != c.id


def test_guards(engine, spark):
    c = engine.create("c", 3, Metric.COSINE)
    with pytest.raises(DimensionMismatch, match="Vector dimension 2 does not match collection dimension 3"):
        c.insert([1, 2], {})
    with pytest.raises(DimensionMismatch, match="Query dimension 2"):
        c.search([1, 2], 0)
    for bad in (float("nan"), float("inf"), 1e39):
        with pytest.raises(BadRequest):
            c.insert([1, 2, bad], {})
    for bad in ([1.0, 2.0], [1.0, 2.0, float("nan")], None):
        with pytest.raises(Exception, match="dimension|finite"):
            c.insert_df(spark.createDataFrame([(bad,)], "vector array<float>"))
    assert len(c) == 0
    with pytest.raises(BadRequest):
        engine.create("zero", 0, Metric.COSINE)


def rows(c):
    return {r["id"]: (list(r["vector"]), r["metadata"], r["external_id"]) for r in c.vectors().collect()}


@pytest.mark.parametrize("index", IndexType)
def test_restart_after_flush(engine, index):
    c = engine.create("c", 3, Metric.EUCLIDEAN, index)
    c.insert_many(AXES)
    c.compact()
    c.insert([0, 0, 1], label("z"), "z")
    want = rows(c)
    assert sorted(want) == [0, 1, 2, 3]
    for _ in range(2):  # no row twice, none lost
        again = Engine(engine.store.spark, engine.store.config).load_all()
        assert [rows(x) for x in again] == [want]
        assert [r["id"] for r in again[0].search([0, 0, 1], 1).collect()] == [3]
    c = again[0].compact()
    assert rows(c) == want and c.generation == 2 and len(c) == 4
    assert [r["id"] for r in c.search([0, 0, 1], 4).collect()][0] == 3
    folders = [f for f in engine.store.fs.list(engine.store.path(c.id)) if f.startswith("gen=")]
    assert [f.split("-")[0] for f in folders] == ["gen=1", "gen=2"]
    c = c.compact()
    folders = [f for f in engine.store.fs.list(engine.store.path(c.id)) if f.startswith("gen=")]
    assert [f.split("-")[0] for f in folders] == ["gen=2", "gen=3"] and rows(c) == want


def test_generations_and_empty_collections(engine):
    c = engine.create("empty", 4, Metric.COSINE, IndexType.HNSW)
    assert engine.store.generation(c.id) == 0 and engine.store.generation("none") == 0
    assert [c.compact().generation, c.compact().generation] == [1, 2]
    m = engine.store.manifest(c.id)
    assert (m.index_type, m.vector_count, m.dimension, m.version) == ("hnsw", 0, 4, 2) and rows(c) == {}


def test_crash_points(engine, monkeypatch):
    c = engine.create("c", 3, Metric.COSINE)
    c.insert_many(AXES)
    want = rows(c)
    monkeypatch.setattr(type(engine.store), "_put", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        c.compact()
    monkeypatch.undo()
    c = engine.collection(c.id)
    assert c.generation == 0 and rows(c) == want
    monkeypatch.setattr(type(engine.store.fs), "delete", lambda self, p: (_ for _ in ()).throw(OSError("crash")))
    c.compact()  # committed, but not cleared up
    c.compact()
    monkeypatch.undo()
    c = engine.collection(c.id)
    assert c.generation == 2 and rows(c) == want and c.insert([0, 0, 1], {}) == 3
    assert len(c.compact()) == 4 and sorted(rows(c)) == [0, 1, 2, 3]


def test_stale_handle_loses_nothing(engine):
    c = engine.create("c", 3, Metric.COSINE)
    a, b = Collection(c.store, c.manifest), Collection(c.store, c.manifest)
    assert a.insert([1, 0, 0], {}) == 0
    a.compact()
    assert b.insert([0, 1, 0], {}) == 1
    assert sorted(rows(engine.collection(c.id))) == [0, 1]
    a.compact()
    a.compact()
    assert b.insert([0, 0, 1], {}) == 2 and [len(a), len(b)] == [3, 3] and sorted(rows(b)) == [0, 1, 2]


def test_append_during_compaction_counts_once(engine, monkeypatch):
    c = engine.create("c", 3, Metric.COSINE)
    c.insert_many(AXES)
    store, real = type(engine.store), type(engine.store)._checksum

    def late(self, *a):
        monkeypatch.undo()
        Collection(self, c.manifest).insert([0, 0, 1], {}, "late")
        return real(self, *a)

    monkeypatch.setattr(store, "_checksum", late)
    c.compact()
    assert len(c) == 4 and sorted(rows(c)) == [0, 1, 2, 3]
    c.compact()
    assert len(c) == 4 and [r["external_id"] for r in c.get(3).collect()] == ["late"]


def test_commit_under_a_passed_number_is_taken_back(engine, monkeypatch):
    c = engine.create("c", 3, Metric.COSINE)
    store, real, other = type(engine.store), type(engine.store).count, Collection(c.store, c.manifest)

    def slow(self, m, open_=None):  # meanwhile another row is logged, and two snapshots pass its number
        monkeypatch.undo()
        other.insert([1, 0, 0], {}, "first")
        other.compact()
        other.compact()
        return real(self, m, open_)

    monkeypatch.setattr(store, "count", slow)
    assert c.insert([0, 1, 0], {}, "second") == 1
    assert {i: v[2] for i, v in rows(c).items()} == {0: "first", 1: "second"}


def test_two_compactions_at_once(engine, monkeypatch):
    c = engine.create("c", 3, Metric.COSINE)
    c.insert_many(AXES)
    want, store, real = rows(c), type(engine.store), type(engine.store)._checksum

    def between(self, *a):
        monkeypatch.undo()
        Collection(self, c.manifest).compact()
        return real(self, *a)

    monkeypatch.setattr(store, "_checksum", between)
    c.compact()
    assert c.generation == 1 and rows(c) == want
    folders = [f for f in engine.store.fs.list(engine.store.path(c.id)) if f.startswith("gen=")]
    assert len(folders) == 1 and engine.store.load_all()


def test_reader_outlives_a_compaction(engine):
    c = engine.create("c", 3, Metric.COSINE)
    c.insert_many(AXES)
    c.compact()
    c.insert([0, 0, 1], {}, "z")
    held = c.vectors()
    c.compact()
    assert sorted(r["id"] for r in held.collect()) == [0, 1, 2, 3]


def test_many_inserts_are_one_scan(engine):
    c = engine.create("c", 3, Metric.COSINE)
    for i in range(4):
        c.insert([i, 1, 0], {})
    assert c.vectors()._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(rows(c)) == [0, 1, 2, 3]


def test_flush_worker(engine, monkeypatch):
    a, b = engine.create("a", 3, Metric.COSINE), engine.create("b", 3, Metric.COSINE)
    a.insert_many(AXES)
    b.insert_many(AXES)
    real = type(engine.store).compact
    monkeypatch.setattr(type(engine.store), "compact", lambda self, m: (_ for _ in ()).throw(OSError("no")) if m.id == a.id else real(self, m))
    assert engine.flush() == [b.id] and len(a) == 3  # the failing one doesn't keep the other
    monkeypatch.undo()
    worker = FlushWorker(engine, 0.2).start()
    deadline = time.monotonic() + 60
    while engine.collection(a.id).generation == 0 and time.monotonic() < deadline:
        time.sleep(0.2)
    assert engine.collection(a.id).generation == 1
    worker.interval = 3600
    b.insert([0, 0, 1], {})
    worker.stop()
    assert not engine.store._open(b.refresh().manifest) and len(b) == 4


def test_two_writers_get_different_ids(engine):
    c = engine.create("c", 3, Metric.COSINE)
    a, b = Collection(c.store, c.manifest), Collection(c.store, c.manifest)
    assert [a.insert([1, 0, 0], {}), b.insert([0, 1, 0], {})] == [0, 1]
    assert c.store.fs.create(c.store.path(c.id, "log", f"{0:012d}.json"), "{}") is False


def test_damage(engine):
    a, b = engine.create("a", 3, Metric.COSINE), engine.create("b", 3, Metric.COSINE)
    for c in (a, b):
        c.insert_many(AXES)
        c.compact()
    folder = engine.store.path(a.id, a.manifest.folder, "vectors")
    part = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
    os.remove(f"{folder}/.{part}.crc")
    with open(f"{folder}/{part}", "r+b") as f:
        f.seek(10)
        f.write(b"\xff\xfe")
    with pytest.raises(CorruptData, match="checksum"):
        engine.store.verify(engine.store.manifest(a.id))
    os.makedirs(f"{engine.store.config.data_dir}/junk")
    with open(f"{engine.store.config.data_dir}/junk/manifest-{0:012d}.json", "w") as f:
        f.write("no json")
    assert [m.id for m in engine.store.load_all()] == [b.id]
    engine.drop(a.id)
    engine.drop(a.id)
    with pytest.raises(NotFound):
        engine.collection(a.id)


def test_flush(engine):
    a, b = engine.create("a", 3, Metric.COSINE), engine.create("b", 3, Metric.COSINE)
    a.insert_many(AXES)
    assert engine.flush() == [a.id] and engine.flush() == []
    assert {c.id for c in engine.list()} == {a.id, b.id}


def test_graph_collection(engine):
    rng = np.random.default_rng(0)
    c = engine.create("g", 8, Metric.COSINE, IndexType.HNSW, HnswParams(m=8, ef_construction=50))
    x = rng.normal(size=(120, 8)).tolist()
    c.insert_many([(v, {"even": i % 2 == 0}, f"e{i}") for i, v in enumerate(x)])
    c.compact()
    out = c.search(x[5], 3, ef_search=120).collect()
    assert out[0]["id"] == 5 and out[0]["external_id"] == "e5" and len(out) == 3
    assert all(r["metadata"]["even"] == "true" for r in c.search(x[5], 3, Filter.eq("even", True)).collect())
    queries = c.vectors().filter("id < 3").select(F.col("id").alias("qid"), "vector")
    assert {r["qid"]: r["id"] for r in c.knn(queries, 1).collect()} == {0: 0, 1: 1, 2: 2}


def test_streaming_ingest_counts_once(engine, spark, tmp_path):
    c = engine.create("s", 2, Metric.COSINE)
    src = str(tmp_path / "src")
    schema = "vector array<float>, metadata string, external_id string"
    put = lambda n: spark.createDataFrame([([float(n), 1.0], json.dumps({"n": n}), f"e{n}")], schema).write.mode("append").json(src)
    put(1)
    stream = spark.readStream.schema(schema).json(src)
    for _ in range(2):
        ingest(stream, c, str(tmp_path / "cp"), "feed", "metadata").awaitTermination()
    put(2)
    q = ingest(stream, c, str(tmp_path / "cp"), "feed", "metadata", interval=1)
    c = stop(q, c)
    assert [(v[0][0], v[1]) for _, v in sorted(rows(c).items())] == [(1.0, {"n": "1"}), (2.0, {"n": "2"})]
    df = spark.createDataFrame([([9.0, 9.0],)], "vector array<float>")
    for batch in (0, 1, 2, 2):  # the first two were logged before the snapshot
        c.insert_df(df, stream="feed", batch=batch)
    assert len(c) == 3


def test_log_records(spark, engine, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"op":"Insert","vector":[1,2],"metadata":{"a":1},"external_id":"x"}\n\n{"op":"Insert","vector":[3,4],"metadata":{}}\n')
    c = engine.create("l", 2, Metric.COSINE)
    c.insert_df(read_log_records(spark, str(p)))
    assert rows(c) == {0: ([1, 2], {"a": "1"}, "x"), 1: ([3, 4], {}, None)}
    assert [r["op"] for r in c.store.export_log(c.manifest).collect()] == ["Insert", "Insert"]
    p.write_text('{"op":"Insert","vector":[1,2],"metadata":{}}\nbroken\n')
    with pytest.raises(Exception):
        read_log_records(spark, str(p)).collect()


def test_vector_files(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    data = vecfile.pack(x)
    assert len(data) == 20 + 48 and (vecfile.unpack(data, 3, 4) == x).all()
    for bad, why in ((data[:10], "header"), (b"XXXX" + data[4:], "magic"), (data[:4] + b"\2" + data[5:], "version"), (data[:-1], "size")):
        with pytest.raises(CorruptData, match=why):
            vecfile.unpack(bad)
    for k in ({"dimension": 4}, {"count": 9}):
        with pytest.raises(CorruptData):
            vecfile.unpack(data, **k)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(4)], "id long, vector array<float>")
    for name, size, files in (("one", 1000, 1), ("many", 24, 2)):
        vecfile.write(df.repartition(3), str(tmp_path / name), 3, size)
        back = vecfile.read(spark, str(tmp_path / name), 3).orderBy("file", "id").collect()
        assert [list(r["vector"]) for r in back] == x.tolist()
        assert sorted(f for f in os.listdir(tmp_path / name) if f[0] != ".") == [f"part-{i:05d}.vec" for i in range(files)]
    with pytest.raises(Exception, match="components"):
        vecfile.write(df, str(tmp_path / "bad"), 4)


def test_service(spark, tmp_path, monkeypatch):
    s = Service(spark, EngineConfig(data_dir=str(tmp_path / "d")))
    assert s.handle("GET", "/health") == (200, {"status": "ok"})
    make = lambda **k: s.handle("POST", "/collections", {"name": "c", "dimension": 2, "metric": "cosine"} | k)
    status, body = make()
    assert status == 201 and body["name"] == "c"
    at = f"/collections/{body['id']}"
    assert make(metric="l1", index="ivf") == (400, {"error": "Invalid metric. Use: cosine, euclidean, dot_product"})
    assert make(index="ivf") == (400, {"error": "Validation error: Invalid index type. Use: flat, hnsw"})
    assert make(dimension=0)[0] == make(dimension="2")[0] == s.handle("POST", "/collections", None)[0] == 400
    assert make(index="HNSW")[0] == 201
    assert s.handle("GET", "/collections/nope") == (400, {"error": "Invalid ID nope, expected ULID"})
    gone = "/collections/01ARZ3NDEKTSV4RRFFQ69G5FAV"
    assert s.handle("GET", gone) == s.handle("POST", gone + "/vectors", {}) == (404, {"error": "Collection not found"})
    put = lambda **k: s.handle("POST", at + "/vectors", {"vector": [1, 0], "metadata": {"label": "a", "n": 1}} | k)
    assert put() == (201, {"id": 0}) and put(vector=[0, 1], external_id="e") == (201, {"id": 1})
    assert put(vector=[1]) == (400, {"error": "Vector dimension 1 does not match collection dimension 2"})
    assert put(metadata=None)[0] == 400
    assert s.handle("GET", at)[1]["vector_count"] == 2
    find = lambda **k: s.handle("POST", at + "/search", {"vector": [1, 0], "k": 2} | k)
    status, body = find()
    assert status == 200 and body["results"][0] == {"id": 0, "score": 1.0, "vector": [1.0, 0.0], "external_id": None, "metadata": {"label": "a", "n": 1}}
    assert len(find(filter={"op": "eq", "key": "n", "value": 1})[1]["results"]) == 2
    assert find(filter={"op": "eq", "key": "n", "value": 1.0}) == (200, {"results": []})
    assert find(filter={"op": "gt"})[0] == find(k=-1)[0] == 400
    assert find(vector=[1]) == (400, {"error": "Query dimension 1 does not match collection dimension 2"})
    assert s.handle("GET", "/nowhere")[0] == 404
    monkeypatch.setattr(Collection, "insert", lambda *a: (_ for _ in ()).throw(OSError()))
    assert put() == (500, {"error": "Failed to persist write"})
    assert EngineError("x").status == 500


def test_http(spark, tmp_path):
    server = http_server(Service(spark, EngineConfig(data_dir=str(tmp_path), host="127.0.0.1", port=0)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert json.load(urllib.request.urlopen(url + "/health")) == {"status": "ok"}
        body = json.dumps({"name": "h", "dimension": 2, "metric": "dot_product"}).encode()
        assert urllib.request.urlopen(urllib.request.Request(url + "/collections", body)).status == 201
        with pytest.raises(urllib.error.HTTPError, match="400"):
            urllib.request.urlopen(urllib.request.Request(url + "/collections", b"{"))
        doc = json.load(urllib.request.urlopen(url + "/api-doc/openapi.json"))
        assert {(m, p) for p, ops in doc["paths"].items() for m in ops} == {("get", "/health"), ("post", "/collections"), ("get", "/collections/{id}"), ("post", "/collections/{id}/vectors"), ("post", "/collections/{id}/search")}
        page = urllib.request.urlopen(url + "/swagger-ui/")
        assert page.headers["Content-Type"].startswith("text/html") and b"/collections/{id}/search" in page.read()
    finally:
        server.shutdown()
        server.server_close()
