"""Registered queries that run the engine itself: stored collections, their log and
snapshots, flushing, vector files, stored graphs and the service's routes. Each is
held against SQL over ``embeddings``, or against the rows that must come back."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import is_ulid, new_ulid, parse_ulid
from ..functions.metadata import Filter
from ..model import BadRequest, EngineConfig, HnswParams, IndexType, Metric, ValidationError
from ..operators import flat, hnsw
from ..service import Service
from ..sources import vecfile
from ..sources.store import read_log_records
from ..streaming.flush import FlushWorker
from .collection import Collection, Engine
from .queries import COS, DIM, DOT, EUC, _engine, _knn_queries, _rows, _stored, _vectors, _work_dir

ROWS = "SELECT vec_id, label, 'ext-' || vec_id AS external_id FROM embeddings"


def _first(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(_vectors(spark, sf_dir).filter(F.col("id") == vec_id).first()["vector"])


def _values(rows: Sequence[tuple], columns: str) -> str:
    """SQL of literal rows."""
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::BIGINT"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({columns})"


# collections


def _get(vec_id: int) -> Callable:
    def run(spark, sf_dir):
        found = _stored(spark, sf_dir).get(vec_id)
        return found.select(F.col("id").alias("vec_id"), F.element_at("metadata", "label").cast("int").alias("label"), F.posexplode("vector").alias("place", "component")).select("vec_id", "label", "place", F.col("component").cast("double").alias("component"))

    return run


def _collection_detail(spark, sf_dir):
    d = _stored(spark, sf_dir).compact().detail()
    return spark.createDataFrame([(d["name"], d["metric"], d["vector_count"], d["dimension"])], "name string, metric string, vector_count long, dimension long")


def _dimension_guard(spark, sf_dir):
    """Rows that collections of three dimensions take, and whether a query of 64
    components is refused."""
    out = []
    for d in (63, 64, 65):
        c = _engine(spark).create("guarded", d, COS)
        try:
            c.insert_df(_vectors(spark, sf_dir))
        except Exception as e:
            if "dimension" not in str(e):
                raise
        try:
            c.search([1.0] * 64, 1)
            refused = False
        except BadRequest:
            refused = True
        out.append((d, len(c), refused))
    return spark.createDataFrame(out, "dimension long, taken long, query_refused boolean")


def _search(index: IndexType, k: int, where: Filter | None = None) -> Callable:
    def run(spark, sf_dir):
        c = _stored(spark, sf_dir, index).compact()
        # as wide as the collection: the graph's result is exact
        found = c.search(_first(spark, sf_dir), k, where, ef_search=len(c))
        return found.select(F.col("id").alias("vec_id"), F.round(F.col("score").cast("double"), 4).alias("score"))

    return run


def _search_empty(spark, sf_dir):
    c = _engine(spark).create("empty", DIM, EUC)
    return c.search(_first(spark, sf_dir), 5).select(F.col("id").alias("vec_id"), F.col("score").cast("double").alias("score"))


def _batched(metric: Metric) -> Callable:
    def run(spark, sf_dir):
        found = flat.batch_search(_vectors(spark, sf_dir), _first(spark, sf_dir), 10, metric)
        return found.select(F.col("id").alias("vec_id"), F.round(F.col("score").cast("double"), 4).alias("score"))

    return run


def _knn_euclidean(spark, sf_dir):
    return flat.knn_join(_knn_queries(spark, sf_dir), _vectors(spark, sf_dir), 10, EUC, precision="float64").select("qid", F.col("id").alias("vec_id"), "rank")


# log, snapshots, flushing


def _stale_handle(spark, sf_dir):
    """Rows of two handles, one of which compacts behind the other's back."""
    c = _engine(spark).create("embeddings", DIM, COS)
    a, b = Collection(c.store, c.manifest), Collection(c.store, c.manifest)
    v = _vectors(spark, sf_dir)
    thirds = [v.filter(F.col("id") % 3 == i).orderBy("id") for i in range(3)]
    a.insert_df(thirds[0])
    a.compact()
    b.insert_df(thirds[1])
    a.compact()
    a.compact()
    b.insert_df(thirds[2])
    return _ids_once(Collection(c.store, c.store.manifest(c.id)))


def _append_during_compaction(spark, sf_dir):
    """A batch logged while a snapshot is being written."""
    c = _engine(spark).create("embeddings", DIM, COS)
    v = _vectors(spark, sf_dir)
    c.insert_df(v.filter("id % 2 = 0").orderBy("id"))
    store, real = c.store, c.store._checksum

    def late(*a):
        store._checksum = real
        Collection(store, c.manifest).insert_df(v.filter("id % 2 = 1").orderBy("id"))
        return real(*a)

    store._checksum = late
    c.compact()
    c.compact()
    return _ids_once(c)


def _ids_once(c: Collection) -> DataFrame:
    """The collection's rows, and how many carry each id."""
    v = c.vectors()
    times = v.groupBy("id").agg(F.count("*").alias("times"))
    return v.join(times, "id").select(F.regexp_extract("external_id", r"ext-(\d+)", 1).cast("long").alias("vec_id"), "times", (F.col("id") < len(c)).alias("dense"))


def _log_records(spark, sf_dir):
    """The open log as JSON lines, read into another collection."""
    c = _stored(spark, sf_dir)
    at = f"{_work_dir(spark)}/log-{new_ulid()}"
    records = c.store.export_log(c.manifest)
    as_json = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
    line = F.concat(F.lit('{"op":"Insert","vector":'), F.to_json("vector"), F.lit(',"metadata":'), as_json, F.lit(',"external_id":"'), F.col("external_id"), F.lit('"}'))
    records.coalesce(1).select(line).write.text(at)
    other = _engine(spark).create("replayed", DIM, COS)
    other.insert_df(read_log_records(spark, at))
    return _rows(other.vectors())


def _vector_files(spark, sf_dir):
    """Vector files written and read back; a file's ids follow the file before."""
    at = f"{_work_dir(spark)}/vec-{new_ulid()}"
    vecfile.write(_vectors(spark, sf_dir), at, DIM, 64 << 10)
    v = vecfile.read(spark, at, DIM)
    sizes = v.groupBy("file").agg(F.count("*").alias("n")).collect()
    start, before = {}, 0
    for r in sorted(sizes):
        start[r["file"]], before = before, before + r["n"]
    first = F.create_map(*[F.lit(x) for kv in start.items() for x in kv])
    return v.select((F.element_at(first, F.col("file")) + F.col("id")).cast("long").alias("vec_id"), F.element_at("vector", 1).cast("double").alias("first"), F.element_at("vector", -1).cast("double").alias("last"), F.lit(len(start) > 1).alias("several_files"))


def _delete(spark, sf_dir):
    """Of three collections one is dropped, twice, one is dropped while flushing."""
    e = _engine(spark)
    kept, gone, flushed = (e.create(n, DIM, COS) for n in ("kept", "gone", "flushed"))
    for c in (kept, gone, flushed):
        c.insert([1.0] * DIM, {})
    e.drop(gone.id)
    e.drop(gone.id)
    real = e.store.compact

    def dropped(m):
        if m.id == flushed.id:
            e.drop(flushed.id)
        return real(m)

    e.store.compact = dropped
    e.flush()
    return spark.createDataFrame([(c.name, c.generation, len(c)) for c in e.list()], "name string, generation long, vector_count long")


def _flush_isolation(spark, sf_dir):
    """One collection's log is damaged; the others are flushed all the same."""
    e = _engine(spark)
    made = [e.create(n, DIM, COS) for n in ("a", "b", "c")]
    for c in made:
        c.insert([1.0] * DIM, {})
    e.store.fs.replace(e.store._entry(made[1].manifest, 0), "no json")
    e.flush()
    return spark.createDataFrame([(c.name, c.refresh().generation) for c in made], "name string, generation long")


def _damaged_left_out(spark, sf_dir):
    """Loading verifies checksums: a collection with a damaged snapshot stays out."""
    e = _engine(spark)
    for n in ("good", "bad"):
        c = e.create(n, DIM, COS)
        c.insert_df(_vectors(spark, sf_dir).filter("id < 20").coalesce(1))
        c.compact()
    at = e.store.path(c.id, c.manifest.folder, "vectors")
    part = next(n for n in e.store.fs.list(at) if n.endswith(".parquet"))
    e.store.fs.replace(f"{at}/{part}", "damaged")
    return spark.createDataFrame([(c.name, len(c)) for c in e.load_all()], "name string, vector_count long")


def _worker(spark, sf_dir):
    """The background worker flushes by itself, and once more when it stops."""
    c = _stored(spark, sf_dir)
    worker = FlushWorker(Engine(spark, c.store.config), 0.1).start()
    deadline = time.monotonic() + 120
    while c.refresh().generation == 0 and time.monotonic() < deadline:
        time.sleep(0.1)
    by_itself = c.generation >= 1
    worker.interval = 3600
    c.insert([0.5] * DIM, {"label": -1})
    worker.stop()
    return spark.createDataFrame([(by_itself, len(c.store._open(c.refresh().manifest)), len(c))], "by_itself boolean, open_batches long, vector_count long")


# names and ids


def _names(spark, sf_dir):
    """Spellings of metrics and index types, and what they are read as."""
    out = []
    for text in ("cosine", "Cosine", "EUCLIDEAN", "dot_product", "DotProduct", "l1", "flat", "HNSW", "ivf", ""):
        try:
            index = IndexType.parse(text).value
        except ValidationError as e:
            index = str(e)
        metric = Metric.parse(text)
        out.append((text, metric.value if metric else None, index))
    return spark.createDataFrame(out, "spelling string, metric string, index_type string")


def _ulids(spark, sf_dir):
    """Ids by their vectors: which strings are ULIDs, in the engine and as a column."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    text = F.concat(F.element_at(F.array(*map(F.lit, "07 8 AZ 7u 7I".split())), (F.col("vec_id") % 5 + 1).cast("int")), F.lpad((F.col("vec_id") * 977).cast("string"), 24, "0"))
    rows = e.select("vec_id", text.alias("text"), is_ulid(text).alias("is_ulid"))

    def parsed(batches):
        import pyarrow as pa

        for b in batches:
            ids = []
            for t in b.column(1).to_pylist():
                try:
                    ids.append(parse_ulid(t))
                except BadRequest:
                    ids.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.string())], ["vec_id", "is_ulid", "parsed"])

    return rows.mapInArrow(parsed, "vec_id long, is_ulid boolean, parsed string")


def _settings(spark, sf_dir):
    """Settings that are given override defaults; ULIDs made are valid and differ."""
    c = EngineConfig(data_dir="/x", host="h", port=1, flush_interval=7)
    made = {new_ulid() for _ in range(1000)}
    ok = len(made) == 1000 and all(parse_ulid(i) == i for i in made)
    return spark.createDataFrame([(c.data_dir, c.host, c.port, c.flush_interval, FlushWorker(Engine(spark, c)).interval, ok)], "data_dir string, host string, port long, flush_interval long, worker_interval long, ulids_ok boolean")


# stored graphs


def _graph(spark, sf_dir, shards: int) -> DataFrame:
    """The built shards, written: a search reads them where they lie."""
    at = f"{_work_dir(spark)}/graph-{new_ulid()}"
    hnsw.build(_vectors(spark, sf_dir), COS, shards=shards).write.parquet(at)
    return spark.read.schema(hnsw.SHARD_SCHEMA).parquet(at)


def _shards(spark, sf_dir, least: int = 1) -> int:
    """As many as a collection of the table's rows has, so that a task's work is
    bounded, or ``least``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    return max(least, hnsw.shard_count(rows, EngineConfig().rows_per_shard))


def _recall(spark, sf_dir, ef: Sequence[int]) -> list[float]:
    """Recall at 10 of every vector whose id is divisible by 50, against all."""
    q = _knn_queries(spark, sf_dir).orderBy("qid").toArrow()  # a stated query set
    qid, vectors = q["qid"].to_numpy(), flat.matrix(q["vector"])
    exact = flat.knn_join(_knn_queries(spark, sf_dir), _vectors(spark, sf_dir), 10, COS).select("qid", "id").toPandas().drop_duplicates()
    shards = _graph(spark, sf_dir, _shards(spark, sf_dir))
    out = []
    for e in ef:
        found = hnsw.search(shards, vectors, 10, COS, ef_search=e).select("qid", "id").toPandas()
        out.append(len(found.assign(qid=qid[found["qid"]]).drop_duplicates().merge(exact)) / len(exact))
    return out


def _hnsw_recall(spark, sf_dir):
    """Whether recall at 10 reaches 0.9."""
    return spark.createDataFrame([(_recall(spark, sf_dir, [100])[0] >= 0.9,)], "recall_passes boolean")


def _hnsw_recall_measured(spark, sf_dir):
    """Recall at 10 by the width of the search."""
    ef = [10, 50, 100, 200]
    return spark.createDataFrame(list(zip(ef, _recall(spark, sf_dir, ef), strict=True)), "ef_search int, recall double")


def _hnsw_monotone(spark, sf_dir):
    low, high = _recall(spark, sf_dir, [10, 200])
    return spark.createDataFrame([(high >= low,)], "wider_is_no_worse boolean")


def _hnsw_exhaustive(spark, sf_dir):
    """A search as wide as the shards' rows: the exact result."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    found = hnsw.search(_graph(spark, sf_dir, _shards(spark, sf_dir, 3)), [_first(spark, sf_dir)], 10, COS, ef_search=rows)
    return found.select(F.col("id").alias("vec_id"), F.round(F.col("score").cast("double"), 4).alias("score"))


def _hnsw_links(spark, sf_dir):
    """The same by a graph that was exported as rows and imported again."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    shards = _shards(spark, sf_dir, 3)
    links = hnsw.export_links(_graph(spark, sf_dir, shards))
    again = hnsw.import_links(_vectors(spark, sf_dir), links, shards)
    found = hnsw.search(again, [_first(spark, sf_dir)], 10, COS, ef_search=rows)
    return found.select(F.col("id").alias("vec_id"), F.round(F.col("score").cast("double"), 4).alias("score"))


def _hnsw_degrees(spark, sf_dir):
    """Nodes on the ground layer, and whether any degree passes its bound or a
    link joins a node to itself."""
    p = HnswParams()
    links = hnsw.export_links(_graph(spark, sf_dir, _shards(spark, sf_dir)))
    most = F.when(F.col("layer") == 0, p.m_max0).otherwise(p.m)
    return links.agg(F.count_if(F.col("layer") == 0).alias("nodes"), F.count_if(F.size("nbr") > most).alias("too_many"), F.count_if(F.array_contains("nbr", F.col("node_id"))).alias("to_itself"), F.count_if(F.size("nbr") != F.size("dist")).alias("unaligned"))


# the service


def _service(spark: SparkSession) -> Service:
    return Service(spark, EngineConfig(data_dir=f"{_work_dir(spark)}/service-{new_ulid()}"))


def _service_search(spark, sf_dir):
    """Ten rows put in by the API and searched for: every field of the answer."""
    s = _service(spark)
    _, made = s.handle("POST", "/collections", {"name": "api", "dimension": DIM, "metric": "cosine"})
    rows = _vectors(spark, sf_dir).filter("id < 10").orderBy("id").collect()
    for r in rows:
        body = {"vector": list(r["vector"]), "metadata": {k: json.loads(v) for k, v in r["metadata"].items()}} | ({"external_id": r["external_id"]} if r["id"] % 2 else {})
        status, answer = s.handle("POST", f"/collections/{made['id']}/vectors", body)
        assert (status, answer) == (201, {"id": r["id"]}), answer
    status, answer = s.handle("POST", f"/collections/{made['id']}/search", {"vector": list(rows[0]["vector"]), "k": 5, "filter": {"op": "eq", "key": "parity", "value": 0}})
    out = [(r["id"], round(r["score"], 4), r["metadata"]["label"], r["metadata"]["parity"], r["external_id"], len(r["vector"]), float(r["vector"][0])) for r in answer["results"]]
    return spark.createDataFrame(out, "vec_id long, score double, label int, parity int, external_id string, components int, first double")


def _service_routes(spark, sf_dir):
    """Statuses and bodies of good and bad requests."""
    s = _service(spark)
    _, made = s.handle("POST", "/collections", {"name": "api", "dimension": 2, "metric": "cosine", "index": "HNSW"})
    at = f"/collections/{made['id']}"
    requests = [
        ("health", "GET", "/health", None),
        ("detail", "GET", at, None),
        ("insert", "POST", at + "/vectors", {"vector": [1, 0], "metadata": {}}),
        ("insert_again", "POST", at + "/vectors", {"vector": [0, 1], "metadata": {}}),
        ("detail_after", "GET", at, None),
        ("wrong_dimension", "POST", at + "/vectors", {"vector": [1], "metadata": {}}),
        ("wrong_query", "POST", at + "/search", {"vector": [1], "k": 1}),
        ("wrong_metric", "POST", "/collections", {"name": "x", "dimension": 2, "metric": "l1"}),
        ("wrong_index", "POST", "/collections", {"name": "x", "dimension": 2, "metric": "cosine", "index": "ivf"}),
        ("wrong_id", "GET", "/collections/nope", None),
        ("no_such", "GET", "/collections/01ARZ3NDEKTSV4RRFFQ69G5FAV", None),
        ("no_route", "GET", "/nowhere", None),
    ]
    out = []
    for name, method, path, body in requests:
        status, answer = s.handle(method, path, body)
        out.append((name, status, json.dumps({k: v for k, v in answer.items() if v != made["id"]}, sort_keys=True)))
    doc = s.handle("GET", "/api-doc/openapi.json")[1]
    out.append(("openapi", 200, ",".join(sorted(f"{m} {p}" for p, ops in doc["paths"].items() for m in ops))))
    out.append(("swagger_ui", *(lambda r: (r[0], str(r[1].startswith("<!doctype html>"))))(s.handle("GET", "/swagger-ui"))))
    return spark.createDataFrame(out, "request string, status long, answer string")


def _service_drain(spark, sf_dir):
    """What was put in is in a snapshot once the service is closed."""
    s = _service(spark).start()
    _, made = s.handle("POST", "/collections", {"name": "api", "dimension": 2, "metric": "dot_product"})
    s.handle("POST", f"/collections/{made['id']}/vectors", {"vector": [1, 0], "metadata": {}})
    s.close()
    c = Engine(spark, s.config).load_all()[0]
    return spark.createDataFrame([(c.generation, len(c.store._open(c.manifest)), len(c))], "generation long, open_batches long, vector_count long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "get_by_id": _get(7),
    "get_missing": _get(10**9),
    "collection_detail": _collection_detail,
    "dimension_guard": _dimension_guard,
    "collection_search": _search(IndexType.FLAT, 10),
    "collection_search_filtered": _search(IndexType.FLAT, 10, Filter.eq("parity", 1)),
    "collection_search_hnsw": _search(IndexType.HNSW, 10),
    "collection_search_hnsw_filtered": _search(IndexType.HNSW, 10, Filter.eq("parity", 1)),
    "search_empty": _search_empty,
    "batch_search_cosine": _batched(COS),
    "batch_search_dot": _batched(DOT),
    "batch_search_euclidean": _batched(EUC),
    "knn_join_euclidean": _knn_euclidean,
    "stale_handle": _stale_handle,
    "append_during_compaction": _append_during_compaction,
    "log_records": _log_records,
    "vector_files": _vector_files,
    "delete_collection": _delete,
    "flush_isolation": _flush_isolation,
    "damaged_left_out": _damaged_left_out,
    "flush_worker": _worker,
    "names": _names,
    "ulids": _ulids,
    "settings": _settings,
    "hnsw_recall": _hnsw_recall,
    "hnsw_recall_measured": _hnsw_recall_measured,
    "hnsw_monotone": _hnsw_monotone,
    "hnsw_exhaustive": _hnsw_exhaustive,
    "hnsw_links": _hnsw_links,
    "hnsw_degrees": _hnsw_degrees,
    "service_search": _service_search,
    "service_routes": _service_routes,
    "service_drain": _service_drain,
}

_E = "SELECT e.vec_id, e.label, e.embedding::DOUBLE[] AS v, q.embedding::DOUBLE[] AS q FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
_S = {COS: "list_cosine_similarity(v, q)", DOT: "list_inner_product(v, q)", EUC: "1 / (1 + list_distance(v, q))"}
_ONCE = "SELECT vec_id, 1::BIGINT AS times, true AS dense FROM embeddings"


def _top(metric: Metric, k: int, where: str = "") -> str:
    """Best k of the best 5 k if there is a condition."""
    inner = f"SELECT vec_id, {_S[metric]} AS s FROM ({_E}) ORDER BY s DESC, vec_id LIMIT {5 * k if where else k}"
    return f"SELECT vec_id, round(s, 4) AS score FROM ({inner}) {where} ORDER BY s DESC, vec_id LIMIT {k}"


def _json(**values) -> str:
    return json.dumps(values, sort_keys=True)


_BAD_INDEX = "Validation error: Invalid index type. Use: flat, hnsw"
ORACLE_SQL: dict[str, str] = {
    "get_by_id": "SELECT vec_id, label, (i - 1)::INT AS place, embedding[i]::DOUBLE AS component FROM embeddings, range(1, 65) t(i) WHERE vec_id = 7",
    "get_missing": "SELECT vec_id, label, 0::INT AS place, embedding[1]::DOUBLE AS component FROM embeddings WHERE vec_id = 1000000000",
    "collection_detail": "SELECT 'embeddings' AS name, 'cosine' AS metric, count(*) AS vector_count, max(len(embedding)) AS dimension FROM embeddings",
    "dimension_guard": "SELECT d::BIGINT AS dimension, (SELECT CASE WHEN bool_and(len(embedding) = d) THEN count(*) ELSE 0 END FROM embeddings)::BIGINT AS taken, d <> 64 AS query_refused FROM (VALUES (63), (64), (65)) t(d)",
    "collection_search": _top(COS, 10),
    "collection_search_filtered": _top(COS, 10, "WHERE vec_id % 2 = 1"),
    "collection_search_hnsw": _top(COS, 10),
    "collection_search_hnsw_filtered": _top(COS, 10, "WHERE vec_id % 2 = 1"),
    "search_empty": "SELECT vec_id, 0::DOUBLE AS score FROM embeddings WHERE false",
    "batch_search_cosine": _top(COS, 10),
    "batch_search_dot": _top(DOT, 10),
    "batch_search_euclidean": _top(EUC, 10),
    "knn_join_euclidean": """SELECT qid, vec_id, rank::INT AS rank FROM (
      SELECT a.vec_id AS qid, b.vec_id AS vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
      FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 10""",
    "stale_handle": _ONCE,
    "append_during_compaction": _ONCE,
    "log_records": ROWS,
    "vector_files": "SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last, true AS several_files FROM embeddings",
    "delete_collection": _values([("kept", 1, 1)], "name, generation, vector_count"),
    "flush_isolation": _values([("a", 1), ("b", 0), ("c", 1)], "name, generation"),
    "damaged_left_out": _values([("good", 20)], "name, vector_count"),
    "flush_worker": "SELECT true AS by_itself, 0::BIGINT AS open_batches, count(*) + 1 AS vector_count FROM embeddings",
    "names": _values([("cosine", "cosine", _BAD_INDEX), ("Cosine", "cosine", _BAD_INDEX), ("EUCLIDEAN", "euclidean", _BAD_INDEX), ("dot_product", "dot_product", _BAD_INDEX), ("DotProduct", "dot_product", _BAD_INDEX), ("l1", None, _BAD_INDEX), ("flat", None, "flat"), ("HNSW", None, "hnsw"), ("ivf", None, _BAD_INDEX), ("", None, _BAD_INDEX)], "spelling, metric, index_type"),
    "ulids": r"""SELECT vec_id, ok AS is_ulid, CASE WHEN ok THEN upper(text) END AS parsed FROM (
      SELECT vec_id, text, regexp_matches(upper(text), '^[0-7][0-9A-HJKMNP-TV-Z]{25}$') AS ok FROM (
        SELECT vec_id, (['07', '8', 'AZ', '7u', '7I'])[vec_id % 5 + 1] || lpad((vec_id * 977)::VARCHAR, 24, '0') AS text FROM embeddings))""",
    "settings": "SELECT '/x' AS data_dir, 'h' AS host, 1::BIGINT AS port, 7::BIGINT AS flush_interval, 7::BIGINT AS worker_interval, true AS ulids_ok",
    "hnsw_recall": "SELECT true AS recall_passes",
    "hnsw_monotone": "SELECT true AS wider_is_no_worse",
    "hnsw_exhaustive": _top(COS, 10),
    "hnsw_links": _top(COS, 10),
    "hnsw_degrees": "SELECT count(*) AS nodes, 0::BIGINT AS too_many, 0::BIGINT AS to_itself, 0::BIGINT AS unaligned FROM embeddings",
    "service_search": f"""SELECT vec_id, round(s, 4) AS score, label, 0::INT AS parity, CASE WHEN vec_id % 2 = 1 THEN 'ext-' || vec_id END AS external_id, 64::INT AS components, v[1] AS first
      FROM (SELECT *, {_S[COS]} AS s FROM ({_E})) WHERE vec_id < 10 AND vec_id % 2 = 0 ORDER BY s DESC, vec_id LIMIT 5""",
    "service_routes": _values(
        [
            ("health", 200, _json(status="ok")),
            ("detail", 200, _json(name="api", dimension=2, metric="cosine", vector_count=0)),
            ("insert", 201, _json(id=0)),
            ("insert_again", 201, _json(id=1)),
            ("detail_after", 200, _json(name="api", dimension=2, metric="cosine", vector_count=2)),
            ("wrong_dimension", 400, _json(error="Vector dimension 1 does not match collection dimension 2")),
            ("wrong_query", 400, _json(error="Query dimension 1 does not match collection dimension 2")),
            ("wrong_metric", 400, _json(error="Invalid metric. Use: cosine, euclidean, dot_product")),
            ("wrong_index", 400, _json(error=_BAD_INDEX)),
            ("wrong_id", 400, _json(error="Invalid ID nope, expected ULID")),
            ("no_such", 404, _json(error="Collection not found")),
            ("no_route", 404, _json(error="Not found")),
            ("openapi", 200, "get /collections/{id},get /health,post /collections,post /collections/{id}/search,post /collections/{id}/vectors"),
            ("swagger_ui", 200, "True"),
        ],
        "request, status, answer",
    ),
    "service_drain": _values([(1, 0, 1)], "generation, open_batches, vector_count"),
}
