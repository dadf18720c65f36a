import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from halyard.functions import metrics as M
from halyard.functions.ids import is_ulid, new_ulid, parse_ulid, sha256_column, sha256_hex
from halyard.functions.metadata import Filter, canon, from_json
from halyard.model import BadRequest, EngineConfig, HnswParams, IndexType, Metric, ValidationError
from halyard.operators import flat, hnsw
from halyard.plans import engine_queries as eq
from halyard.plans.collection import candidates, in_memory, search_plan


def search(spark, vectors, query, k, metric=Metric.COSINE, where=None, metas=None, externals=None):
    metas, externals = metas or [{}] * len(vectors), externals or [None] * len(vectors)
    df = in_memory(spark, list(zip(vectors, metas, externals, strict=True)))
    return search_plan(df, M.query_vector(query), k, metric, where).collect()


AXES = [[1, 0, 0], [0, 1, 0], [1, 1, 0]]


def test_rankings(spark):
    out = search(spark, AXES, [1, 0, 0], 3)
    assert [r["id"] for r in out] == [0, 2, 1] and out[0]["score"] == 1 and out[2]["score"] == 0
    out = search(spark, [[1, 2], [3, 4]], [1, 1], 2, Metric.DOT_PRODUCT)
    assert [(r["id"], r["score"]) for r in out] == [(1, 7), (0, 3)]
    out = search(spark, [[1, 0], [10, 10]], [1, 0], 2, Metric.EUCLIDEAN)
    assert out[0]["id"] == 0 and out[0]["score"] == 1 and out[1]["score"] < 1


def test_k(spark):
    many = [[i, 1] for i in range(10)]
    assert len(search(spark, many, [1, 0], 3)) == 3
    assert len(search(spark, many, [1, 0], 100)) == 10
    assert search(spark, many, [1, 0], 0) == []
    assert search(spark, [], [1, 0], 5) == []
    rows = search(spark, [[i * 4 + j for j in range(4)] for i in range(500)], [1, 2, 3, 4], 10)
    assert len(rows) == 10 and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)


def test_ties_go_to_the_smaller_id_and_nan_is_last(spark):
    assert [r["id"] for r in search(spark, [[1, 0]] * 4 + [[2, 0]], [1, 0], 3)] == [0, 1, 2]
    df = spark.createDataFrame([(0, float("nan")), (1, 0.5), (2, -1.0)], "id long, score float")
    assert [r["id"] for r in df.orderBy(*flat.best_first()).collect()] == [1, 2, 0]


def test_filter_values(spark):
    values = [1, 1.0, "1", True, None, [1, 2], {"x": 1, "y": 2}]
    metas = [{"a": v} for v in values] + [{"b": 1}]
    vectors = [[1, i] for i in range(len(metas))]
    for i, v in enumerate(values):
        assert [r["id"] for r in search(spark, vectors, [1, 0], 8, where=Filter.eq("a", v), metas=metas)] == [i]
    assert [r["id"] for r in search(spark, vectors, [1, 0], 8, where=Filter.eq("a", {"y": 2, "x": 1}), metas=metas)] == [6]
    assert search(spark, vectors, [1, 0], 8, where=Filter.eq("a", [2, 1]), metas=metas) == []
    assert search(spark, vectors, [1, 0], 8, where=Filter.eq("c", None), metas=metas) == []


def test_canonical_json(spark):
    assert canon({"b": [1, 1.0, -0.0, 1e300, True, None, "é\"\n"], "a": {}}) == '{"a":{},"b":[1,1.0,0.0,1e+300,true,null,"é\\"\\n"]}'
    with pytest.raises(BadRequest):
        canon(float("inf"))
    df = spark.createDataFrame([(1, '{"k": 2.0, "s": "x"}'), (2, None)], "id int, m string")
    assert {r["id"]: r["m"] for r in from_json(df, "m").collect()} == {1: {"k": "2.0", "s": '"x"'}, 2: {}}
    assert Filter.parse({"op": "eq", "key": "k", "value": 1}) == Filter.eq("k", 1)
    for bad in ({"op": "ne", "key": "k", "value": 1}, {"op": "eq", "key": 1, "value": 1}, {"op": "eq", "key": "k"}):
        with pytest.raises(BadRequest):
            Filter.parse(bad)


def test_filter_sees_only_the_oversampled_candidates(spark):
    n = 100
    vectors, metas = [[1, i] for i in range(n)], [{"far": i == n - 1} for i in range(n)]
    assert search(spark, vectors, [1, 0], 10, where=Filter.eq("far", True), metas=metas) == []
    assert [r["id"] for r in search(spark, vectors, [1, 0], 20, where=Filter.eq("far", True), metas=metas)] == [99]
    assert candidates(1000, True) == 2000 and candidates(3000, True) == 2000 and candidates(3000, False) == 3000 and candidates(10, True) == 50


@pytest.mark.parametrize("metric", Metric)
def test_batches_score_the_same_bits(spark, metric, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 24)).astype(np.float32)
    x[7] = x[8] = x[100]
    x[3] = 0
    df = in_memory(spark, [(v, {"p": i % 2}, f"e{i}") for i, v in enumerate(x.tolist())]).repartition(4)
    for where in (None, Filter.eq("p", 1)):
        a = search_plan(df, x[100].tolist(), 20, metric, where).collect()
        monkeypatch.setattr(flat, "BATCHED_FROM", 0)
        b = search_plan(df, x[100].tolist(), 20, metric, where, rows=300).collect()
        monkeypatch.undo()
        assert [r.asDict() for r in a] == [r.asDict() for r in b] and len(a) == 20
    assert [r["id"] for r in a][:1] == [7]


def test_plan_shape(spark):
    df = in_memory(spark, [([1, 0], {"a": 1}, None)])
    plan = search_plan(df, M.query_vector([1, 0]), 10, Metric.COSINE, Filter.eq("a", 1))._jdf.queryExecution().executedPlan().toString()
    top = plan.index("TakeOrderedAndProject(limit=10")
    assert top < plan.index("Filter", top) < plan.index("TakeOrderedAndProject(limit=50") and "Exchange" not in plan


def test_knn_join_equals_single_searches(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    df = in_memory(spark, [(v, {}, None) for v in x.tolist()]).repartition(5)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 120, 10)], "qid long, vector array<float>")
    for metric in Metric:
        for block in (flat.QUERY_BLOCK_BYTES, 100):
            got = {(r["qid"], r["rank"]): r["id"] for r in flat.knn_join(queries, df, 5, metric, block).collect()}
            assert len(got) == 60
            for i in (0, 50, 110):
                want = search_plan(df, M.query_vector(x[i].tolist()), 5, metric).collect()
                assert [got[i, r + 1] for r in range(5)] == [w["id"] for w in want]
    assert flat.knn_join(queries.limit(0), df, 5, Metric.COSINE).count() == 0


def recall(spark, n, d, k, ef, shards=1, metric=Metric.COSINE):
    rng = np.random.default_rng(11)
    x = rng.uniform(-1, 1, (n, d)).astype(np.float32)
    q = rng.uniform(-1, 1, (20, d)).astype(np.float32)
    df = in_memory(spark, [(v, {}, None) for v in x.tolist()])
    graph = hnsw.build(df, metric, shards=shards).cache()
    exact = np.array([flat.sequential_scores(x.T, y, metric) for y in q])
    out = {}
    for e in ef:
        found = {}
        for r in hnsw.search(graph, q.tolist(), k, metric, ef_search=e).collect():
            found.setdefault(r["qid"], set()).add(r["id"])
        out[e] = np.mean([len(found[i] & set(np.argsort(-exact[i])[:k].tolist())) / k for i in range(20)])
    return out


def test_graph_recall(spark):
    assert recall(spark, 1000, 32, 10, [100])[100] > 0.8
    r = recall(spark, 500, 32, 10, [10, 200])
    assert r[200] >= r[10]


def test_sharded_graph_recall(spark):
    assert recall(spark, 1000, 32, 10, [50], shards=4)[50] > 0.8


@pytest.mark.parametrize("metric", Metric)
def test_graph_small(spark, metric):
    df = in_memory(spark, [(v, {}, None) for v in AXES])
    graph = hnsw.build(df, metric)
    got = hnsw.search(graph, [[1, 0, 0]], 10, metric).collect()
    want = search_plan(df, M.query_vector([1, 0, 0]), 10, metric).collect()
    assert len(got) == 3 and all(abs(a["score"] - b["score"]) < 1e-6 for a, b in zip(got, want, strict=True))
    assert hnsw.search(graph, [[1, 0, 0]], 0, metric).count() == 0


def test_graph_form(spark):
    df = in_memory(spark, [([i, 1], {}, None) for i in range(300)])
    shards = hnsw.build(df, Metric.EUCLIDEAN, HnswParams(m=4, ef_construction=20), 2).cache()
    graph = hnsw.export_links(shards).cache()
    for r in graph.collect():
        assert len(r["nbr"]) == len(r["dist"]) <= (8 if r["layer"] == 0 else 4)
    assert graph.filter("layer = 0").count() == 300
    assert max(e["max_layer"] for e in hnsw.entries(graph).collect()) == graph.agg(F.max("layer")).first()[0]
    packed = lambda d: sorted(map(tuple, d.collect()))
    assert packed(hnsw.build(df, Metric.EUCLIDEAN, HnswParams(m=4, ef_construction=20), 2)) == packed(shards)
    assert packed(hnsw.import_links(df, graph, 2)) == packed(shards)


@pytest.mark.parametrize("metric", Metric)
def test_graph_search_of_many_queries_equals_single_ones(metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[600:] = x[:100]  # copies: distances that are equal
    g = hnsw.Graph(x, metric, HnswParams(m=4, ef_construction=20)).build([i % 7 == 0 for i in range(700)])
    q = np.concatenate([x[:60], rng.normal(size=(60, 8)).astype(np.float32), np.zeros((1, 8), np.float32)])
    for k, ef in ((5, 10), (10, 40), (10, 5000)):
        who, d, node = g.search_many(q, k, ef)
        for i in range(len(q)):
            want = g.search(q[i], k, ef)
            assert sorted(node[who == i]) == sorted(n for _, n in want)
            np.testing.assert_allclose(sorted(d[who == i]), [dn for dn, _ in want], atol=1e-5)
    none = hnsw.Graph(np.empty((0, 8), np.float32), metric, HnswParams()).build([])
    assert all(len(c) == 0 for c in [*none.search_many(q, 5, 10), *g.search_many(q, 0, 10)])


def test_graph_build_has_a_task_for_each_shard(spark):
    df = in_memory(spark, [([i, 1], {}, None) for i in range(40)])
    tasks = hnsw.build(df, Metric.COSINE, shards=7).withColumn("task", F.spark_partition_id()).select("shard", "rows", "task").collect()
    assert len({r["task"] for r in tasks}) == len(tasks) == 7 and sum(r["rows"] for r in tasks) == 40
    batch = pa.record_batch([pa.array([0, 0, 1, 2]), pa.array([1, 2, 3, 4])], ["shard", "id"])
    more = pa.record_batch([pa.array([2, 4]), pa.array([5, 6])], ["shard", "id"])
    assert [(s, t["id"].to_pylist()) for s, t in hnsw._by_shard([batch, batch.slice(0, 0), more])] == [(0, [1, 2]), (1, [3]), (2, [4, 5]), (4, [6])]


def test_query_graphs_grow_with_the_table(spark, tmp_path, monkeypatch):
    made, real = [], hnsw.build
    monkeypatch.setattr(hnsw, "build", lambda *a, **k: made.append(k["shards"]) or real(*a, **k))
    monkeypatch.setattr(eq, "EngineConfig", lambda: EngineConfig(rows_per_shard=50))
    for name in ("hnsw_degrees", "hnsw_exhaustive", "hnsw_links", "hnsw_recall"):
        eq.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert made == [max(n, hnsw.shard_count(rows, 50)) for n in (1, 3, 3, 1)]


def test_graph_search_plan_moves_results_only(spark, tmp_path):
    df = in_memory(spark, [([i, 1], {}, None) for i in range(50)])
    hnsw.build(df, Metric.COSINE, shards=4).write.parquet(str(tmp_path / "g"))
    plan = hnsw.search(spark.read.schema(hnsw.SHARD_SCHEMA).parquet(str(tmp_path / "g")), [[1, 0]], 5, Metric.COSINE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_knn_join_far_from_the_origin_and_with_ties(spark):
    rng = np.random.default_rng(2)
    x = (100 + 0.01 * rng.normal(size=(200, 8))).astype(np.float32)
    df = in_memory(spark, [(v, {}, None) for v in x.tolist()]).repartition(3)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 200, 50)], "qid long, vector array<float>")
    got = flat.knn_join(queries, df, 10, Metric.EUCLIDEAN).collect()
    assert all(r["id"] == r["qid"] and r["score"] == 1 for r in got if r["rank"] == 1)
    for i in (0, 50):
        want = search_plan(df, M.query_vector(x[i].tolist()), 10, Metric.EUCLIDEAN).collect()
        assert [(w["id"], w["score"]) for w in want] == sorted(((r["id"], r["score"]) for r in got if r["qid"] == i), key=lambda r: (-r[1], r[0]))
    same = np.ones((4000, 4), np.float32)
    row, col, _ = flat.best_of_block(same, np.arange(4000)[::-1], same[:50], 10, Metric.COSINE)
    assert len(row) == 500 and (np.sort(col.reshape(50, 10), axis=1) == np.arange(3990, 4000)).all()


def test_knn_join_holds_bounded_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    x[1500:] = x[:1500]  # every vector twice: ties by id
    one, real, seen = in_memory(spark, [([0.0] * 8, {}, None)]), flat.best_of_block, []
    ids = np.arange(3000)
    batches = [pa.record_batch([pa.array(ids[at : at + 1000]), pa.array(x[at : at + 1000].tolist(), pa.list_(pa.float32()))], ["id", "vector"]) for at in (0, 1000, 2000)]

    def spy(x, ids, q, *a):
        seen.append(len(x) * len(q))
        return real(x, ids, q, *a)

    monkeypatch.setattr(flat, "best_of_block", spy)
    monkeypatch.setattr(flat, "BLOCK_ROWS", 300)
    for metric in Metric:
        run = flat._scorer(one, ids, x, 10, metric, 4 * 300 * 400, "float64")
        out = pa.Table.from_batches(run(iter(batches))).to_pydict()
        assert len(out["qid"]) == 30_000 and max(seen) <= 300 * 400  # 10 a query and task, not a batch
        got = np.full((3000, 10), -1)
        for i in range(3000):
            got[i] = out["id"][10 * i : 10 * i + 10]
        assert out["qid"] == np.repeat(ids, 10).tolist()
        for i in range(0, 3000, 100):
            exact = flat.sequential_scores(x.T.astype(float), x[i].astype(float), metric)
            assert got[i].tolist() == np.lexsort((ids, -exact))[:10].tolist()


def test_knn_join_in_double_precision(spark):
    x = [[1.0, 0.0], [1.0, 3e-5], [1.0, 1e-5], [1.0, 2e-5]]  # cosines that single precision takes for 1
    df = in_memory(spark, [(v, {}, None) for v in x])
    queries = spark.createDataFrame([(0, x[0])], "qid long, vector array<float>")
    ranked = lambda **k: [r["id"] for r in flat.knn_join(queries, df, 4, Metric.COSINE, **k).orderBy("rank").collect()]
    assert ranked() == [0, 1, 2, 3] and ranked(precision="float64") == [0, 2, 3, 1]
    with pytest.raises(ValueError, match="lengths"):
        flat.knn_join(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0, 3.0])], "qid long, vector array<float>"), df, 1, Metric.COSINE)


def test_parsers_and_ids(spark):
    assert Metric.parse("Cosine") is Metric.COSINE and Metric.parse("DotProduct") is Metric.DOT_PRODUCT and Metric.parse("l1") is None
    assert IndexType.parse("HNSW") is IndexType.HNSW
    with pytest.raises(ValidationError, match="Validation error: Invalid index type. Use: flat, hnsw"):
        IndexType.parse("ivf")
    for bad in ({"m": 1}, {"ef_construction": 0}):
        with pytest.raises(ValueError):
            HnswParams(**bad)
    ids = {new_ulid() for _ in range(100)}
    assert len(ids) == 100 and all(len(i) == 26 and parse_ulid(i.lower()) == i for i in ids)
    with pytest.raises(BadRequest, match="Invalid ID nope, expected ULID"):
        parse_ulid("nope")
    row = spark.createDataFrame([(next(iter(ids)), "8" * 26, "abc")], "a string, b string, c string").select(is_ulid(F.col("a")), is_ulid(F.col("b")), sha256_column(F.col("c"))).first()
    assert tuple(row) == (True, False, sha256_hex(b"abc"))
