"""Registered queries of the vector engine over the ``embeddings`` table, and the
SQL each must agree with. Scores are compared in double precision, rounded after
ordering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.ids import new_ulid
from ..functions.metadata import Filter
from ..model import EngineConfig, IndexType, Metric
from ..operators import flat
from ..sources.fs import FileSystem
from .collection import Collection, Engine, candidates, search_plan

COS, EUC, DOT = Metric.COSINE, Metric.EUCLIDEAN, Metric.DOT_PRODUCT
DIM = 64


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a vectors table."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("parity"), (F.col("vec_id") % 2).cast("string")).alias("metadata"), F.concat(F.lit("ext-"), F.col("vec_id").cast("string")).alias("external_id"))


def _query(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> DataFrame:
    """The one query row."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


def _with_query(spark: SparkSession, sf_dir: str, vectors: DataFrame | None = None) -> DataFrame:
    v = _vectors(spark, sf_dir) if vectors is None else vectors
    return v.join(F.broadcast(_query(spark, sf_dir)))  # one row: a key lookup


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def _top(metric: Metric, k: int, where: Filter | None = None) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = _with_query(spark, sf_dir)
        return _rounded(search_plan(v, F.col("q"), k, metric, where, "float64"))

    return run


def _score_all(metric: Metric) -> Callable:
    def run(spark, sf_dir):
        return _rounded(flat.scored(_with_query(spark, sf_dir), F.col("q"), metric, "float64"))

    return run


def _cosine_zero(spark, sf_dir):
    """Every fifth vector set to zero scores 0."""
    v = _with_query(spark, sf_dir).withColumn("vector", F.when(F.col("id") % 5 == 0, F.transform("vector", lambda x: x * F.lit(0).cast("float"))).otherwise(F.col("vector")))
    return _rounded(flat.scored(v, F.col("q"), COS, "float64"))


def _distance_form(spark, sf_dir):
    v = _with_query(spark, sf_dir)
    d = {m: metrics.distance(m, F.col("vector"), F.col("q"), "float64") for m in Metric}
    return v.select(F.col("id").alias("vec_id"), *[F.round(x, 6).alias(f"{m.value}_distance") for m, x in d.items()], *[F.round(metrics.distance_to_score(m, x, "float64"), 6).alias(f"{m.value}_score") for m, x in d.items()])


def _filtered_cap(spark, sf_dir):
    """Six copies of each vector, so that the cap of 2,000 candidates binds."""
    v = _vectors(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("id", F.col("id") * 6 + F.col("copy"))
    v = _with_query(spark, sf_dir, v.drop("copy"))
    return _rounded(search_plan(v, F.col("q"), 1000, COS, Filter.eq("parity", 1), "float64"))


def _filter_types(spark, sf_dir):
    """Integer labels match the integer alone, not 3.0, "3" or null."""
    v = _vectors(spark, sf_dir)
    return v.select(F.col("id").alias("vec_id"), *[Filter.eq("label", x).column().alias(n) for n, x in (("as_int", 3), ("as_float", 3.0), ("as_text", "3"), ("as_null", None))], Filter.eq("no_such", 3).column().alias("missing"))


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, EngineConfig(data_dir=f"{_work_dir(spark)}/collections-{new_ulid()}"))


def _work_dir(spark: SparkSession) -> str:
    """A folder all executors share: that of spark.checkpoint.dir, on a local
    session without one a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:  # shared by contract: in full, it is told from a folder of one machine
        return FileSystem(spark).qualified(found)
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    import tempfile

    return tempfile.mkdtemp(prefix="halyard-")


def _stored(spark, sf_dir, index: IndexType = IndexType.FLAT, metric: Metric = COS) -> Collection:
    c = _engine(spark).create("embeddings", DIM, metric, index)
    c.insert_df(_vectors(spark, sf_dir).orderBy("id"))
    return c


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("vec_id"), F.element_at("metadata", "label").cast("int").alias("label"), "external_id")


def _ordinal_ids(spark, sf_dir):
    """Ids given by the log are the rows' places in the order of insertion."""
    c = _stored(spark, sf_dir)
    return c.vectors().select(F.regexp_extract("external_id", r"ext-(\d+)", 1).cast("long").alias("vec_id"), F.col("id").alias("ordinal"))


def _external_ids(spark, sf_dir):
    """The empty external id reads as null."""
    c = _engine(spark).create("external", DIM, COS)
    v = _vectors(spark, sf_dir).orderBy("id")
    c.insert_df(v.withColumn("external_id", F.when(F.col("id") % 3 != 0, F.col("external_id")).otherwise("")))
    return c.vectors().select(F.col("id").alias("vec_id"), "external_id")


def _snapshot_roundtrip(spark, sf_dir):
    c = _stored(spark, sf_dir).compact()
    return _rows(Collection(c.store, c.store.manifest(c.id)).vectors())


def _wal_replay(spark, sf_dir):
    c = _stored(spark, sf_dir)
    return _rows(Collection(c.store, c.store.manifest(c.id)).vectors())


def _compact_then_reload(spark, sf_dir):
    """Rows logged before and after a snapshot count once each."""
    c = _engine(spark).create("embeddings", DIM, COS)
    v = _vectors(spark, sf_dir)
    half = v.agg((F.count("*") / 2).cast("long")).first()[0]
    c.insert_df(v.filter(F.col("id") < half).orderBy("id"))
    c.compact()
    c.insert_df(v.filter(F.col("id") >= half).orderBy("id"))
    loaded = c.store.load_all()
    return _rows(Collection(c.store, loaded[0]).vectors())


def _snapshot_header(spark, sf_dir):
    c = _stored(spark, sf_dir).compact()
    m = c.store.manifest(c.id)
    return spark.createDataFrame([(m.index_type, m.metric, m.dimension, m.generation, m.vector_count, m.version)], "index_type string, metric string, dimension int, generation long, vector_count long, version int")


def _knn_queries(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return v.filter(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), "vector")


def _knn_join(spark, sf_dir):
    return flat.knn_join(_knn_queries(spark, sf_dir), _vectors(spark, sf_dir), 10, COS, precision="float64").select("qid", F.col("id").alias("vec_id"), "rank")


def _list_collections(spark, sf_dir):
    """Manifests of a folder: two collections, one with rows."""
    e = _engine(spark)
    e.create("empty", 3, EUC)
    c = e.create("embeddings", DIM, DOT)
    c.insert_df(_vectors(spark, sf_dir))
    rows = [(d["name"], d["dimension"], d["metric"], d["vector_count"]) for d in (x.detail() for x in e.list())]
    return spark.createDataFrame(rows, "name string, dimension int, metric string, vector_count long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "score_cosine": _score_all(COS),
    "score_dot": _score_all(DOT),
    "score_euclidean": _score_all(EUC),
    "cosine_zero_vector": _cosine_zero,
    "distance_form": _distance_form,
    "topk_cosine": _top(COS, 10),
    "topk_dot": _top(DOT, 10),
    "topk_euclidean": _top(EUC, 10),
    "topk_filtered": _top(COS, 10, Filter.eq("parity", 0)),
    "topk_filtered_cap": _filtered_cap,
    "topk_underfilled": _top(DOT, 10, Filter.eq("label", 3)),
    "topk_k_zero": _top(COS, 0),
    "topk_k_gt_n": _top(EUC, 100_000),
    "filter_type_strict": _filter_types,
    "ordinal_ids": _ordinal_ids,
    "external_ids": _external_ids,
    "snapshot_roundtrip": _snapshot_roundtrip,
    "wal_replay": _wal_replay,
    "compact_then_reload": _compact_then_reload,
    "snapshot_header": _snapshot_header,
    "knn_join": _knn_join,
    "list_collections": _list_collections,
}

_E = "SELECT e.vec_id, e.label, e.embedding::DOUBLE[] AS v, q.embedding::DOUBLE[] AS q FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
_S = {COS: "list_cosine_similarity(v, q)", DOT: "list_inner_product(v, q)", EUC: "1 / (1 + list_distance(v, q))"}
_ROWS = "SELECT vec_id, label, 'ext-' || vec_id AS external_id FROM embeddings"


def _sql_top(metric: Metric, k: int, where: str | None = None) -> str:
    inner = f"SELECT vec_id, label, {_S[metric]} AS s FROM ({_E}) ORDER BY s DESC, vec_id LIMIT {candidates(k, where is not None)}"
    return f"SELECT vec_id, round(s, 6) AS score FROM ({inner}){f' WHERE {where}' if where else ''} ORDER BY s DESC, vec_id LIMIT {k}"


ORACLE_SQL: dict[str, str] = {
    **{name: f"SELECT vec_id, round({_S[m]}, 6) AS score FROM ({_E})" for name, m in (("score_cosine", COS), ("score_dot", DOT), ("score_euclidean", EUC))},
    "cosine_zero_vector": f"SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 0.0::DOUBLE ELSE round({_S[COS]}, 6) END AS score FROM ({_E})",
    "distance_form": f"""SELECT vec_id, round(1 - {_S[COS]}, 6) AS cosine_distance, round(list_distance(v, q), 6) AS euclidean_distance, round(-{_S[DOT]}, 6) AS dot_product_distance,
      round(1 - (1 - {_S[COS]}), 6) AS cosine_score, round({_S[EUC]}, 6) AS euclidean_score, round({_S[DOT]}, 6) AS dot_product_score FROM ({_E})""",
    "topk_cosine": _sql_top(COS, 10),
    "topk_dot": _sql_top(DOT, 10),
    "topk_euclidean": _sql_top(EUC, 10),
    "topk_filtered": _sql_top(COS, 10, "vec_id % 2 = 0"),
    "topk_filtered_cap": f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id * 6 + i AS vec_id, vec_id % 2 AS parity, {_S[COS]} AS s FROM ({_E}), range(6) t(i) ORDER BY s DESC, 1 LIMIT 2000) WHERE parity = 1 ORDER BY s DESC, vec_id LIMIT 1000",
    "topk_underfilled": _sql_top(DOT, 10, "label = 3"),
    "topk_k_zero": _sql_top(COS, 0),
    "topk_k_gt_n": _sql_top(EUC, 100_000),
    "filter_type_strict": "SELECT vec_id, label = 3 AS as_int, false AS as_float, false AS as_text, false AS as_null, false AS missing FROM embeddings",
    "ordinal_ids": "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS ordinal FROM embeddings",
    "external_ids": "SELECT vec_id, nullif(CASE WHEN vec_id % 3 <> 0 THEN 'ext-' || vec_id ELSE '' END, '') AS external_id FROM embeddings",
    "snapshot_roundtrip": _ROWS,
    "wal_replay": _ROWS,
    "compact_then_reload": _ROWS,
    "snapshot_header": "SELECT 'flat' AS index_type, 'cosine' AS metric, 64::INT AS dimension, 1::BIGINT AS generation, count(*) AS vector_count, 2::INT AS version FROM embeddings",
    "knn_join": """SELECT qid, vec_id, rank::INT AS rank FROM (
      SELECT a.vec_id AS qid, b.vec_id AS vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
      FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 10""",
    "list_collections": "SELECT 'empty' AS name, 3::INT AS dimension, 'euclidean' AS metric, 0::BIGINT AS vector_count UNION ALL SELECT 'embeddings', 64::INT, 'dot_product', count(*) FROM embeddings",
}


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: vector 0's nearest ten that carry its own label."""
    sf_dir = "/root/testdata/sf0.001"
    label = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id = 0").select("label").first()[0]
    return _top(COS, 10, Filter.eq("label", label))(spark, sf_dir)
