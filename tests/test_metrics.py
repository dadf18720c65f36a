import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.functions import metrics as M
from halyard.functions import sql
from halyard.model import Metric

# value pairs and expected results of the metric contract
COSINE = [([1, 2, 3], [1, 2, 3], 1), ([1, 0], [0, 1], 0), ([1, 2, 3], [-1, -2, -3], -1), ([1, 2, 3], [2, 4, 6], 1), ([0, 0, 0], [1, 2, 3], 0)]
DOT = [([1, 2, 3], [4, 5, 6], 32), ([0, 0, 0], [1, 2, 3], 0), ([-1, 2, -3], [1, -2, 3], -14)]
EUCLIDEAN = [([1, 2, 3], [1, 2, 3], 0), ([1, 2, 3], [4, 6, 8], 7.0710678), ([-1, -2, -3], [1, 2, 3], 7.4833148), ([5], [10], 5)]
FUNCTIONS = {"vector_cosine": (M.cosine_similarity, COSINE), "vector_dot": (M.dot_product, DOT), "vector_l2": (M.euclidean_distance, EUCLIDEAN)}


def frame(spark, pairs):
    return spark.createDataFrame([(i, [float(x) for x in a], [float(x) for x in b]) for i, (a, b, *_) in enumerate(pairs)], "i int, a array<float>, b array<float>")


@pytest.mark.parametrize("name", FUNCTIONS)
def test_values(spark, name):
    f, cases = FUNCTIONS[name]
    sql.register(spark)
    df = frame(spark, cases)
    df.createOrReplaceTempView("pairs")
    for rows in (
        df.select("i", f(F.col("a"), F.col("b")).alias("v")),
        df.select("i", f(F.col("a"), F.col("b"), "float64").alias("v")),
        spark.sql(f"SELECT i, {name}(a, b) AS v FROM pairs"),
    ):
        got = {r["i"]: r["v"] for r in rows.collect()}
        assert all(abs(got[i] - want) < 1e-6 for i, (_, _, want) in enumerate(cases))


@pytest.mark.parametrize("name", FUNCTIONS)
def test_length_mismatch_is_an_error(spark, name):
    f, _ = FUNCTIONS[name]
    df = frame(spark, [([1, 2], [1, 2, 3])])
    with pytest.raises(Exception, match="lengths differ"):
        df.select(M.same_length(F.col("a"), F.col("b"), f(F.col("a"), F.col("b")))).collect()


def sequential(a, b, metric):
    """Single precision, one component after another."""
    z, dot, na, nb, d2 = np.float32(0), np.float32(0), np.float32(0), np.float32(0), np.float32(0)
    for x, y in zip(a, b, strict=True):
        dot, na, nb = dot + x * y, na + x * x, nb + y * y
        d2 = d2 + (x - y) * (x - y)
    if metric is Metric.DOT_PRODUCT:
        return dot
    if metric is Metric.COSINE:
        m = np.sqrt(na) * np.sqrt(nb)
        return z if m == 0 else dot / m
    return np.float32(1) / (np.float32(1) + np.sqrt(d2))


@pytest.mark.parametrize("metric", Metric)
def test_single_precision_bit_for_bit(spark, metric):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2, 24)).astype(np.float32)
    x[0, 0] = 0
    df = frame(spark, [(a.tolist(), b.tolist()) for a, b in x])
    got = {r["i"]: r["s"] for r in df.select("i", M.score(metric, F.col("a"), F.col("b")).alias("s")).collect()}
    for i, (a, b) in enumerate(x):
        assert np.float32(got[i]) == sequential(a, b, metric)


def test_distance_and_score_forms(spark):
    df = frame(spark, [([3, 4], [4, 3])])
    a, b = F.col("a"), F.col("b")
    row = df.select(*[M.distance(m, a, b).alias(m.value) for m in Metric], *[M.distance_to_score(m, M.distance(m, a, b)).alias(f"s_{m.value}") for m in Metric]).first()
    assert row["cosine"] == pytest.approx(0.04, abs=1e-6) and row["dot_product"] == -24 and row["euclidean"] == pytest.approx(2**0.5)
    assert row["s_cosine"] == pytest.approx(0.96) and row["s_dot_product"] == 24 and row["s_euclidean"] == pytest.approx(1 / (1 + 2**0.5))


def test_table_function(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "id long, vector array<float>")
    df.createOrReplaceTempView("axes")
    sql.register_search(spark, "nearest_axes", "axes", 2)
    assert [r["id"] for r in spark.sql("SELECT * FROM nearest_axes(array(cast(1 AS FLOAT), cast(0 AS FLOAT)))").collect()] == [0, 2]
