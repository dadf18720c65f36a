"""The metrics and the search as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), cast(0 AS FLOAT), (s, x) -> s + x)"
_NORM = "cast(sqrt(aggregate(transform({v}, x -> x * x), cast(0 AS FLOAT), (s, x) -> s + x)) AS FLOAT)"

SCALARS = {
    "vector_dot": _DOT,
    "vector_l2": "cast(sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), cast(0 AS FLOAT), (s, x) -> s + x)) AS FLOAT)",
    "vector_cosine": f"CASE WHEN {_NORM.format(v='a')} = 0 OR {_NORM.format(v='b')} = 0 THEN cast(0 AS FLOAT) ELSE cast(try_divide({_DOT}, cast({_NORM.format(v='a')} * {_NORM.format(v='b')} AS FLOAT)) AS FLOAT) END",
}


def register(spark: SparkSession) -> None:
    """vector_dot, vector_l2 and vector_cosine on ARRAY<FLOAT>."""
    for name, body in SCALARS.items():
        checked = f"CASE WHEN size(a) = size(b) THEN {body} ELSE cast(raise_error('Vector lengths differ') AS FLOAT) END"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS FLOAT RETURN {checked}")


def register_search(spark: SparkSession, name: str, view: str, k: int = 10) -> None:
    """A table function ``name(q)``: the k rows of ``view`` (id, vector, ...) nearest by cosine."""
    register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(q ARRAY<FLOAT>) RETURNS TABLE(id BIGINT, score FLOAT) RETURN SELECT v.id, vector_cosine(v.vector, {name}.q) AS score FROM {view} v ORDER BY score DESC, v.id LIMIT {int(k)}")
