"""Similarity metrics as column expressions.

``float32`` accumulates one component after another in single precision;
``float64`` in double precision. Both are higher-order functions in the JVM. (A sum
written out component by component would be compiled with the stage, but planning
it takes seconds at 64 dimensions; large scans are scored in Arrow batches instead,
see ``operators.flat``.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Metric


def query_vector(values: Sequence[float], kind: str = "float") -> Column:
    """A query as an array literal, folded into the plan."""
    return F.array(*[F.lit(float(v)).cast(kind) for v in values])


def _kind(precision: str) -> str:
    return {"float32": "float", "float64": "double"}[precision]


def _sum(a: Column, b: Column, term, kind: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast(kind), y.cast(kind))), F.lit(0.0).cast(kind), lambda s, x: s + x)


def same_length(a: Column, b: Column, value: Column) -> Column:
    """``value``, or an error where the vectors' lengths differ."""
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("Vector lengths differ")).cast("float"))


def dot_product(a: Column, b: Column, precision: str = "float32") -> Column:
    return _sum(a, b, lambda x, y: x * y, _kind(precision))


def euclidean_distance(a: Column, b: Column, precision: str = "float32") -> Column:
    kind = _kind(precision)
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y), kind)).cast(kind)


def magnitude(a: Column, precision: str = "float32") -> Column:
    kind = _kind(precision)
    return F.sqrt(_sum(a, a, lambda x, y: x * y, kind)).cast(kind)


def cosine_similarity(a: Column, b: Column, precision: str = "float32") -> Column:
    """0 where either vector has no magnitude."""
    kind = _kind(precision)
    zero = F.lit(0.0).cast(kind)

    def of(s: Column) -> Column:
        both = (s["a"] * s["b"]).cast(kind)
        return F.when((s["a"] == 0) | (s["b"] == 0), zero).otherwise(F.try_divide(s["dot"], both).cast(kind))

    # bound once: a fold that is written twice is run twice
    once = F.struct(dot_product(a, b, precision).alias("dot"), magnitude(a, precision).alias("a"), magnitude(b, precision).alias("b"))
    return F.element_at(F.transform(F.array(once), of), 1)


def distance(metric: Metric, a: Column, b: Column, precision: str = "float32") -> Column:
    """Smaller is nearer."""
    one = F.lit(1.0).cast(_kind(precision))
    if metric is Metric.COSINE:
        return one - cosine_similarity(a, b, precision)
    if metric is Metric.DOT_PRODUCT:
        return -dot_product(a, b, precision)
    return euclidean_distance(a, b, precision)


def distance_to_score(metric: Metric, d: Column, precision: str = "float32") -> Column:
    kind = _kind(precision)
    one = F.lit(1.0).cast(kind)
    if metric is Metric.COSINE:
        return (one - d).cast(kind)
    if metric is Metric.DOT_PRODUCT:
        return (-d).cast(kind)
    return F.try_divide(one, one + d).cast(kind)


def score(metric: Metric, a: Column, b: Column, precision: str = "float32") -> Column:
    """Higher is better for every metric."""
    if metric is Metric.COSINE:
        return cosine_similarity(a, b, precision)
    if metric is Metric.DOT_PRODUCT:
        return dot_product(a, b, precision)
    return distance_to_score(metric, euclidean_distance(a, b, precision), precision)


def guarded(vector: Column, dimension: int) -> Column:
    """The vector, or an error unless it has the dimension and finite components."""
    bad_size = F.raise_error(F.lit(f"Vector dimension does not match collection dimension {dimension}")).cast("array<float>")
    bad_value = F.raise_error(F.lit("Vector has components that are not finite")).cast("array<float>")
    limit = F.lit(3.4028234663852886e38)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= limit))
    return F.when(vector.isNull() | (F.size(vector) != dimension), bad_size).when(~finite, bad_value).otherwise(vector.cast("array<float>"))
