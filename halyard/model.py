"""Enums, schemas, settings and errors of the vector engine."""

from __future__ import annotations

import math
import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType(), False)
METADATA = T.MapType(T.StringType(), T.StringType(), False)
#: Metadata values are canonical JSON text.
VECTORS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("vector", VECTOR, False),
    T.StructField("metadata", METADATA, False),
    T.StructField("external_id", T.StringType(), True),
])
RESULT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("score", T.FloatType()),
    T.StructField("vector", VECTOR),
    T.StructField("metadata", METADATA),
    T.StructField("external_id", T.StringType()),
])

#: With a filter, candidates examined for k results: k times OVERSAMPLE, at most OVERSAMPLE_CAP.
OVERSAMPLE, OVERSAMPLE_CAP = 5, 2000
FORMAT_VERSION = 2


class Metric(Enum):
    COSINE = "cosine"
    EUCLIDEAN = "euclidean"
    DOT_PRODUCT = "dot_product"

    @classmethod
    def parse(cls, text: str) -> Metric | None:
        return {"cosine": cls.COSINE, "euclidean": cls.EUCLIDEAN, "dot_product": cls.DOT_PRODUCT, "dotproduct": cls.DOT_PRODUCT}.get(text.lower())


class IndexType(Enum):
    FLAT = "flat"
    HNSW = "hnsw"

    @classmethod
    def parse(cls, text: str) -> IndexType:
        try:
            return cls(text.lower())
        except ValueError:
            raise ValidationError("Invalid index type. Use: flat, hnsw") from None


class EngineError(Exception):
    """Base of the engine's errors; ``status`` is what the service answers."""

    status = 500


class BadRequest(EngineError):
    status = 400


class ValidationError(BadRequest):
    def __str__(self) -> str:
        return f"Validation error: {super().__str__()}"


class DimensionMismatch(BadRequest, ValueError):
    pass


class NotFound(EngineError):
    status = 404


class CorruptData(EngineError):
    pass


@dataclass(frozen=True)
class HnswParams:
    m: int = 16
    ef_construction: int = 200
    ef_search: int | None = None

    def __post_init__(self):
        if self.m <= 1:
            raise ValueError("m must be greater than 1")
        if self.ef_construction <= 0:
            raise ValueError("ef_construction must be positive")

    @property
    def m_max0(self) -> int:
        return 2 * self.m

    @property
    def level_mult(self) -> float:
        return 1 / math.log(self.m)

    @property
    def ef(self) -> int:
        return self.ef_search or self.ef_construction


@dataclass(frozen=True)
class EngineConfig:
    """Settings, read from ``HALYARD_*`` variables unless given."""

    data_dir: str = field(default_factory=lambda: os.environ.get("HALYARD_DATA_DIR", "./data"))
    host: str = field(default_factory=lambda: os.environ.get("HALYARD_HOST", "0.0.0.0"))
    port: int = field(default_factory=lambda: int(os.environ.get("HALYARD_PORT", "8600")))
    flush_interval: int = field(default_factory=lambda: int(os.environ.get("HALYARD_FLUSH_INTERVAL", "60")))
    rows_per_shard: int = 20_000


def check_vector(vector: Sequence[float], dimension: int, what: str) -> list[float]:
    """A query or single insert, refused unless finite and of the dimension."""
    if len(vector) != dimension:
        raise DimensionMismatch(f"{what} dimension {len(vector)} does not match collection dimension {dimension}")
    out = [float(x) for x in vector]
    if not all(math.isfinite(x) and abs(x) <= 3.4028235677973366e38 for x in out):
        raise BadRequest(f"{what} has components that are not finite")
    return out
