"""Collections, their search plan and the engine that holds them."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.ids import new_ulid, parse_ulid
from ..functions.metadata import Filter, canon_map, from_json
from ..model import OVERSAMPLE, OVERSAMPLE_CAP, RESULT_SCHEMA, VECTORS_SCHEMA, BadRequest, EngineConfig, HnswParams, IndexType, Metric, NotFound, check_vector
from ..operators import flat, hnsw
from ..sources.store import CollectionStore, Manifest


log = logging.getLogger(__name__)


def candidates(k: int, filtered: bool, cap: int = OVERSAMPLE_CAP) -> int:
    """How many of the best rows a filter gets to see."""
    return min(OVERSAMPLE * k, cap) if filtered else k


def search_plan(vectors: DataFrame, query, k: int, metric: Metric, where: Filter | None = None, precision: str = "float32", rows: int = 0) -> DataFrame:
    """Scan, score, take the best candidates, filter those, take k.

    The filter sees a bounded number of the best rows and nothing else, so it
    may leave fewer than k; the limit below it keeps it from being pushed down.
    ``query`` is a column or a list of numbers; with a list and enough ``rows``
    the scan is scored in Arrow batches, with the same results.
    """
    want = candidates(k, where is not None)
    if isinstance(query, Column):
        found = flat.search(vectors, query, want, metric, precision)
    elif rows * len(query) >= flat.BATCHED_FROM and precision == "float32":
        found = flat.batch_search(vectors, query, want, metric)
    else:
        found = flat.search(vectors, metrics.query_vector(query), want, metric, precision)
    if where is not None:
        found = found.filter(where.column()).orderBy(*flat.best_first()).limit(k)
    return found


class Collection:
    """Vectors of one dimension under one metric and index.

    Every call sees what is committed when it is made; a DataFrame it returns
    stays readable until the second compaction after it."""

    def __init__(self, store: CollectionStore, manifest: Manifest):
        self.store, self.manifest = store, manifest

    spark = property(lambda self: self.store.spark)
    id = property(lambda self: self.manifest.id)
    name = property(lambda self: self.manifest.name)
    dimension = property(lambda self: self.manifest.dimension)
    metric = property(lambda self: Metric(self.manifest.metric))
    index_type = property(lambda self: IndexType(self.manifest.index_type))
    generation = property(lambda self: self.manifest.generation)

    def refresh(self) -> Collection:
        self.manifest = self.store.manifest(self.id)
        return self

    def __len__(self) -> int:
        return self.store.count(self.refresh().manifest)

    vector_count = property(__len__)

    def is_empty(self) -> bool:
        return len(self) == 0

    def insert(self, vector: Sequence[float], metadata: dict[str, Any] | None = None, external_id: str | None = None) -> int:
        """Logs one row and returns its id."""
        return self.insert_many([(vector, metadata, external_id)])

    def insert_many(self, rows: Sequence[tuple]) -> int:
        """Logs rows of (vector, metadata, external_id) in order, as one batch."""
        checked = [(check_vector(v, self.dimension, "Vector"), canon_map(m), e) for v, m, e in rows]
        df = self.spark.createDataFrame(checked, "vector array<float>, metadata map<string,string>, external_id string").coalesce(1)
        return self.store.append(self.manifest, df)

    def insert_df(self, df: DataFrame, metadata_json: str | None = None, stream: str | None = None, batch: int | None = None) -> int:
        """Logs a DataFrame's rows (vector; metadata as a canonical map, or the
        column of JSON text named; external_id), ids in the order of its files."""
        if metadata_json is not None:
            df = from_json(df, metadata_json).withColumnRenamed(metadata_json, "metadata")
        return self.store.append(self.manifest, df, stream, batch)

    def vectors(self) -> DataFrame:
        return self.store.vectors(self.refresh().manifest)

    def get(self, id_: int) -> DataFrame:
        return self.vectors().filter(F.col("id") == id_)

    def search(self, query: Sequence[float], k: int, where: Filter | None = None, ef_search: int | None = None) -> DataFrame:
        """Up to k rows of (id, score, vector, metadata, external_id), best first."""
        q = check_vector(query, self.dimension, "Query")
        if k < 0:
            raise BadRequest("k must not be negative")
        if k == 0 or not (rows := len(self)):
            return self.spark.createDataFrame([], RESULT_SCHEMA)
        columns = [f.name for f in RESULT_SCHEMA]
        if self.index_type is IndexType.FLAT or self.generation == 0:
            return search_plan(self.store.vectors(self.manifest), q, k, self.metric, where, rows=rows).select(columns)
        return self._graph_search(q, k, where, ef_search).select(columns)

    def _graph_search(self, q: list[float], k: int, where: Filter | None, ef_search: int | None) -> DataFrame:
        """The graphs' best and those of rows logged since, which no graph holds."""
        m, want = self.manifest, candidates(k, where is not None)
        open_, found = self.store._open(m), None
        if m.vector_count:
            found = hnsw.search(self.store.graph(m), [q], want, self.metric, m.hnsw, ef_search).select("id", "score")
        if (new := self.store.logged(m, open_)) is not None:
            exact = flat.search(new, metrics.query_vector(q), want, self.metric).select("id", "score")
            found = exact if found is None else found.unionByName(exact)
        found = found.orderBy(*flat.best_first()).limit(want)
        rows = self.store.vectors(m, open_).join(found, "id")
        return (rows if where is None else rows.filter(where.column())).orderBy(*flat.best_first()).limit(k)

    def compact(self) -> Collection:
        self.manifest = self.store.compact(self.manifest)
        return self

    def detail(self) -> dict:
        return {"id": self.id, "name": self.name, "dimension": self.dimension, "metric": self.metric.value, "vector_count": len(self)}

    def knn(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best for every row of (qid, vector)."""
        return flat.knn_join(queries, self.vectors(), k, self.metric)


class Engine:
    """A folder of collections."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None):
        self.store = CollectionStore(spark, config)

    def create(self, name: str, dimension: int, metric: Metric, index: IndexType = IndexType.FLAT, params: HnswParams = HnswParams()) -> Collection:
        if dimension < 1:
            raise BadRequest("dimension must be at least 1")
        return Collection(self.store, self.store.create(new_ulid(), name, dimension, metric, index, params))

    def collection(self, id_: str) -> Collection:
        return Collection(self.store, self.store.manifest(parse_ulid(id_)))

    def drop(self, id_: str) -> None:
        self.store.delete(parse_ulid(id_))

    def list(self) -> list[Collection]:
        """What can be read; a collection dropped meanwhile is left out."""
        return [Collection(self.store, m) for m in self.store.load_all(verify=False)]

    def load_all(self) -> list[Collection]:
        return [Collection(self.store, m) for m in self.store.load_all()]

    def flush(self) -> list[str]:
        """Compacts every collection with logged rows and returns their ids; one
        that fails is logged, stays as it was, and doesn't keep the others."""
        done = []
        for id_ in self.store.ids():
            try:
                c = Collection(self.store, self.store.manifest(id_))
                if c.store._open(c.manifest):
                    c.compact()
                    done.append(id_)
            except NotFound:
                continue  # dropped meanwhile
            except Exception:
                log.exception("collection %s not flushed", id_)
        return done


def in_memory(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """(vector, metadata, external_id) tuples as a vectors table, ids in order."""
    out = [(i, [float(x) for x in v], canon_map(m), e) for i, (v, m, e) in enumerate(rows)]
    return spark.createDataFrame(out, VECTORS_SCHEMA)
