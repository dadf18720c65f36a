"""Stored collections: snapshots by generation, an append log, manifests.

A collection's folder holds one manifest a generation, ``manifest-N.json``, which
only one writer can create and nobody changes; the highest counts. Each names its
Parquet tables' folder and the last log batch they include. A log batch is
``log/N.json``, again made by one writer only, beside the Parquet folder it names.
Batch numbers only go up: one that a snapshot includes is never given again. A
commit names its files with the ordinal of each file's first row, so ids are dense
ordinals that are never shuffled for: first ordinal plus row number in the file.

Writers read the manifest anew in every attempt and look again after a commit, so
a handle that is behind neither loses rows nor doubles them. Of two compactions at
once one commits and the other gives way. Compaction leaves the generation before
its own, and the batches that one is read with, to plans that were made on it.
"""

from __future__ import annotations

import json
import logging
import uuid
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import sha256_hex
from ..functions.metrics import guarded
from ..model import FORMAT_VERSION, METADATA, VECTORS_SCHEMA, CorruptData, EngineConfig, HnswParams, IndexType, Metric, NotFound
from ..operators import hnsw
from .fs import FileSystem

log = logging.getLogger(__name__)
#: Manifests kept, by which a commit that was overtaken is told.
KEPT_MANIFESTS = 8
#: Bytes of vectors in a snapshot's file, about: checksums read whole files.
FILE_BYTES = 128 << 20


@dataclass(frozen=True)
class Manifest:
    id: str
    name: str
    dimension: int
    metric: str
    index_type: str
    generation: int = 0
    vector_count: int = 0
    version: int = FORMAT_VERSION
    checksum: str = ""
    last_batch: int = -1
    folder: str = ""
    included: tuple = ()
    shards: int = 1
    m: int = 16
    m_max0: int = 32
    ef_construction: int = 200
    ef_search: int = 200
    level_mult: float = 0.0

    @property
    def hnsw(self) -> HnswParams:
        return HnswParams(self.m, self.ef_construction, self.ef_search)


class CollectionStore:
    def __init__(self, spark: SparkSession, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.fs = FileSystem(spark)

    @cached_property
    def root(self) -> str:
        """The collections' folder, refused unless all executors share it."""
        at = self.config.data_dir.rstrip("/")
        if not self.spark.sparkContext.master.startswith("local") and self.fs.scheme(self.config.data_dir) == "file" and not at.startswith("file:"):
            raise RuntimeError("data_dir must name a folder that all executors share (file:... if that is a mounted one)")
        return at

    def path(self, id_: str, *parts: str) -> str:
        return "/".join([self.root, id_, *parts])

    # manifests

    def create(self, id_: str, name: str, dimension: int, metric: Metric, index: IndexType, params: HnswParams = HnswParams()) -> Manifest:
        m = Manifest(id_, name, dimension, metric.value, index.value, m=params.m, m_max0=params.m_max0, ef_construction=params.ef_construction, ef_search=params.ef, level_mult=params.level_mult)
        if not self._put(m):
            raise CorruptData(f"{id_}: there is such a collection")
        return m

    def _manifest_path(self, id_: str, generation: int) -> str:
        return self.path(id_, f"manifest-{generation:012d}.json")

    def _put(self, m: Manifest) -> bool:
        """Whether the manifest is its generation's; False if another one is."""
        body = json.dumps(asdict(m), sort_keys=True)
        return self.fs.create(self._manifest_path(m.id, m.generation), json.dumps({"data": body, "sha256": sha256_hex(body.encode())}))

    def _generations(self, id_: str) -> list[int]:
        names = self.fs.list(self.path(id_))
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit())

    def manifest(self, id_: str, generation: int | None = None) -> Manifest:
        """The newest manifest, or that of a generation."""
        there = self._generations(id_)
        if not there or generation is not None and generation not in there:
            raise NotFound("Collection not found")
        try:
            outer = json.loads(self.fs.read(self._manifest_path(id_, there[-1] if generation is None else generation)))
            body = outer["data"]
            if sha256_hex(body.encode()) != outer["sha256"]:
                raise CorruptData(f"{id_}: manifest checksum differs")
            values = json.loads(body)
            m = Manifest(**values | {"included": tuple(values.get("included", ()))})
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptData(f"{id_}: manifest can't be read: {e}") from e
        if m.version != FORMAT_VERSION:
            raise CorruptData(f"{id_}: unsupported version {m.version}")
        return m

    def generation(self, id_: str) -> int:
        """The stored generation, 0 if there is none that can be read."""
        try:
            return self.manifest(id_).generation
        except (NotFound, CorruptData):
            return 0

    def ids(self) -> list[str]:
        return [n for n in self.fs.list(f"{self.root}/") if self._generations(n)]

    def load_all(self, verify: bool = True) -> list[Manifest]:
        """All collections that can be read; others are warned of and left out."""
        out = []
        for id_ in self.ids():
            try:
                m = self.manifest(id_)
                if verify:
                    self.verify(m)
                out.append(m)
            except (CorruptData, NotFound) as e:
                log.warning("collection left out: %s", e)
        return out

    def delete(self, id_: str) -> None:
        """Removes all of a collection; one that is gone already is fine."""
        self.fs.delete(self.path(id_))

    # rows

    def append(self, m: Manifest, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Logs (vector, metadata, external_id) rows; returns the first new id.

        With a stream and batch number a batch that was logged before is not
        logged again."""
        name = f"data-{uuid.uuid4().hex}"
        staged = self.path(m.id, "log", name)
        if self._logged(m := self.manifest(m.id), self._open(m), stream, batch):
            return self.count(m)
        metadata = F.coalesce(F.col("metadata"), F.create_map().cast(METADATA)) if "metadata" in rows.columns else F.create_map().cast(METADATA)
        external = F.col("external_id").cast("string") if "external_id" in rows.columns else F.lit(None).cast("string")
        rows.select(guarded(F.col("vector"), m.dimension).alias("vector"), metadata.alias("metadata"), external.alias("external_id")).write.parquet(staged)
        written = self.spark.read.parquet(staged)
        # one number for each file of the batch
        sizes = {r["f"]: r["n"] for r in written.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n")).collect()}
        while True:
            m = self.manifest(m.id)
            open_ = self._open(m)
            if self._logged(m, open_, stream, batch):
                self.fs.delete(staged)
                return self.count(m, open_)
            number = m.last_batch + len(open_) + 1
            if [k for k, _ in open_] != list(range(m.last_batch + 1, number)):
                continue  # overtaken while listing
            base = self.count(m, open_)
            files, at = {}, base
            for f in sorted(sizes):
                files[f], at = at, at + sizes[f]
            body = {"data": name, "base": base, "count": at - base, "files": files, "stream": stream, "batch": batch}
            if self.fs.create(self._entry(m, number), json.dumps(body)):
                if self._counts(m.id, number, name):
                    return base
                self.fs.delete(self._entry(m, number))

    def _entry(self, m: Manifest, number: int) -> str:
        return self.path(m.id, "log", f"{number:012d}.json")

    def _counts(self, id_: str, number: int, name: str) -> bool:
        """Whether the batch is read: not so if its number was one that snapshots
        have passed, by another batch, between the look at the log and the commit."""
        if self.manifest(id_).last_batch < number:
            return True
        return any(name in self.manifest(id_, g).included for g in self._generations(id_))

    def _commits(self, m: Manifest) -> list[int]:
        return sorted(int(n[:-5]) for n in self.fs.list(self.path(m.id, "log")) if n.endswith(".json") and n[:-5].isdigit())

    def _open(self, m: Manifest) -> list[tuple[int, dict]]:
        """Batches that the generation doesn't include."""
        out = []
        for n in self._commits(m):
            if n > m.last_batch:
                try:
                    out.append((n, json.loads(self.fs.read(self._entry(m, n)))))
                except ValueError as e:
                    raise CorruptData(f"{m.id}: log entry {n} can't be read: {e}") from e
        return out

    def _streams(self, m: Manifest) -> dict[str, int]:
        """The last batch of each stream that the generation includes."""
        seen = self.path(m.id, m.folder, "streams.json")
        return json.loads(self.fs.read(seen)) if m.folder and self.fs.exists(seen) else {}

    def _logged(self, m: Manifest, open_: list[tuple[int, dict]], stream: str | None, batch: int | None) -> bool:
        if stream is None:
            return False
        return any(c["stream"] == stream and c["batch"] == batch for _, c in open_) or self._streams(m).get(stream, -1) >= (batch or 0)

    def count(self, m: Manifest, open_: list[tuple[int, dict]] | None = None) -> int:
        return m.vector_count + sum(c["count"] for _, c in (self._open(m) if open_ is None else open_))

    def snapshot(self, m: Manifest) -> DataFrame:
        if m.generation == 0 or m.vector_count == 0:
            return self.spark.createDataFrame([], VECTORS_SCHEMA)
        return self.spark.read.schema(VECTORS_SCHEMA).parquet(self.path(m.id, m.folder, "vectors"))

    def logged(self, m: Manifest, open_: list[tuple[int, dict]] | None = None) -> DataFrame | None:
        """Rows of the open batches, with their ids, in one scan however many there
        are; None without any."""
        some = [c for _, c in (self._open(m) if open_ is None else open_) if c["count"]]
        if not some:
            return None
        start = F.create_map(*[F.lit(x) for c in some for f, s in c["files"].items() for x in (f, s)])
        d = self.spark.read.schema("vector array<float>, metadata map<string,string>, external_id string").parquet(*[self.path(m.id, "log", c["data"]) for c in some])
        return d.select((F.element_at(start, F.col("_metadata.file_name")) + F.col("_metadata.row_index")).cast("long").alias("id"), "vector", "metadata", "external_id")

    def vectors(self, m: Manifest, open_: list[tuple[int, dict]] | None = None) -> DataFrame:
        """All rows: the snapshot and what was logged since."""
        base, new = self.snapshot(m), self.logged(m, open_)
        all_ = base if new is None else new if m.vector_count == 0 else base.unionByName(new)
        return all_.withColumn("external_id", F.nullif("external_id", F.lit("")))

    def graph(self, m: Manifest) -> DataFrame:
        """The shards of the generation's graph."""
        return self.spark.read.schema(hnsw.SHARD_SCHEMA).parquet(self.path(m.id, m.folder, "graph"))

    # snapshots

    def compact(self, m: Manifest) -> Manifest:
        """A new generation with all rows (and the graph of an approximate
        index). Its manifest is the commit; clearing up follows. If another
        compaction commits first, that one's manifest comes back."""
        m = self.manifest(m.id)
        open_ = self._open(m)  # listed once: what is counted is what is read and passed
        n = self.count(m, open_)
        last = m.last_batch + len(open_)
        if [k for k, _ in open_] != list(range(m.last_batch + 1, last + 1)):
            raise CorruptData(f"{m.id}: a log entry is missing")
        folder = f"gen={m.generation + 1}-{uuid.uuid4().hex[:12]}"
        at = self.path(m.id, folder)
        shards = hnsw.shard_count(n, self.config.rows_per_shard)
        rows = self.vectors(m, open_)
        most = max(1, FILE_BYTES // (4 * m.dimension + 256))
        (rows.repartitionByRange("id").sortWithinPartitions("id") if n else rows).write.option("maxRecordsPerFile", most).parquet(f"{at}/vectors")
        if m.index_type == IndexType.HNSW.value:
            stored = self.spark.read.schema(VECTORS_SCHEMA).parquet(f"{at}/vectors")
            most = max(1, FILE_BYTES // (self.config.rows_per_shard * (4 * m.dimension + 16 * m.m_max0)))
            hnsw.build(stored, Metric(m.metric), m.hnsw, shards).write.option("maxRecordsPerFile", most).parquet(f"{at}/graph")
        streams = self._streams(m)
        for _, c in open_:
            if c["stream"] is not None:
                streams[c["stream"]] = max(streams.get(c["stream"], -1), c["batch"])
        self.fs.replace(f"{at}/streams.json", json.dumps(streams))
        included = tuple(c["data"] for _, c in open_)
        new = Manifest(**{**asdict(m), "generation": m.generation + 1, "folder": folder, "vector_count": n, "last_batch": last, "included": included, "shards": shards, "checksum": self._checksum(m.id, folder)})
        if not self._put(new):
            self.fs.delete(at)
            return self.manifest(m.id)
        try:
            self._clear(m)
        except Exception:  # committed all the same; the next compaction clears up
            log.exception("%s: not cleared up", m.id)
        return new

    def _clear(self, kept: Manifest) -> None:
        """Deletes what plans made on ``kept``, the generation before the newest,
        or later don't read."""
        there = self._generations(kept.id)
        for g in there:
            if g < kept.generation:
                if old := self.manifest(kept.id, g).folder:
                    self.fs.delete(self.path(kept.id, old))
                if g < there[-1] - KEPT_MANIFESTS:
                    self.fs.delete(self._manifest_path(kept.id, g))
        for k in self._commits(kept):
            if k <= kept.last_batch:
                self.fs.delete(self.path(kept.id, "log", json.loads(self.fs.read(self._entry(kept, k)))["data"]))
                self.fs.delete(self._entry(kept, k))

    def _checksum(self, id_: str, folder: str) -> str:
        """SHA-256 over the sorted SHA-256 of all Parquet files of a generation:
        computed by the executors, one digest per file comes back."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.path(id_, folder))
        sums = sorted(r[0] for r in files.select(F.sha2("content", 256)).collect())
        return sha256_hex("\n".join(sums).encode())

    def verify(self, m: Manifest) -> None:
        if m.generation and self._checksum(m.id, m.folder) != m.checksum:
            raise CorruptData(f"{m.id}: snapshot checksum differs")
        self._open(m)

    def export_log(self, m: Manifest) -> DataFrame:
        """The open log as records: op, vector, metadata, external_id."""
        rows = self.logged(m)
        rows = self.spark.createDataFrame([], VECTORS_SCHEMA) if rows is None else rows
        return rows.orderBy("id").select(F.lit("Insert").alias("op"), "vector", "metadata", "external_id")


def read_log_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines log records as (vector, metadata, external_id) rows in order;
    blank lines are skipped, any other line that is no record fails the read."""
    import pyarrow as pa

    from ..functions.metadata import canon_map

    def run(batches):
        for b in batches:
            v, md, ex = [], [], []
            for line in b.column(0).to_pylist():
                if not line.strip():
                    continue
                r = json.loads(line)
                if r.get("op") != "Insert":
                    raise ValueError(f"unknown log record {r.get('op')!r}")
                v.append([float(x) for x in r["vector"]])
                md.append(list(canon_map(r["metadata"]).items()))
                ex.append(r.get("external_id"))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.list_(pa.float32())), pa.array(md, pa.map_(pa.string(), pa.string())), pa.array(ex, pa.string())], ["vector", "metadata", "external_id"])

    return spark.read.text(path).mapInArrow(run, "vector array<float>, metadata map<string,string>, external_id string")
