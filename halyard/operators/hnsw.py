"""Approximate nearest neighbours by a layered proximity graph, in shards.

Rows are dealt to shards by id once, when the graph is built; a shard is then one
row that holds its ids, vectors and links as packed arrays. A search reads those
rows where they lie, walks each graph, and merges the shards' k best: it shuffles
nothing but results. The number of shards follows the number of rows, so a task's
memory does not grow with the data. A node's top layer comes from a hash of its
id: builds are reproducible.

Building inserts the rows in id order. A node's candidates, the ``ef_construction``
nearest of the nodes before it on a layer, are found exactly, by matrix products of
blocks of rows; links back to it are trimmed to the layer's degree once they are
twice as many, and in the end.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import HnswParams, Metric
from .flat import best_first

#: A shard: ids (64-bit), vectors (32-bit floats), top layer of each node (16-bit),
#: and for every node and layer, ground first, its degree, neighbours (row numbers,
#: 32-bit) and their distances, nearest first.
SHARD_SCHEMA = "shard int, rows int, ids binary, vectors binary, level binary, degree binary, nbr binary, dist binary"
#: The same links a row for each node and layer, neighbours by id.
GRAPH_SCHEMA = "shard int, node_id long, layer int, nbr array<long>, dist array<float>"
#: Rows whose distances to all earlier rows are taken at once.
BLOCK = 256
#: Queries that walk a graph side by side, at most, and bytes of what they hold.
WALKERS, WALK_BYTES = 256, 64 << 20
#: Sorts after all nodes.
NO_NODE = np.iinfo(np.int64).max


def distances(metric: Metric, x: np.ndarray, y: np.ndarray, x_norm: np.ndarray, y_norm: np.ndarray) -> np.ndarray:
    """rows of x times rows of y, smaller is nearer."""
    if metric is Metric.EUCLIDEAN:
        # about the mean, which products of large components would drown
        mean = y.mean(axis=0) if len(y) else np.float32(0)
        x, y = x - mean, y - mean
        square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
        return np.sqrt(np.maximum(square, 0))
    dot = x @ y.T
    if metric is Metric.DOT_PRODUCT:
        return -dot
    norm = x_norm[:, None] * y_norm[None, :]
    return 1 - np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)


class Graph:
    """A shard's vectors (row numbers are node numbers) and layers of links."""

    def __init__(self, vectors: np.ndarray, metric: Metric, params: HnswParams):
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.metric, self.p = metric, params
        self.level = np.empty(0, np.int16)
        self.first = np.zeros(1, np.int64)  # lists before each node
        self.start = np.zeros(1, np.int64)  # links before each list
        self.nbr, self.dist = np.empty(0, np.int32), np.empty(0, np.float32)
        self.stamp = np.zeros(len(self.x), np.uint32)
        self.now = 0

    # building

    def build(self, levels: Sequence[int]) -> Graph:
        level = np.asarray(levels, np.int16)
        per_layer = []
        for layer in range(int(level.max(initial=-1)) + 1):
            nodes = np.flatnonzero(level >= layer)
            per_layer.append(dict(zip(nodes.tolist(), self._layer(nodes, self.p.m_max0 if layer == 0 else self.p.m), strict=True)))
        lists = [per_layer[layer][n] for n, top in enumerate(level.tolist()) for layer in range(top + 1)]
        return self._set(level, np.array([len(n) for n, _ in lists], np.int32), np.concatenate([n for n, _ in lists] or [self.nbr]), np.concatenate([d for _, d in lists] or [self.dist]))

    def _set(self, level: np.ndarray, degree: np.ndarray, nbr: np.ndarray, dist: np.ndarray) -> Graph:
        self.level, self.nbr, self.dist = level, nbr.astype(np.int32), dist.astype(np.float32)
        self.first = np.concatenate([[0], np.cumsum(level.astype(np.int64) + 1)])
        self.start = np.concatenate([[0], np.cumsum(degree, dtype=np.int64)])
        return self

    def _layer(self, nodes: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Neighbours and distances of the layer's nodes, nearest first."""
        x, norm = self.x[nodes], self.norm[nodes]
        near: list[list[int]] = [[] for _ in nodes]
        far: list[list[float]] = [[] for _ in nodes]
        want = self.p.ef_construction
        for lo in range(0, len(nodes), BLOCK):
            hi = min(lo + BLOCK, len(nodes))
            d = distances(self.metric, x[lo:hi], x[:hi], norm[lo:hi], norm[:hi])
            for i in range(lo, hi):
                row = d[i - lo, :i]
                best = np.argpartition(row, want)[:want] if i > want else np.arange(i)
                best = best[np.lexsort((best, row[best]))]
                kept = self._select(x, norm, best, row[best], most)
                near[i], far[i] = best[kept].tolist(), row[best[kept]].tolist()
                for n, dn in zip(near[i], far[i], strict=True):
                    near[n].append(i)
                    far[n].append(dn)
                    if len(near[n]) >= 2 * most:
                        self._trim(x, norm, near, far, n, most)
        out = []
        for i in range(len(nodes)):
            if len(near[i]) > most:
                self._trim(x, norm, near, far, i, most)
            n, dn = np.array(near[i], np.int64), np.array(far[i], np.float32)
            order = np.lexsort((n, dn))
            out.append((nodes[n[order]], dn[order]))
        return out

    def _trim(self, x, norm, near: list, far: list, i: int, most: int) -> None:
        n, d = np.array(near[i]), np.array(far[i], np.float32)
        order = np.lexsort((n, d))
        n, d = n[order], d[order]
        kept = self._select(x, norm, n, d, most)
        near[i], far[i] = n[kept].tolist(), d[kept].tolist()

    def _select(self, x: np.ndarray, norm: np.ndarray, near: np.ndarray, d: np.ndarray, most: int) -> list[int]:
        """Which of the candidates, nearest first, to link: up to ``most``, passing
        over one that lies nearer to a chosen one than to the node."""
        if len(near) <= most:
            return list(range(len(near)))
        between = distances(self.metric, x[near], x[near], norm[near], norm[near])
        open_, out = np.ones(len(near), bool), []
        i = 0
        while True:
            out.append(i)
            if len(out) == most:
                return out
            open_ &= between[i] >= d
            open_[: i + 1] = False
            i = int(open_.argmax())
            if not open_[i]:
                return out

    # searching

    @property
    def top(self) -> int:
        return int(self.level.max(initial=-1))

    @property
    def entry(self) -> int:
        """The earliest node of the highest layer."""
        return int(self.level.argmax()) if len(self.level) else -1

    def neighbours(self, node: int, layer: int) -> np.ndarray:
        at = self.first[node] + layer
        return self.nbr[self.start[at] : self.start[at + 1]]

    def _to(self, q: np.ndarray, qn: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Distances of nodes from a query, or each from its row of ``q``. Equal vectors
        are equally far, to the bit, which a matrix product doesn't see to."""
        rows = self.x[nodes]
        if self.metric is Metric.EUCLIDEAN:
            d = rows - q
            return np.sqrt((d * d).sum(axis=1))
        dot = np.einsum("ij,ij->i", rows, np.broadcast_to(q, rows.shape))
        if self.metric is Metric.DOT_PRODUCT:
            return -dot
        norm = qn * self.norm[nodes]
        return 1 - np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)

    def explore(self, q: np.ndarray, qn: np.ndarray, start: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef nearest nodes found from ``start``, nearest first."""
        self.now += 1
        self.stamp[[n for _, n in start]] = self.now
        open_, kept = list(start), [(-d, -n) for d, n in start]
        heapq.heapify(open_)
        heapq.heapify(kept)
        while len(kept) > ef:
            heapq.heappop(kept)
        while open_:
            d, node = heapq.heappop(open_)
            if len(kept) >= ef and d > -kept[0][0]:
                break
            near = self.neighbours(node, layer)
            fresh = near[self.stamp[near] != self.now]
            if not len(fresh):
                continue
            self.stamp[fresh] = self.now
            for dn, n in zip(self._to(q, qn, fresh).tolist(), fresh.tolist(), strict=True):
                if len(kept) < ef or dn < -kept[0][0]:
                    heapq.heappush(open_, (dn, n))
                    heapq.heappush(kept, (-dn, -n))
                    if len(kept) > ef:
                        heapq.heappop(kept)
        return sorted((-d, -n) for d, n in kept)

    def search(self, query: Sequence[float], k: int, ef: int) -> list[tuple[float, int]]:
        if k == 0 or self.entry < 0:
            return []
        q = np.asarray(query, np.float32)
        qn = np.sqrt((q * q).sum())[None]
        start = [(float(self._to(q, qn, np.array([self.entry]))[0]), self.entry)]
        for layer in range(self.top, 0, -1):
            start = self.explore(q, qn, start, 1, layer)
        return self.explore(q, qn, start, max(ef, k), 0)[:k]

    # searching for many queries at once

    def _table(self, layer: int) -> np.ndarray:
        """The layer's neighbours, a row for each node, -1 where there are fewer."""
        nodes = np.flatnonzero(self.level >= layer)
        start = self.start[self.first[nodes] + layer]
        degree = self.start[self.first[nodes] + layer + 1] - start
        place = np.arange(max(1, int(degree.max(initial=0))))
        rows = np.full((len(nodes), len(place)), -1, np.int32)
        there = place < degree[:, None]
        rows[there] = self.nbr[(start[:, None] + place)[there]]
        out = np.full((len(self.x), len(place)), -1, np.int32)
        out[nodes] = rows
        return out

    def _keys(self, q: np.ndarray, qn: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Keys of the pairs of rows of ``q`` and nodes: they sort by distance, then
        node; the lowest bit is free."""
        bits = (self._to(q, qn, nodes) + np.float32(0)).view(np.int32)
        return (bits ^ (bits >> 31 & 0x7FFFFFFF)).astype(np.int64) << 32 | nodes.astype(np.int64) << 1

    def _explore_many(self, q: np.ndarray, qn: np.ndarray, start: np.ndarray, ef: int, table: np.ndarray, tied: np.ndarray) -> np.ndarray:
        """:meth:`explore` of each query from one node: the keys of the ef nearest
        nodes found, nearest first. Each step expands the nearest open node of every
        query. ``tied`` becomes true where equal distances met at the ef-th place,
        where the result depends on the order of insertion."""
        keys = np.full((len(q), ef), NO_NODE)
        keys[:, 0] = self._keys(q, qn, start)
        seen = np.zeros((len(q), len(self.x)), bool)
        live = np.arange(len(q))
        seen[live, start] = True
        while True:
            open_ = keys[live] & 1 == 0  # not expanded yet
            at = open_.argmax(axis=1)
            going = open_[np.arange(len(live)), at]
            live, at = live[going], at[going]
            if not len(live):
                return keys
            near = table[(keys[live, at] & 0xFFFFFFFF) >> 1]
            keys[live, at] |= 1
            row, col = np.nonzero((near >= 0) & ~seen[live[:, None], near])
            who, node = live[row], near[row, col]
            seen[who, node] = True
            new = np.full(near.shape, NO_NODE)
            new[row, col] = self._keys(q[who], qn[who], node)
            both = np.sort(np.concatenate([keys[live], new], axis=1), axis=1)
            tied[live] |= (both[:, ef - 1] >> 32 == both[:, ef] >> 32) & (both[:, ef] != NO_NODE)
            keys[live] = both[:, :ef]

    def search_many(self, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, distance, node): :meth:`search` of every row of ``queries``."""
        out = [(np.empty(0, np.int32), np.empty(0, np.float32), np.empty(0, np.int64))]
        ef = max(1, min(max(ef, k), len(self.x)))
        step = max(1, min(WALKERS, WALK_BYTES // (len(self.x) + 48 * ef)))
        tables = [self._table(layer) for layer in range(self.top + 1)]
        for lo in range(0, len(queries) if k and tables else 0, step):
            q = np.ascontiguousarray(queries[lo : lo + step], np.float32)
            qn = np.sqrt((q * q).sum(axis=1))
            tied, start = np.zeros(len(q), bool), np.full(len(q), self.entry)
            for layer in range(self.top, 0, -1):
                start = (self._explore_many(q, qn, start, 1, tables[layer], tied)[:, 0] & 0xFFFFFFFF) >> 1
            keys = self._explore_many(q, qn, start, ef, tables[0], tied)[:, :k]
            row, col = np.nonzero((keys != NO_NODE) & ~tied[:, None])
            node = (keys[row, col] & 0xFFFFFFFF) >> 1
            bits = (keys[row, col] >> 32).astype(np.int32)
            out.append((lo + row, (bits ^ (bits >> 31 & 0x7FFFFFFF)).view(np.float32), node))
            for i in np.flatnonzero(tied):
                found = self.search(q[i], k, ef)
                out.append((np.full(len(found), lo + i), np.array([d for d, _ in found], np.float32), np.array([n for _, n in found], np.int64)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    # packing

    def pack(self, ids: np.ndarray) -> tuple[bytes, ...]:
        degree = np.diff(self.start).astype("<i4")
        return tuple(a.tobytes() for a in (ids.astype("<i8"), self.x.astype("<f4"), self.level.astype("<i2"), degree, self.nbr.astype("<i4"), self.dist.astype("<f4")))


def unpack(row: dict, metric: Metric, params: HnswParams) -> tuple[np.ndarray, Graph]:
    """(ids, graph) of a row of SHARD_SCHEMA."""
    read = {n: np.frombuffer(row[n], t) for n, t in (("ids", "<i8"), ("vectors", "<f4"), ("level", "<i2"), ("degree", "<i4"), ("nbr", "<i4"), ("dist", "<f4"))}
    g = Graph(read["vectors"].reshape(row["rows"], -1), metric, params)
    return read["ids"], g._set(read["level"], read["degree"], read["nbr"], read["dist"])


def score_of(metric: Metric, d: np.ndarray) -> np.ndarray:
    d = np.asarray(d, np.float32)
    return 1 - d if metric is Metric.COSINE else -d if metric is Metric.DOT_PRODUCT else 1 / (1 + d)


def random_level(id_: Column, level_mult: float, seed: int = 0) -> Column:
    """Layers above the ground, geometric, fixed by the id."""
    u = (F.pmod(F.xxhash64(F.lit(seed), id_), F.lit(1 << 53)) + 1) / F.lit(float(1 << 53))
    return F.floor(-F.log(u) * level_mult).cast("int")


def shard_of(id_: Column, shards: int) -> Column:
    return F.pmod(id_, F.lit(shards)).cast("int")


def shard_count(rows: int, rows_per_shard: int) -> int:
    return max(1, -(-rows // rows_per_shard))


def build(vectors: DataFrame, metric: Metric, params: HnswParams = HnswParams(), shards: int = 1, seed: int = 0) -> DataFrame:
    """The shards of (id, vector) as rows of SHARD_SCHEMA, a task for each: dealt by
    hash, several could meet in one."""

    def run(batches):
        for shard, rows in _by_shard(batches):
            ids, level = rows["id"].to_numpy(), rows["level"].to_numpy()
            g = Graph(rows["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1), metric, params).build(level)
            row = [np.int32(shard), np.int32(len(ids)), *g.pack(ids)]
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in row], [c.split()[0] for c in SHARD_SCHEMA.split(", ")])

    v = vectors.select("id", "vector", shard_of(F.col("id"), shards).alias("shard"), random_level(F.col("id"), params.level_mult, seed).alias("level"))
    return v.repartitionById(shards, "shard").sortWithinPartitions("shard", "id").mapInArrow(run, SHARD_SCHEMA)


def _by_shard(batches):
    """(shard, its rows) of batches that are sorted by shard."""
    now, parts = None, []
    for b in batches:
        shard = b.column(b.schema.get_field_index("shard")).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for lo, hi in pairwise(cuts):
            if lo == hi:
                continue
            if parts and shard[lo] != now:
                yield now, pa.Table.from_batches(parts)
                parts = []
            now = int(shard[lo])
            parts.append(b.slice(lo, hi - lo))
    if parts:
        yield now, pa.Table.from_batches(parts)


def export_links(shards: DataFrame) -> DataFrame:
    """The graph as rows of GRAPH_SCHEMA."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ids, g = unpack(row, Metric.DOT_PRODUCT, HnswParams())
                node = np.repeat(np.arange(len(ids)), np.diff(g.first))
                layer = np.arange(len(node)) - g.first[node]
                offsets = pa.array(g.start, pa.int32())
                columns = [pa.array(np.full(len(node), row["shard"], np.int32)), pa.array(ids[node]), pa.array(layer.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(ids[g.nbr])), pa.ListArray.from_arrays(offsets, pa.array(g.dist))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in GRAPH_SCHEMA.split(", ")])

    return shards.mapInArrow(run, GRAPH_SCHEMA)


def import_links(vectors: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    """Rows of SHARD_SCHEMA from vectors and exported links."""

    def one(v: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]
        if not len(v):
            return pd.DataFrame([], columns=columns)
        v, rows = v.sort_values("id", ignore_index=True), rows.sort_values(["node_id", "layer"], ignore_index=True)
        ids = v["id"].to_numpy()
        level = rows.groupby("node_id")["layer"].max().reindex(ids).to_numpy(np.int16)
        g = Graph(np.stack(v["vector"].to_numpy()), Metric.DOT_PRODUCT, HnswParams())
        near, dist = (np.concatenate([np.asarray(a) for a in rows[c]]) for c in ("nbr", "dist"))
        g._set(level, rows["nbr"].map(len).to_numpy(np.int32), np.searchsorted(ids, near), dist)
        return pd.DataFrame([(int(v["shard"][0]), len(v), *g.pack(ids))], columns=columns)

    v = vectors.select("id", "vector", shard_of(F.col("id"), shards).alias("shard"))
    return v.groupBy("shard").cogroup(links.groupBy("shard")).applyInPandas(one, SHARD_SCHEMA)


def entries(links: DataFrame) -> DataFrame:
    """shard, entry_point, max_layer: the earliest node of the highest layer."""
    return links.groupBy("shard").agg(F.min(F.struct((-F.col("layer")).alias("up"), "node_id")).alias("e")).select("shard", F.col("e.node_id").alias("entry_point"), (-F.col("e.up")).alias("max_layer"))


def search(shards: DataFrame, queries: Sequence[Sequence[float]], k: int, metric: Metric, params: HnswParams = HnswParams(), ef_search: int | None = None) -> DataFrame:
    """qid, id, score: for each query the k best of all shards."""
    ef = ef_search or params.ef
    qs = np.asarray(queries, np.float32).reshape(len(queries), -1)

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                ids, g = unpack(b.slice(at, 1).to_pylist()[0], metric, params)
                if len(qs) == 1:
                    found = g.search(qs[0], k, ef)
                    qid, d, n = np.zeros(len(found)), np.array([d for d, _ in found]), np.array([n for _, n in found], np.int64)
                else:
                    qid, d, n = g.search_many(qs, k, ef)
                yield pa.RecordBatch.from_arrays([pa.array(qid.astype(np.int32)), pa.array(ids[n]), pa.array(score_of(metric, d).astype(np.float32))], ["qid", "id", "score"])

    found = shards.mapInArrow(run, "qid int, id long, score float")
    if len(queries) == 1:
        return found.orderBy(*best_first()).limit(k)
    place = F.row_number().over(W.partitionBy("qid").orderBy(*best_first()))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).drop("rank")
