"""Exact substring deduplication by suffix arrays with two-stage sorting.

Every byte covered by a 400-byte string (a window) that also begins anywhere else
in the corpus is removed; windows are judged on the input.

1. Anchors. In each window the 64-byte gram with the least hash (leftmost on
   ties) is its anchor, so equal windows have equal anchors. Consecutive windows
   with one anchor are a run; a run and the bytes it spans are its context. About
   one run comes to 170 bytes, each window belongs to exactly one, and only
   hashes leave this step.
2. Equal contexts (128-bit digests) are counted with map-side combining: windows
   of a context that occurs twice are repeated, however many copies there are.
   A context whose anchor occurs nowhere else has no repeated window.
3. What is left, contexts that share an anchor but differ, is cut from the texts
   once for each distinct context and dealt to shards by anchor. A shard sorts
   the suffixes of its contexts in two stages: suffixes smaller than their
   successors are sorted directly, all others induced by one scan over the
   buckets; windows whose adjacent common prefix reaches 400 bytes are repeated.
   Anchors with more than ``CROWD`` distinct contexts would overfill a shard: their
   windows are compared by 128-bit digests instead, spread over all tasks.
4. Runs of repeated windows go back to their documents, which are cut.

Only documents with a repeated anchor are fetched again. Defined cases: null is
an empty text; texts under 400 bytes lose nothing; equal rows (same doc_id and
text) count as copies of each other and get equal results; null doc_ids are
documents like others; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import discard, materialize

WINDOW = 400
GRAM = 64
#: Distinct contexts of one anchor that a shard takes at most: of 736 bytes each at
#: most, so 4.4 MB; sorting takes some 60 bytes of memory a byte.
CROWD = 6000
#: Context bytes in a shard, about.
SHARD_BYTES = 1 << 20
#: Windows of a block of text that are looked at together.
BLOCK = 1 << 20
POSITION = np.uint64((1 << 22) - 1)
#: Symbols that one comparison of suffixes looks at.
SORT_BLOCK = 32


class Rolling:
    """Hashes of all substrings of a block from one running sum."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, raw: np.ndarray, base: int):
        n = len(raw) + 1
        held = self._tables.get(base)
        if held is None or len(held[0]) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            held = self._tables[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self.down = held[1]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * held[0][: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return K.mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * K.STEP)


BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from running minima of blocks."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first and last window
    (places in ``raw``), anchor hash and the context's digests."""
    none = np.empty(0, np.int64)
    if len(raw) < WINDOW:
        return none, none, none, none, none, none
    a, b = (Rolling(raw, base) for base in BASES)
    grams = np.arange(len(raw) - GRAM + 1)
    h = a.of(grams, grams + GRAM)
    least = sliding_least((h & ~POSITION) | grams.astype(np.uint64), WINDOW - GRAM + 1)
    anchor = (least & POSITION).astype(np.int64)
    window = np.arange(len(anchor))
    text = np.searchsorted(offsets, window, "right") - 1
    inside = window + WINDOW <= offsets[text + 1]
    first = inside.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(first)
    # a run ends before the next one begins, or where its text's windows end
    end = np.minimum(np.append(start[1:], len(window)), offsets[text[start] + 1] - WINDOW + 1) - 1
    return text[start], start, end, *(x.view(np.int64) for x in (h[anchor[start]], a.of(start, end + WINDOW), b.of(start, end + WINDOW)))


def pieces(offsets: np.ndarray):
    """(first text, texts, start byte, end byte, whole) blocks; a text over a block
    long comes in pieces that overlap by less than a window."""
    for i, j in K.blocks(offsets, BLOCK):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * BLOCK:
            yield i, j, lo, hi
        else:
            for at in range(lo, max(lo + 1, hi - WINDOW + 1), BLOCK):
                yield i, j, at, min(hi, at + BLOCK + WINDOW - 1)


def _keys(doc_ids: list, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit key of a row: its doc_id and text."""
    both = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16, key=str(i).encode()).digest() for i, t in zip(doc_ids, texts, strict=True)), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


RUN_SCHEMA = "k1 long, k2 long, s0 long, s1 long, h long, d1 long, d2 long, doc_id long, n_bytes long, sha string"


def _runs(docs: DataFrame) -> DataFrame:
    """A row for each run, and one (h is null) for each document."""
    names = [f.split()[0] for f in RUN_SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                raw, offsets = K.text_bytes(s.column(1))
                blob = raw.tobytes()
                texts = [blob[offsets[k] : offsets[k + 1]] for k in range(s.num_rows)]
                ids = s.column(0).to_pylist()
                k1, k2 = _keys(ids, texts)
                n = s.num_rows
                sha = [hashlib.sha256(t).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), *[pa.nulls(n, pa.int64())] * 5, s.column(0), pa.array(np.diff(offsets)), pa.array(sha)], names)
                for i, j, lo, hi in pieces(offsets):
                    edges = np.clip(offsets[i : j + 1], lo, hi) - lo
                    text, s0, s1, h, d1, d2 = runs(raw[lo:hi], edges)
                    shift = lo - offsets[i + text]
                    m = len(text)
                    if m:
                        yield pa.RecordBatch.from_arrays([pa.array(k1[i + text]), pa.array(k2[i + text]), pa.array(s0 + shift), pa.array(s1 + shift), pa.array(h), pa.array(d1), pa.array(d2), *[pa.nulls(m, pa.int64())] * 2, pa.nulls(m, pa.string())], names)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, RUN_SCHEMA)


def suffixes_two_stage(t: np.ndarray, depth: int, rank: np.ndarray) -> np.ndarray:
    """Suffix array of ``t`` (symbols 1-255, 0 as separator and last symbol),
    exact in the first ``depth`` symbols of each suffix. rank: of its blocks."""
    n = len(t)
    # smaller than its successor: by the first symbol that differs from the next
    differs = np.append(t[:-1] != t[1:], True)
    at = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    small = np.append(t, 0)[at] < np.append(t, 0)[at + 1]
    small[-1] = True
    direct = np.flatnonzero(small)
    # compared by the ranks of blocks, which are in the order of the blocks' symbols
    block = SORT_BLOCK
    order = np.argsort(rank[direct], kind="stable")
    direct = direct[order]
    key = rank[direct]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    for d in range(block, depth, block):
        open_ = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(open_):
            break
        key = group[open_].astype(np.uint64) << np.uint64(32) | rank[direct[open_] + d]
        sub = np.argsort(key)
        direct[open_] = direct[open_][sub]
        key = key[sub]
        new = np.zeros(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        new[open_[1:]] |= key[1:] != key[:-1]
        group = np.cumsum(new)
    # induce the others, bucket by bucket
    count = np.bincount(t, minlength=256)
    start = np.concatenate([[0], np.cumsum(count)])
    others = np.bincount(t[~small], minlength=256)
    sa = np.empty(n, np.int64)
    own = t[direct]
    place = np.searchsorted(own, np.arange(257))
    for c in np.flatnonzero(count):
        sa[start[c] + others[c] : start[c + 1]] = direct[place[c] : place[c + 1]]
    head = start[:-1].copy()
    for c in np.flatnonzero(count).tolist():
        lo = start[c]
        while lo < head[c]:
            prev = sa[lo : head[c]] - 1
            prev = prev[prev >= 0]
            prev = prev[t[prev] == c]
            lo = head[c]
            sa[lo : lo + len(prev)] = prev
            head[c] += len(prev)
        prev = sa[start[c] : start[c + 1]] - 1
        prev = prev[prev >= 0]
        symbol = t[prev]
        prev, symbol = prev[symbol > c], symbol[symbol > c]
        by = np.argsort(symbol, kind="stable")
        prev, symbol = prev[by], symbol[by]
        cut = np.searchsorted(symbol, np.arange(257))
        for x in np.flatnonzero(np.diff(cut)).tolist():
            k = cut[x + 1] - cut[x]
            sa[head[x] : head[x] + k] = prev[cut[x] : cut[x + 1]]
            head[x] += k
    return sa


def padding(t: np.ndarray, depth: int) -> np.ndarray:
    return np.concatenate([t, np.zeros(depth + 2 * SORT_BLOCK, np.uint8)])


def block_ranks(padded: np.ndarray) -> np.ndarray:
    """Dense rank of the block of symbols at each place that has a whole one."""
    _, rank = np.unique(eight(padded), return_inverse=True)
    width = 8
    while width < SORT_BLOCK:
        r = rank.astype(np.uint64)
        del rank
        _, rank = np.unique(r[:-width] << np.uint64(32) | r[width:], return_inverse=True)
        width *= 2
    return rank.astype(np.uint32)


def eight(padded: np.ndarray) -> np.ndarray:
    """The eight symbols from each place on, as a big-endian number."""
    n = len(padded) - 8
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | padded[j : j + n]
    return out


def common_prefixes(words: np.ndarray, rank: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes a[i] and b[i], up to ``most``: by
    ranks of whole blocks, and by symbols in the first block that differs."""
    out = np.full(len(a), most)
    live = np.arange(len(a))
    for d in range(0, most, SORT_BLOCK):
        same = rank[a[live] + d] == rank[b[live] + d]
        off = live[~same]
        out[off] = np.minimum(d + _in_block(words, a[off] + d, b[off] + d, SORT_BLOCK), most)
        live = live[same]
        if not len(live):
            break
    return out


def _in_block(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    out = np.full(len(a), most)
    live = np.arange(len(a))
    for d in range(0, most, 8):
        x = words[a[live] + d] ^ words[b[live] + d]
        off = np.flatnonzero(x)
        if len(off):
            lead = np.zeros(len(off), np.int64)
            for j in range(1, 8):
                lead += (x[off] >> np.uint64(64 - 8 * j)) == 0
            out[live[off]] = np.minimum(d + lead, most)
            live = live[x == 0]
        if not len(live):
            break
    return out


def repeated_windows(contexts: list[bytes]) -> list[np.ndarray]:
    """Which windows of each context begin anywhere else among the contexts'
    windows (a context of n bytes has the n - 399 windows that fit)."""
    size = np.array([len(c) for c in contexts])
    # no byte of UTF-8 text is 255, so bytes plus one leave 0 for the separator
    t = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8) + np.uint8(1)
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    mine = np.zeros(len(t), bool)
    for b, n in zip(begin.tolist(), size.tolist(), strict=True):
        mine[b : b + n - WINDOW + 1] = True
    padded = padding(t, WINDOW)
    rank = block_ranks(padded)
    sa = suffixes_two_stage(t, WINDOW, rank)
    sa = sa[mine[sa]]
    same = common_prefixes(eight(padded), rank, sa[:-1], sa[1:], WINDOW) == WINDOW
    hit = np.zeros(len(t), bool)
    hit[sa[:-1][same]] = hit[sa[1:][same]] = True
    return [hit[b : b + n - WINDOW + 1] for b, n in zip(begin.tolist(), size.tolist(), strict=True)]


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _contexts(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the contexts in ``wanted``, cut from the texts."""
    ranges = wanted.groupBy("k1", "k2").agg(F.collect_set(F.struct("s0", "s1", "h", "lone", "crowded")).alias("r"))
    out = "k1 long, k2 long, s0 long, h long, lone boolean, crowded boolean, bytes binary"

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                s = b.slice(at, 64)
                rows = []
                for k1, k2, text, rs in zip(*(s.column(c).to_pylist() for c in range(4)), strict=True):
                    raw = text.encode()
                    rows += [(k1, k2, r["s0"], r["h"], r["lone"], r["crowded"], raw[r["s0"] : r["s1"] + WINDOW]) for r in rs]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in out.split(", ")])

    one = held.dropDuplicates(["k1", "k2"]).select("k1", "k2", "text")
    return one.join(ranges, ["k1", "k2"]).mapInArrow(cut, out)


def _sorted_shards(contexts: DataFrame, shards: int) -> DataFrame:
    """(k1, k2, p0, p1) runs of repeated windows among contexts that occur once."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (k1, k2, s0, lone), hit in zip(pdf[["k1", "k2", "s0", "lone"]].itertuples(index=False), repeated_windows(pdf["bytes"].tolist()), strict=True):
            if lone:
                out += [(k1, k2, s0 + lo, s0 + hi) for lo, hi in zip(*_spans(hit), strict=True)]
        return pd.DataFrame(out, columns=["k1", "k2", "p0", "p1"]).astype("int64")

    c = contexts.filter("NOT crowded").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    return c.groupBy("shard").applyInPandas(one, "k1 long, k2 long, p0 long, p1 long")


def _crowded(contexts: DataFrame) -> DataFrame:
    """The same for crowded anchors, by the digests of their windows."""

    def digests(batches):
        for b in batches:
            for k1, k2, s0, _, lone, _, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = np.frombuffer(data, np.uint8)
                at = np.arange(len(raw) - WINDOW + 1)
                w1, w2 = (Rolling(raw, base).of(at, at + WINDOW).view(np.int64) for base in BASES)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), pa.array(s0 + at), pa.array(np.full(n, lone)), pa.array(w1), pa.array(w2)], ["k1", "k2", "p", "lone", "w1", "w2"])

    w = contexts.filter("crowded").mapInArrow(digests, "k1 long, k2 long, p long, lone boolean, w1 long, w2 long")
    often = w.groupBy("w1", "w2").agg(F.count("*").alias("c")).filter("c > 1").select("w1", "w2")
    return w.filter("lone").join(often, ["w1", "w2"]).select("k1", "k2", F.col("p").alias("p0"), F.col("p").alias("p1"))


def _cut(held: DataFrame, marks: DataFrame) -> DataFrame:
    """The results of documents with marked windows."""
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    found = marks.groupBy("k1", "k2").agg(F.collect_set(F.struct("p0", "p1")).alias("r"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                s = b.slice(at, 64)
                rows = []
                for doc_id, text, rs in zip(*(s.column(c).to_pylist() for c in range(3)), strict=True):
                    raw = np.frombuffer((text or "").encode(), np.uint8)
                    depth = np.zeros(len(raw) + 1, np.int32)
                    for r in rs or ():
                        depth[r["p0"]] += 1
                        depth[r["p1"] + WINDOW] -= 1
                    gone = np.cumsum(depth[:-1]) > 0
                    rows.append((doc_id, len(raw), int(gone.sum()), len(_spans(gone)[0]), hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
                kinds = (*[pa.int64()] * 4, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in out.split(", ")])

    return held.join(found, ["k1", "k2"], "left").select("doc_id", "text", "r").mapInArrow(run, out)


def _keyed(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                k1, k2 = _keys(s.column(0).to_pylist(), [(t or "").encode() for t in s.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), s.column(0), s.column(1)], ["k1", "k2", "doc_id", "text"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "k1 long, k2 long, doc_id long, text string")


def dedup_substrings(docs: DataFrame, crowd: int = CROWD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    all_ = materialize(_runs(docs), "sd-runs")
    found = all_.filter("h IS NOT NULL").select("k1", "k2", "s0", "s1", "h", "d1", "d2")
    one = ["h", "d1", "d2"]
    classes = materialize(found.groupBy(*one).agg(F.count("*").alias("m"), F.min(F.struct("k1", "k2", "s0", "s1")).alias("rep")), "sd-classes")
    shared = classes.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    # contexts that occur once but share their anchor, and those they are held against
    mixed = classes.join(shared, "h").select("rep.*", "h", (F.col("m") == 1).alias("lone"), (F.col("c") > crowd).alias("crowded"))
    mixed = materialize(mixed, "sd-mixed")
    copies = found.join(classes.filter("m > 1").select(*one), one).select("k1", "k2", F.col("s0").alias("p0"), F.col("s1").alias("p1"))
    copies = materialize(copies, "sd-copies")
    discard(classes)
    wanted = copies.select("k1", "k2").unionByName(mixed.select("k1", "k2")).distinct()
    held = materialize(_keyed(docs).join(wanted, ["k1", "k2"], "left_semi"), "sd-texts")
    contexts = materialize(_contexts(held, mixed), "sd-contexts")
    size = contexts.filter("NOT crowded").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    marks = copies.unionByName(_sorted_shards(contexts, max(1, -(-int(size) // shard_bytes)))).unionByName(_crowded(contexts))
    rest = all_.filter("h IS NULL").join(wanted, ["k1", "k2"], "left_anti")
    rest = rest.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return _cut(held, materialize(marks, "sd-marks")).unionByName(rest)
