"""Benchmark decontamination by training suffix arrays.

Each block of training texts (a shard: some megabytes, never part of a text) is
turned into an array of word hashes, and its suffixes are sorted by words, 16
deep. Every test suffix, that is every place in a benchmark item where a window
of 13 words begins, is binary-searched in each shard for the range of suffixes
that begin with the window; hits one after another in a text whose windows are
one after another in an item make up a verbatim match, with its places. All
places of a window count, so repeated passages don't break a match. A document
is affected if at least one word in ``share`` lies in a match, or if any does
(share None). No rows are shuffled: a shard is searched where it is read.

The benchmark is read in parts of about ``PART_BYTES`` of text, one at a time: a
part is broadcast, the documents are searched for it, and it is dropped before
the next one, so neither driver nor executors hold more than a part. With more
than one, the documents are written between parts with the words hit so far.

Words are compared by 64-bit hashes of their bytes, A-Z lower-cased.

Defined cases: null and empty texts have no words and are never affected; an
item without words matches nothing; a null item_id reads as "null"; repeated
items and rows each count (equal item_ids once); an empty benchmark or table
gives clean or no rows; other columns are ignored, or kept by
:func:`drop_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import discard, fresh_name, lean, materialize

WINDOW = 13
PART_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
#: Pairs of a place in the shard and one in the benchmark looked at together,
#: about; a text is never divided.
PAIRS = 1 << 21
#: 20 * n_hit >= n_words
HIT_SHARE = 20


@dataclass
class TestSuffixes:
    """Distinct windows of a part of the benchmark, and all places where each
    begins."""

    h: np.ndarray  # word hashes of the part, WINDOW zeros behind
    at: np.ndarray  # a place where window i begins, in words of the part
    depth: np.ndarray  # words in window i
    place_at: np.ndarray  # window i begins at places[place_at[i]:place_at[i+1]]
    places: np.ndarray
    item: np.ndarray  # number of the item that the place is in
    begin: np.ndarray  # first word of each item
    names: list[str]


def test_suffixes(names: list[str], texts: pa.Array, window: int = WINDOW) -> TestSuffixes:
    raw, offsets = K.text_bytes(texts)
    low = K.LOWER[raw]
    start, end, first = K.words(low, offsets, K.ALNUM)
    h = np.maximum(K.word_hashes(low, start, end), np.uint64(1))
    hashes, before = K.shingles(h, first, window)
    item = np.repeat(np.arange(len(names)), np.diff(before))
    at = first[:-1][item] + np.arange(len(hashes)) - before[:-1][item]
    _, pick, which = np.unique(hashes, return_index=True, return_inverse=True)
    order = np.argsort(which, kind="stable")
    depth = np.minimum(np.diff(first), window)[item]
    place_at = np.searchsorted(which[order], np.arange(len(pick) + 1))
    return TestSuffixes(np.concatenate([h, np.zeros(window, np.uint64)]), at[pick], depth[pick], place_at, at[order], item[order], first[:-1], names)


def suffix_array(h: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a word-hash array in the order of their first ``depth`` words
    at least, by doubling; the array is taken as padded with zeros."""
    _, rank = np.unique(h, return_inverse=True)
    rank = rank.astype(np.uint64) + np.uint64(1)
    order, step, n = None, 1, len(h)
    while order is None or step < depth:
        key = rank << np.uint64(32)
        if step < n:
            key[: n - step] |= rank[step:]
        order = np.argsort(key)
        s = key[order]
        fresh = np.ones(n, np.uint64)
        fresh[1:] = s[1:] != s[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh)
        step *= 2
        if int(fresh.sum()) == n:
            break
    return order


def ranges(h: np.ndarray, order: np.ndarray, q: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each window the range of ``order`` whose suffixes begin with it."""
    deepest = int(q.depth.max(initial=0))
    padded = np.concatenate([h, np.zeros(deepest, np.uint64)])

    def bound(upper: bool, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            at = order[mid]
            go = np.full(len(live), upper)  # equal so far
            left = np.arange(len(live))
            for d in range(deepest):
                left = left[q.depth[live[left]] > d]
                if not len(left):
                    break
                a, b = padded[at[left] + d], q.h[q.at[live[left]] + d]
                go[left[a < b]] = True
                go[left[a > b]] = False
                left = left[a == b]
            lo[live] = np.where(go, mid + 1, lo[live])
            hi[live] = np.where(go, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo

    n = np.full(len(q.depth), len(h))
    low = bound(False, np.zeros(len(q.depth), np.int64), n)
    return low, bound(True, low, n)


@dataclass
class Found:
    """What a shard holds of a part of the benchmark. Matches are maximal runs of
    words that stand alike in a text and an item, of a window at least; places
    count words of the text or item from 0."""

    first: np.ndarray  # words before each text
    hit: np.ndarray  # of each word
    text: np.ndarray  # of each match, ascending
    item: np.ndarray
    text_at: np.ndarray
    item_at: np.ndarray
    length: np.ndarray


def search_shard(raw: np.ndarray, offsets: np.ndarray, q: TestSuffixes) -> Found:
    low = K.LOWER[raw]
    start, end, first = K.words(low, offsets, K.ALNUM)
    texts, count = len(offsets) - 1, np.diff(first)
    none = np.empty(0, np.int64)
    nothing = Found(first, np.zeros(len(start), bool), none, none, none, none, none)
    if not len(start) or not len(q.depth):
        return nothing
    # one zero after each text: no window holds a zero, so none spans texts
    gap = np.repeat(np.arange(texts), count)
    place = np.arange(len(start)) + gap
    h = np.zeros(len(start) + texts, np.uint64)
    h[place] = np.maximum(K.word_hashes(low, start, end), np.uint64(1))
    order = suffix_array(h, int(q.depth.max()))
    lo, hi = ranges(h, order, q)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return nothing
    at, of = _expand(order, lo[found], hi[found])
    which = found[of]
    by = np.argsort(at, kind="stable")
    at, which = at[by], which[by]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + q.depth[which], -1)
    hit = (np.cumsum(cover[:-1]) > 0)[place]
    begin = first[:-1] + np.arange(texts)
    text = np.searchsorted(begin, at, "right") - 1
    parts = [_matches(at[i:j], which[i:j], text[i:j], begin, q) for i, j in _chunks(q.place_at[which + 1] - q.place_at[which], text)]
    return Found(first, hit, *(np.concatenate(c) for c in zip(*parts, strict=True)))


def _expand(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[lo[i]:hi[i]] of all i one after another, and the i of each."""
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return values[lo[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]], of


def _chunks(pairs: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of hits with about PAIRS pairs, divided between texts."""
    total, i = np.cumsum(pairs), 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, "right")))
        j = int(np.searchsorted(text, text[j - 1], "right"))
        yield i, j
        i = j


def _matches(at: np.ndarray, which: np.ndarray, text: np.ndarray, begin: np.ndarray, q: TestSuffixes) -> tuple[np.ndarray, ...]:
    """The matches that the hits make up: hits one after another in a text whose
    windows are one after another in an item. Every place of a window counts."""
    k, of = _expand(np.arange(len(q.places)), q.place_at[which], q.place_at[which + 1])
    at, text, item, depth, there = at[of], text[of], q.item[k], q.depth[which[of]], q.places[k]
    order = np.lexsort((at, at - there, item))
    at, text, item, depth, there = (x[order] for x in (at, text, item, depth, there))
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (at[1:] - there[1:] != at[:-1] - there[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1
    out = text[head], item[head], at[head] - begin[text[head]], there[head] - q.begin[item[head]], at[last] - at[head] + depth[last]
    by = np.lexsort((out[3], out[2], out[1], out[0]))
    return tuple(x[by] for x in out)


def _parts(benchmark: DataFrame, part_bytes: int) -> Iterator[tuple[TestSuffixes, bool]]:
    """The parts, one at a time, and whether it is the last one."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = b.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = max(1, -(-int(total) // part_bytes))
    for k in range(n):
        t = b.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toArrow()
        yield test_suffixes(t.column(0).to_pylist(), t.column(1)), k == n - 1


#: What the parts so far found in a row: hit words (bits), items, the longest
#: match and the word it begins at, words, hit words.
STATE = {"hit": "binary", "items": "array<string>", "longest": "long", "longest_at": "long", "n_words": "long", "n_hit": "long"}


def _search(df: DataFrame, text_at: int, q, blank: bool) -> DataFrame:
    """Adds what a part of the benchmark hits to the state, the last columns.
    blank: no later step reads the texts, so they are not passed on."""

    def run(batches):
        part = q.value
        for b in batches:
            raw, offsets = K.text_bytes(b.column(text_at))
            own = b.num_columns - len(STATE)
            for i, j in K.blocks(offsets, SHARD_BYTES):
                f = search_shard(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], part)
                old_hit, old_items, old_longest, old_at = (b.column(own + c).slice(i, j - i).to_pylist() for c in range(4))
                cut = np.searchsorted(f.text, np.arange(j - i + 1))
                bits, items, longest, longest_at = [], [], [], []
                for k in range(j - i):
                    h = f.hit[f.first[k] : f.first[k + 1]]
                    if old_hit[k] is not None:
                        h = h | np.unpackbits(np.frombuffer(old_hit[k], np.uint8))[: len(h)].astype(bool)
                    bits.append(np.packbits(h).tobytes() if h.any() else None)
                    mine = slice(cut[k], cut[k + 1])
                    items.append(sorted({part.names[x] for x in f.item[mine].tolist()} | set(old_items[k] or ())))
                    best = max(zip(f.length[mine].tolist(), (-f.text_at[mine]).tolist(), strict=True), default=(0, 0))
                    best = max(best, (old_longest[k] or 0, -(old_at[k] or 0)))
                    longest.append(best[0])
                    longest_at.append(-best[1] if best[0] else None)
                n_hit = [int.from_bytes(x).bit_count() if x else 0 for x in bits]
                kept = [b.column(c).slice(i, j - i) for c in range(own)]
                if blank:
                    kept[text_at] = pa.nulls(j - i, kept[text_at].type)
                state = [pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string())), *(pa.array(c, pa.int64()) for c in (longest, longest_at, np.diff(f.first), n_hit))]
                yield pa.RecordBatch.from_arrays([*kept, *state], b.schema.names)

    return df.mapInArrow(lean(run), df.schema)


def _searched(docs: DataFrame, benchmark: DataFrame, part_bytes: int, blank: bool) -> tuple[DataFrame, dict[str, str]]:
    """The rows with their state, and the state's column names, none of which is
    one of the rows' own."""
    at, names = docs.columns.index("text"), {}
    for c in STATE:
        names[c] = fresh_name(c, [*docs.columns, *names.values()])
    d = docs.select("*", *[F.lit(None).cast(t).alias(names[c]) for c, t in STATE.items()])
    before = None
    for part, last in _parts(benchmark, part_bytes):
        q = docs.sparkSession.sparkContext.broadcast(part)
        d = _search(d, at, q, blank and last)
        if not last:
            d = materialize(d, "decontaminate-part")
            q.destroy()
            if before is not None:
                discard(before)
            before = d
    return d, names


def _affected(n_hit: str, n_words: str, share: int | None):
    hit = F.col(n_hit) > 0
    return hit if share is None else hit & (share * F.col(n_hit) >= F.col(n_words))


def contamination(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES, share: int | None = HIT_SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the words
    of the longest verbatim match and its place in the text (the first of equals)."""
    d, c = _searched(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, part_bytes, blank=True)
    return d.select(
        "doc_id",
        F.col(c["n_words"]).alias("n_words"),
        F.col(c["n_hit"]).alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        _affected(c["n_hit"], c["n_words"], share).alias("contaminated"),
        F.col(c["longest"]).alias("longest_match"),
        F.col(c["longest_at"]).alias("longest_start"),
    )


def matches(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_words of every maximal verbatim
    match of a window or more, places in words from 0."""
    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names, out = ["doc_id", "item_id", "doc_start", "item_start", "n_words"], None

    def rows(q):
        def run(batches):
            part = q.value
            item_names = pa.array(part.names, pa.string())
            for b in batches:
                raw, offsets = K.text_bytes(b.column(1))
                for i, j in K.blocks(offsets, SHARD_BYTES):
                    f = search_shard(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], part)
                    ids = b.column(0).slice(i, j - i).take(pa.array(f.text))
                    yield pa.RecordBatch.from_arrays([ids, item_names.take(pa.array(f.item)), *map(pa.array, (f.text_at, f.item_at, f.length))], names)

        return run

    for part, last in _parts(benchmark, part_bytes):
        q = docs.sparkSession.sparkContext.broadcast(part)
        found = d.mapInArrow(lean(rows(q)), "doc_id string, item_id string, doc_start long, item_start long, n_words long")
        if not last:
            found = materialize(found, "decontaminate-matches")
            q.destroy()
        out = found if out is None else out.unionByName(found)
    return out.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES, share: int | None = HIT_SHARE) -> DataFrame:
    """The rows that are not affected, all columns kept, whatever their names.
    share None: a single match affects a row."""
    d, c = _searched(docs, benchmark, part_bytes, blank=False)
    return d.filter(~_affected(c["n_hit"], c["n_words"], share)).select(*docs.columns)
