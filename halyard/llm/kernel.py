"""Byte-level text kernel: words, hashes and shingles of many texts at once.

Texts stay in their Arrow buffer. A word's hash is a polynomial over its bytes
modulo 2**64, read off one running sum for all words of a block, then mixed;
equal words have equal hashes, and unequal words of a corpus meet with the odds
of a random 64-bit value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
STEP = np.uint64(0xD1342543DE82EF95)

#: Words of the shingle contracts: everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words of the benchmark contract: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up, down = np.full(size, BASE), np.full(size, BASE_INV)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mix64(h: np.ndarray) -> np.ndarray:
    """Invertible scrambling, so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a block of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each
    text (one more entry than texts). Words never span texts."""
    n = len(raw)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(lowered: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of each word of the (already lower-cased) bytes."""
    if len(start) == 0:
        return np.empty(0, np.uint64)
    up, down = _pow(len(lowered) + 1)
    total = np.zeros(len(lowered) + 1, np.uint64)
    np.cumsum((lowered.astype(np.uint64) + np.uint64(1)) * up[: len(lowered)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * STEP)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``k`` words within a text, and the window counts
    before each text. A text of fewer words, but not none, is one window."""
    count = np.diff(first)
    per = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    before = np.concatenate([[0], np.cumsum(per)])
    total = int(before[-1])
    if total == 0:
        return np.empty(0, np.uint64), before
    text = np.repeat(np.arange(len(per)), per)
    at = first[:-1][text] + (np.arange(total) - before[:-1][text])
    span = np.minimum(count, k)[text]
    out = np.zeros(total, np.uint64)
    if len(hashes) >= k and (count >= k).all():
        for j in range(k):
            out = out * STEP + hashes[at + j]
    else:
        padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
        for j in range(k):
            out = out * STEP + np.where(j < span, padded[at + j], np.uint64(0))
    return mix64(out + span.astype(np.uint64)), before


def distinct_per_text(values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their counts before each text."""
    if len(values) == 0:
        return values, np.zeros(len(before), np.int64)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    v, t = v[keep], t[keep]
    return v, np.searchsorted(t, np.arange(len(before)))
