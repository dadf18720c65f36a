import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm import suffix_dedup as sd


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(0, 3))
def test_two_stage_order(symbols, doubled):
    for _ in range(doubled):
        symbols = symbols + symbols
    t = np.array([*symbols, 0], np.uint8)
    depth = len(t) + 8
    sa = sd.suffixes_two_stage(t, depth, sd.block_ranks(sd.padding(t, depth)))
    want = sorted(range(len(t)), key=lambda i: t[i:].tobytes())
    assert sa.tolist() == want


def test_common_prefixes():
    long = bytes(range(1, 90))
    t = np.frombuffer(b"abcdefghijkl\x00abcdefghijXl\x00" + long + b"\x00" + long[:70] + b"\x00", np.uint8)
    padded = sd.padding(t, 100)
    a, b = np.array([0, 1, 0, 5, 26, 27]), np.array([13, 14, 1, 18, 116, 117])
    for most in (10, 100):
        got = sd.common_prefixes(sd.eight(padded), sd.block_ranks(padded), a, b, most)
        assert got.tolist() == [min(x, most) for x in (10, 9, 0, 5, 70, 69)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=5, max_size=60), st.integers(1, 5))
def test_sliding_least(v, w):
    v = np.array(v, np.uint64)
    assert sd.sliding_least(v, min(w, len(v))).tolist() == [v[i : i + min(w, len(v))].min() for i in range(len(v) - min(w, len(v)) + 1)]


def brute(rows):
    seen = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for k, (_, b) in enumerate(texts):
        for p in range(len(b) - 399):
            seen.setdefault(b[p : p + 400], []).append((k, p))
    gone = [np.zeros(len(b), bool) for _, b in texts]
    for where in seen.values():
        if len(where) > 1:
            for k, p in where:
                gone[k][p : p + 400] = True
    out = []
    for (d, b), g in zip(texts, gone, strict=True):
        spans = int(((g[1:] > g[:-1]).sum() if len(g) else 0) + (g[0] if len(g) else 0))
        kept = np.frombuffer(b, np.uint8)[~g].tobytes()
        out.append((d, len(b), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdé "), int(rng.integers(2, 9)))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab, n))
    passage, base = prose(150), prose(400)
    rows = []
    for i in range(40):
        t = prose(int(rng.integers(20, 200)))
        if i % 3 == 0:
            t += passage[int(rng.integers(0, 60)) :] + prose(30)
        if i % 4 == 0:
            w = base.split(" ")
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = "EDIT"
            t = " ".join(w) + t
        rows.append((i, t))
    exact = prose(100)[:400]
    rows += [(100, exact[:400]), (101, exact[:400]), (102, exact[:399]), (103, "x" + exact[1:400])]
    rows += [(104, "z" * 1500), (105, "abc" * 300), (106, None), (107, ""), (None, base), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(108, passage[:399] + "#" + passage[400:])]
    return rows


@pytest.mark.parametrize("crowd,shard_bytes", [(sd.CROWD, sd.SHARD_BYTES), (2, 3000)])
def test_against_brute_force(spark, crowd, shard_bytes):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, n_bytes string").repartition(5)
    got = sorted((tuple(r) for r in sd.dedup_substrings(df, crowd, shard_bytes).collect()), key=str)
    assert got == brute(rows)


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(1)
    a = "".join(rng.choice(list("abcdefgh"), 5_000_000))
    rows = [(1, a), (2, a[2_000_000:4_100_000] + "tail")]
    got = {r["doc_id"]: r for r in sd.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"]) == (2_100_000, 1) == (got[2]["n_removed"], got[2]["n_spans"])
    assert got[1]["kept_sha256"] == hashlib.sha256((a[:2_000_000] + a[4_100_000:]).encode()).hexdigest()


def test_empty_table(spark):
    assert sd.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
