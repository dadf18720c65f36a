import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        for p in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[p : p + 13]), set()).add(str(name) if name is not None else "null")
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for p in range(len(w)):
            for n in {len(k) for k in windows}:
                k = tuple(w[p : p + n])
                if len(k) == n and k in windows:
                    hit |= set(range(p, p + n))
                    names |= windows[k]
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def got(spark, docs, items, **k):
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    key = lambda r: (r[0] is not None, r)
    rows = [tuple(r)[:6] for r in dc.contamination(d, b, **k).collect()]
    kept = [(r["doc_id"], r["text"]) for r in dc.drop_contaminated(d, b, **k).collect()]
    return sorted(rows, key=key), kept


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = ["a", "bb", "Cc", "dÉ", "e9", "日本"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, text(int(n))) for i, n in enumerate([30, 13, 14, 3, 12, 5, 40, 40])] + [(8, ""), (9, None), (None, text(20)), (1, "zz yy"), (11, text(13))]
    items.append((100, items[0][1]))  # a repeated item under another id
    docs = []
    for i in range(60):
        t = text(int(rng.integers(0, 60)))
        if i % 3 == 0:
            t += ", " + items[int(rng.integers(0, 8))][1].upper().replace(" ", "! ") + ". " + text(5)
        docs.append((i, t))
    docs += [(60, ""), (61, None), (None, items[6][1]), (62, items[0][1] + " " + text(4000)), (5, docs[5][1]), (5, docs[5][1])]
    want = sorted(brute(docs, items), key=lambda r: (r[0] is not None, r))
    clean = [d for d, r in zip(docs, brute(docs, items), strict=True) if not r[5]]
    for part_bytes in (dc.PART_BYTES, 200):
        rows, kept = got(spark, docs, items, part_bytes=part_bytes)
        assert rows == want
        assert sorted(kept, key=str) == sorted(clean, key=str)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b")])[0] == []
    assert got(spark, [(1, "A b.")], [])[0] == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60))
def test_suffix_array_is_sorted(values):
    h = np.array(values, np.uint64)
    order = dc.suffix_array(h, 13)
    rows = [tuple(values[i : i + 13]) + (0,) * (13 - len(values[i : i + 13])) for i in order]
    assert sorted(order.tolist()) == list(range(len(values))) and rows == sorted(rows)


def test_longest_match(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, f"x {passage} y"), (2, passage[: passage.index(" w20")])], "doc_id long, text string")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert {r["doc_id"]: r["longest_match"] for r in dc.contamination(d, b).collect()} == {1: 30, 2: 20}


def longest_common(doc, items):
    """(words, place in the text) of the longest match of a window or more."""
    best = (0, 0)
    w = words(doc)
    for _, t in items:
        v = words(t)
        least = min(13, len(v))
        for i in range(len(w)):
            for j in range(len(v)):
                n = 0
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                if n >= least and n > 0:
                    best = max(best, (n, -i))
    return best[0], -best[1] if best[0] else None


def test_longest_match_across_repeated_passages(spark):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w[:20])), (2, " ".join(w[4:30])), (3, " ".join(w[10:23]))]
    docs = [(1, "x y " + " ".join(w[4:30]) + " z"), (2, " ".join(w[:13])), (3, " ".join(w[1:12])), (4, " ".join(w[4:30] + w[:20]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for part in (dc.PART_BYTES, 60):
        got = {r["doc_id"]: (r["longest_match"], r["longest_start"]) for r in dc.contamination(d, b, part).collect()}
        assert got == {1: (26, 2), 2: (13, 0), 3: (0, None), 4: (26, 0)}
        found = sorted(tuple(r) for r in dc.matches(d, b, part).collect() if r["doc_id"] == 1)
        assert found == [(1, "1", 2, 4, 16), (1, "2", 2, 0, 26), (1, "3", 8, 0, 13)]


def test_longest_match_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(rng.choice(["a", "b", "c"], n))
    items = [(i, text(int(n))) for i, n in enumerate([40, 25, 13, 20, 6])]
    items.append((9, items[0][1]))
    docs = [(i, text(20) + " " + items[i % 4][1][int(rng.integers(0, 20)) :] + " " + text(9)) for i in range(20)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["longest_match"], r["longest_start"]) for r in dc.contamination(d, b).collect()}
    assert got == {i: longest_common(t, items) for i, t in docs}


@given(st.lists(st.integers(1, 6), min_size=1, max_size=30), st.integers(1, 9))
def test_chunks_never_divide_a_text(pairs, most):
    text = np.sort(np.random.default_rng(len(pairs)).integers(0, 6, len(pairs)))
    old, dc.PAIRS = dc.PAIRS, most
    try:
        got = list(dc._chunks(np.array(pairs), text))
    finally:
        dc.PAIRS = old
    assert [x for i, j in got for x in range(i, j)] == list(range(len(pairs)))
    assert all(text[j - 1] != text[j] for _, j in got[:-1])


def test_any_match_and_any_column_names(spark):
    names = ["hit", "HIT_", "items", "longest", "n_words", "n_hit", "_hit", "_n_hit"]
    window = " ".join(f"q{i}" for i in range(13))
    rows = [(1, "word " * 5000 + window, *names), (2, "word " * 50, *names), (None, None, *names)]
    d = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)]))
    b = spark.createDataFrame([(1, window)], "item_id long, text string")
    for share, want in ((dc.HIT_SHARE, rows), (None, rows[1:])):
        out = dc.drop_contaminated(d, b, share=share)
        assert out.columns == d.columns and sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
