import zlib

import numpy as np
import pyarrow as pa

from halyard.llm import kernel as K
from halyard.llm import toxicity as tx

DATA = "/root/testdata/sf0.1"


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def test_learns_pairs_beyond_linear_weights(spark):
    rng = np.random.default_rng(1)
    filler = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(3000):  # an insult is toxic only beside a group's mention
        w = list(rng.choice(filler, 30))
        kind = i % 4
        w += ["grumph"] * (kind in (1, 3)) + ["zorgs"] * (kind in (2, 3))
        rows.append((i, " ".join(rng.permutation(w)), "clash"))
        labels.append((i, int(kind == 3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    model = tx.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = tx.score(docs, model).collect()
    held = [r for r in out if r["held_out"]]
    assert held and all(r["held_out"] == (fold(r["doc_id"]) == 2) for r in out)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 3) for r in held]) > 0.97
    assert np.abs(model.v).max() > 0.05
    kept = {r["doc_id"] for r in tx.drop_toxic(docs, model).collect()}
    assert kept == {r["doc_id"] for r in out if not r["predicted"]}


def test_learns_a_pair_whose_terms_tell_nothing_alone(spark):
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(4000):  # toxic with both of two words or neither
        a, b = rng.integers(0, 2, 2)
        w = list(rng.choice([f"w{k}" for k in range(200)], 30)) + ["grumph"] * a + ["zorgs"] * b
        rows.append((i, " ".join(rng.permutation(w))))
        labels.append((i, int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = tx.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [r for r in tx.score(docs, model).collect() if r["held_out"]]
    assert 2 <= len(model.terms) < 20
    assert np.mean([r["predicted"] == labels[r["doc_id"]][1] for r in held]) > 0.95


def test_pairs_found_equal_a_plain_count():
    rng = np.random.default_rng(4)
    texts = [np.unique(rng.integers(0, 30, 8)) for _ in range(400)]
    y = np.array([int(3 in t and 7 in t or rng.random() < 0.2) for t in texts], float)
    p = np.full(len(y), y.mean())
    want = {}
    for a in range(30):
        for b in range(a + 1, 30):
            both = [k for k, t in enumerate(texts) if a in t and b in t]
            z = (y[both] - p[both]).sum() / np.sqrt((p[both] * (1 - p[both])).sum() + 1e-6)
            if abs(z) >= 2:
                want[a, b] = z
    old, tx.TILE = tx.TILE, 7
    try:
        got = tx.interactions(y, p, texts, 30, 2)
    finally:
        tx.TILE = old
    assert {(a, b) for a, b, _ in got} == set(want) and all(abs(want[a, b] - z) < 1e-3 for a, b, z in got)
    assert got[0][:2] == (3, 7)


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(6)
    vocab = [f"term{i}" for i in range(12)]
    raw, offsets = K.text_bytes(pa.array(vocab))
    hashes = np.unique(tx.term_hashes(raw, offsets)[0])
    m = tx.Model(hashes, 0.3, rng.normal(size=len(hashes)), rng.normal(size=(len(hashes), tx.FACTORS)))
    texts = [" ".join(rng.choice(vocab, 6)) for _ in range(30)] + ["", "other words"]
    raw, offsets = K.text_bytes(pa.array(texts))
    for t, s in zip(texts, m.scores(raw, offsets), strict=True):
        own = K.text_bytes(pa.array([t]))
        on = [i for i, h in enumerate(hashes) if h in tx.term_hashes(*own)[0]]
        z = m.w0 + sum(m.w[i] for i in on) + sum(m.v[i] @ m.v[j] for i in on for j in on if i < j)
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9


def test_class_bound_keeps_decisions(spark):
    rng = np.random.default_rng(3)
    filler = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(3000):  # with the word 15 % are toxic: below the threshold
        toxic = i % 20 == 0
        w = list(rng.choice(filler, 30)) + ["grumph"] * (toxic or i % 10 in (1, 2, 3))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole, cut = ({r["doc_id"]: r for r in tx.score(docs, tx.fit(docs, known, per_class=n)).collect()} for n in (10_000, 80))
    word = [i for i in range(3000) if "grumph" in rows[i][1]]
    assert not any(whole[i]["predicted"] for i in word)
    assert np.mean([cut[i]["predicted"] for i in word]) < 0.02
    assert abs(np.mean([cut[i]["score"] for i in word]) - np.mean([whole[i]["score"] for i in word])) < 0.08


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "idiot " * 50_000), (3, "idiot " * 50_000), (None, "calm words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = tx.score(docs, tx.fit(docs, none)).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in out)
    assert tx.score(docs.limit(0), tx.fit(docs, none)).count() == 0
    both = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (2, None)], "doc_id long, toxic int")
    assert len(tx.score(docs, tx.fit(docs, both)).collect()) == 5


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = tx.score(docs, tx.fit(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in out if r["toxic"] == 1]
    clean = [r for r in out if r["toxic"] == 0]
    assert np.mean([r["predicted"] for r in toxic]) > 0.85
    assert np.mean([r["predicted"] for r in clean]) < 0.02
