import re

import numpy as np
import pytest

from halyard.llm import common
from halyard.llm import near_dup as nd


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, (d, s) in enumerate(sets):
        if d is None or not s:
            continue
        for j in {j for x in s for j in holders[x] if j < i}:
            e, o = sets[j]
            both = len(s & o)
            if e is not None and 100 * both >= 85 * (len(s) + len(o) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i)) if d is not None else None, d == low.get(find(i)) if d is not None else None) for i, (d, s) in enumerate(sets)), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, component_id string")
    return sorted((tuple(r) for r in nd.near_duplicates(df).collect()), key=str)


@pytest.mark.parametrize("crowd", [nd.CROWD, 3])
def test_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(nd, "CROWD", crowd)
    rng = np.random.default_rng(5)
    vocab = [f"W{i}é" for i in range(4000)]
    line = " ".join(vocab[:10])
    rows = [(None, "a b c d e f"), (900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a  B"), (905, "b a"), (906, "x " * 30_000)]
    base = list(rng.choice(vocab, 120))
    doc = 0
    for group in range(6):  # families with edits from none to many
        words = base if group == 0 else list(rng.choice(vocab, int(rng.integers(20, 200))))
        for k in range(25):
            w = list(words)
            for _ in range(int(rng.integers(0, 6))):
                w[int(rng.integers(0, len(w)))] = str(rng.choice(vocab))
            rows.append((doc, " ".join(w).upper() if k % 3 else "\t".join(w)))
            doc += 1
    for k in range(150):  # short texts that share one line and little else
        rows.append((doc, line + " " + " ".join(rng.choice(vocab, int(rng.integers(0, 9))))))
        doc += 1
    rows += [(10, rows[20][1]), (10, rows[20][1])]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []
    assert nd.drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_drop_keeps_one_of_each(spark):
    df = spark.createDataFrame([(3, "a b c d e f", "k"), (1, "A b c d e f", "k"), (2, "other text", "k"), (None, "a b c d e f", "k"), (7, None, "k")], "doc_id long, text string, kept string")
    out = nd.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 2, 7, None]


def test_threshold_is_a_parameter(spark):
    words = [f"w{i}" for i in range(104)]
    edited = [*words[:50], "x", *words[51:]]  # 100 shingles each, 95 in both: 95 / 105
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited))], "doc_id long, text string")
    kept = lambda p: nd.near_duplicates(df, p).filter("kept").count()
    assert (kept(90), kept(91)) == (1, 2)


def test_drop_takes_any_column_names(spark):
    names = ["gone", "Gone_", "_gone", "rep", "n", "t", "x", "y", "kept", "component_id", "parity", "keys"]
    rows = [(i, "a b c d e f", *names) for i in (2, 1)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = nd.drop_near_duplicates(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [rows[1]]


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i != 30] + [(100, 90), (90, 100)]
    comps = dict(nd.components(spark.createDataFrame(edges, "x long, y long")).collect())
    assert comps == {**{i: 0 for i in range(1, 31)}, **{i: 31 for i in range(32, 61)}, 100: 90}


def test_parities_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (set(rng.integers(0, 400, int(rng.integers(0, 300))).tolist()) for _ in range(2))
        p = [nd.parities(np.array(sorted(s), np.uint64), np.zeros(len(s), int), 1) for s in (a, b)]
        assert sum(int(x).bit_count() for x in (p[0] ^ p[1]).view(np.uint64)) <= len(a ^ b)


@pytest.mark.parametrize("s", [0.85, 0.92])
def test_share_of_pairs_found(s):
    assert (1 - (1 - s**nd.WIDTH) ** nd.SIDE) ** 2 > 0.9999


def test_loop_tables_are_written_in_few_files(spark):
    most = max(common.FEW_FILES, 3 * spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(3 * most))
    try:
        edges = spark.range(5000).selectExpr("id * 2 AS x", "id * 2 + 1 AS y")
        found = nd.components(edges)
        assert len(found.inputFiles()) <= most
        assert found.count() == 5000 == found.filter("component = node - 1 AND component % 2 = 0").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
