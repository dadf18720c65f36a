import math
from collections import defaultdict

import duckdb

from halyard.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def got(spark, rows):
    return mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()


def test_targets_by_water_filling(spark):
    sizes = {"a": 10, "b": 1000, "c": 7, "d": 3000, "é": 500, None: 60}
    rows, n = [], 0
    for s, words in sizes.items():
        for k in range(10):
            rows.append((n, "w " * (words // 10 + (k < words % 10)), s, "x"))
            n += 1
    out = got(spark, rows)
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, left, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:  # the rule as written: stop at twice the size, reshare the excess
        share = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * share > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    target |= {s: weight[s] * share for s in left}
    for s, rs in by.items():
        assert math.isclose(rs[0]["target"], target[s], rel_tol=1e-9)
        assert sum(r["taken"] for r in rs) == round(target[s])
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rs)
        epochs = round(target[s]) // sizes[s]
        assert all(r["taken"] >= epochs * r["size"] for r in rs)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, got(spark, rows)), key=str)


def test_cases(spark):
    assert got(spark, []) == []
    assert [(r["size"], r["taken"], r["target"]) for r in got(spark, [(1, None, "a", ""), (None, "", None, "")])] == [(0, 0, 0.0)] * 2
    rows = [(1, " a\tb\x0bc ", "s", ""), (1, " a\tb\x0bc ", "s", ""), (2, "x " * 20_000, None, ""), (None, "é\xa0é", "s", "")]
    out = got(spark, rows)
    assert sorted(r["size"] for r in out) == [1, 3, 3, 20_000]
    assert mixing.mix_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame(rows, SCHEMA)
    assert mixing.mix_documents(df).columns == df.columns


def test_rows_without_doc_id_have_keys_of_their_own(spark):
    rows = [(None, f"text {i} w", "a", "") for i in range(500)] + [(7, f"other {i} w", "a", "") for i in range(500)] + [(9000 + i, "w w", "b", "") for i in range(3000)]
    out = [r for r in got(spark, rows) if r["source"] == "a"]
    assert len({r["key"] for r in out}) == 1000
    assert sum(r["taken"] for r in out) == round(out[0]["target"])
    mixed = mixing.mix_documents(spark.createDataFrame(rows, SCHEMA)).filter("source = 'a'").groupBy("doc_id", "text").count().collect()
    assert abs(3 * sum(r["count"] for r in mixed) - out[0]["target"]) <= 3


def test_any_column_names(spark):
    names = ["_size", "_key", "size", "key", "copy", "end", "epochs", "mixed", "chars", "Key_"]
    rows = [(i, "some words here", "a", *[f"{n}{i}" for n in names]) for i in range(20)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{n}` string" for n in names)]))
    out = mixing.mix_documents(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= set(rows) and out.count() == 30


def test_heavier_documents_come_first(spark):
    text = ["good words here " * 20, "a b " * 30]
    rows = [(i, text[i % 2], "a", "") for i in range(4000)] + [(9000 + i, "other text " * 10, "b", "") for i in range(9000)]
    taken = [0, 0]
    for r in got(spark, rows):
        if r["source"] == "a":
            taken[r["doc_id"] % 2] += min(1, r["taken"] - r["size"]) if r["taken"] > r["size"] else 0
    full = got(spark, rows)
    keys = sorted((r["key"], r["doc_id"] % 2) for r in full if r["source"] == "a")
    first = [p for _, p in keys[:1000]]
    assert 0.25 < sum(first) / len(first) < 0.42  # weights 1 and 0.5: a third


def test_against_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(mixing.SQL).fetchall()
    out = mixing.mix(spark.read.parquet(path)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, out)) == sorted(want)
