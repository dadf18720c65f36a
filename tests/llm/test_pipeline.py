import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from halyard.llm import mixing, toxicity
from halyard.llm.common import materialize
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_dup import brute as near

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["predicted"]}
    want = {d for d in rows if d not in rejected}
    out = cp.toxicity_stage(spark, docs, SF)
    assert out.schema == docs.schema and {r["doc_id"] for r in out.collect()} == want

    want = {d for d, _, _, kept in near([(d, rows[d]["text"]) for d in want]) if kept}
    out = cp.near_dup_stage(spark, out, SF)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r[0] for r in contaminated([(d, rows[d]["text"]) for d in want], items) if not r[2]}
    out = cp.decontaminate_stage(spark, out, SF)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want

    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(out).collect()}
    want = sorted(d for d, (t, n) in taken.items() for _ in range(-(-t // n) if n else 0))
    out = cp.mixing_stage(spark, out, SF)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == want

    tk, start, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d in want:
        ids = tk.encode(rows[d]["text"] or "", add_special_tokens=False).ids + [2]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, cp.token_stage(spark, out, SF).collect())) == sorted(expected)
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(expected)


def _through(spark, docs):
    out = []
    for _, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def test_cases_pass_all_stages(spark):
    extra = ["gone", "hit", "n_hit", "_size", "key", "component_id", "kept", "score"]
    long = "some quite ordinary words of a longer text " * 30
    texts = [(None, long + "one"), (None, "no id here, as short as this"), (1, None), (2, ""), (3, "calm words that stand in two equal rows"), (3, "calm words that stand in two equal rows"), (4, long + "one"), (5, " \n\t "), (6, "word " * 20_000 + "end")]
    rows = [(i, t, "en", None if i == 4 else "web", len(t or ""), *extra) for i, t in texts]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{c}` string" for c in extra)]))
    *stages, files = _through(spark, docs)
    assert all(s.columns == docs.columns for s in stages)
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in stages[2].collect())
    assert kept == sorted((i or 0, t or "") for i, t in texts)  # nothing toxic, near or contaminated: rows without doc_id are near nothing
    mixed = [(r["doc_id"], r["text"]) for r in stages[3].collect()]
    assert {i for i, _ in mixed} <= {None, 3, 4, 6} and mixed
    got = files.orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in mixed), key=lambda i: (i is not None, i or 0))
    assert got[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_empty_tables_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert [s.count() for s in _through(spark, docs)] == [0] * 5
