import resource
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from halyard.llm import kernel as K
from halyard.llm import token_binary as tb
from halyard.llm.common import lean

SCHEMA = "doc_id long, text string, start string"


def brute(rows):
    tk = Tokenizer.from_file(public_tokenizers.path(tb.TOKENIZER))
    out, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tk.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_against_the_library(spark):
    texts = [
        "", None, "Hello, world! it's 1234 we'll o'clock", "Éréier enqueeau de,\tles l a ǅ Σίσυφος ΣΑΣ",
        "a\x1cb\x1d c", "é ́ x", "<|endoftext|> <|startoftext|>x <| y", "日本語 テスト １２３ ½ ²",
        "\x00\x01 \x7f control​zero", "  \n\r\n ", "word " * 5000, "x" * 70_000, "ﬁ İstanbul ß ẞ", " line sep\u0085next",
    ]
    rows = [(len(texts) - i, t, "clash") for i, t in enumerate(texts)]
    got = tb.token_binary(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(rows)


def test_ties_nulls_and_empty_table(spark):
    rows = [(3, "same", "c"), (3, "same", "c"), (None, "x y", "c"), (1, None, "c")]
    got = tb.token_binary(spark.createDataFrame(rows, SCHEMA)).orderBy("start").collect()
    assert [tuple(r) for r in got] == brute(rows)
    assert tb.token_binary(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abZ'stl019.,<|>éÀÿßÜñ×÷ªµ½²\u00ad\u0301 \n", max_size=30))
def test_chunks_equal_whole_texts(t):
    path = public_tokenizers.path(tb.TOKENIZER)
    enc = tb._loaded.setdefault("test", tb.ChunkEncoder(path)) if "test" not in tb._loaded else tb._loaded["test"]
    assert np.frombuffer(enc.encode(t), np.uint16).tolist() == enc.whole.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abZ .,'1é\x1c\x85\xa0\u2003\u3000\u200b日\n", max_size=12), max_size=8))
def test_blocks_of_texts_equal_the_library(texts):
    path = public_tokenizers.path(tb.TOKENIZER)
    enc = tb._loaded.setdefault("test", tb.ChunkEncoder(path)) if "test" not in tb._loaded else tb._loaded["test"]
    raw, offsets = K.text_bytes(pa.array(texts, pa.string()))
    ids, before = enc.block(raw, offsets, [2])
    want = [enc.whole.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [ids[before[k] : before[k + 1]].tolist() for k in range(len(texts))] == want


def test_rows_without_doc_id_are_dealt_out(spark):
    rows = [(None, f"text {i} of many", "c") for i in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files, _ = tb.write_token_files(spark.createDataFrame(rows, SCHEMA).repartition(4))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.select("part").distinct().count() > 4
    got = tb.token_binary(spark.createDataFrame(rows, SCHEMA)).orderBy("start").collect()
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist() and all(r["doc_id"] is None for r in got)


def test_chunks_equal_whole_texts_of_the_corpus():
    import pyarrow.parquet as pq

    enc = tb.ChunkEncoder(public_tokenizers.path(tb.TOKENIZER))
    for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist():
        assert np.frombuffer(enc.encode(t), np.uint16).tolist() == enc.whole.encode(t, add_special_tokens=False).ids


def test_remembered_bytes_are_bounded(monkeypatch):
    most = 200_000
    for name in ("CHUNK_BYTES", "WORD_BYTES"):
        monkeypatch.setattr(tb, name, most, raising=False)
    enc = tb.ChunkEncoder(public_tokenizers.path(tb.TOKENIZER))
    texts = [f"the word{k} " + "q" * (k % 3000) + f"{k}" for k in range(3000)]
    raw, offsets = K.text_bytes(pa.array(texts, pa.string()))
    for _ in range(2):
        ids, before = enc.block(raw, offsets, [2])
        assert [ids[before[k] : before[k + 1]].tolist() for k in range(0, len(texts), 100)] == [enc.whole.encode(t, add_special_tokens=False).ids + [2] for t in texts[::100]]
    for held in (enc.chunks, enc.parts):
        assert held and sum(map(sys.getsizeof, [*held, *held.values()])) < most


def _resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize()


def test_tasks_hand_back_freed_memory():
    """Small pieces below one that stays: only trimming hands them back."""
    kept = []

    def run(batches):
        for b in batches:
            held = [np.ones(2000) for _ in range(10_000)]
            kept.append(np.ones(2000))
            del held
            yield b

    b = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["n"])
    before = _resident()
    assert list(run(iter([b]))) == [b] and _resident() - before > 100 << 20
    assert list(lean(run)(iter([b, b]))) == [b, b] and _resident() - before < 32 << 20
    assert len(kept) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=70))
def test_code_round_trip(ranks):
    a = np.array(ranks, np.uint32)
    control, data = tb.encode_ranks(a)
    assert len(control) == -(-len(a) // 4)
    assert tb.decode_ranks(control, data, len(a)).tolist() == ranks
