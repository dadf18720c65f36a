import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers

from halyard.llm import token_counts as tc

VOCAB = tc.vocabulary()
OURS = tc.Counter(VOCAB)


def library(vocab):
    tk = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    tk.normalizer = normalizers.Sequence([normalizers.Prepend(tc.MARK), normalizers.Replace(" ", tc.MARK)])
    return tk


LIB = library(VOCAB)


def lib_count(text, tk=LIB):
    return len(tk.encode(text, add_special_tokens=False).ids) if text else 0


def test_corpus_texts():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for t in texts:
        assert OURS.count(t) == lib_count(t)


def test_odd_texts():
    for t in ["a", " ", "  two  spaces   ", "\n\n x\ny \n", "日本語 ▁ ▁▁mark", "𝄞𝄞 😀😀", "<0x41> <s> </s> <unk>", "a\tb\x00\x01", "é ñandú" * 50, "x" * 5000]:
        assert OURS.count(t) == lib_count(t), t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab▁ \nçé😀th", max_size=25))
def test_random_texts(t):
    assert OURS.count(t) == lib_count(t)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abc▁", min_size=1, max_size=4), min_size=1, max_size=12, unique=True), st.data())
def test_random_vocabularies_with_ties(pieces, data):
    vocab = [("<unk>", 0.0), *((p, float(-data.draw(st.integers(1, 4)))) for p in pieces)]
    vocab += [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    ours, lib = tc.Counter(vocab), library(vocab)
    for _ in range(5):
        t = data.draw(st.text(alphabet="abcd \n", min_size=1, max_size=12))
        assert ours.count(t) == lib_count(t, lib), (vocab[:13], t)


def test_query(spark):
    rows = [(1, None, "n"), (2, "", "n"), (None, "hello world", "n"), (3, "same", "n"), (3, "same", "n"), (4, "long text " * 20_000, "n")]
    out = tc.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    assert sorted((tuple(r) for r in out), key=str) == sorted(((d, lib_count(t or "")) for d, t, _ in rows), key=str)
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert np.all([r["n_tokens"] >= 0 for r in out])
