"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends
at each character; dynamic programming keeps, for each place, the best score of a
segmentation that ends there and its number of tokens, and nothing to trace a
path back. Ties go to the earlier start (the longer last piece), as in the
tokenizer whose counts these are: a unigram model with byte fallback and fused
unknowns. A character in no single-character piece is an unknown one at the
lowest score less 10; unknown runs count their UTF-8 bytes.

White space is the piece mark: one is put before a text and in place of each
space. No piece runs across the start of a mark, nor over a newline if none
contains one, so a text's best segmentation is its sections' one by one; sections
repeat, and each is solved once. With scores whose sums are exact in double
precision (ranks are) that is the whole text's result to the last tie.

The vocabulary is that of a public tokenizer file; it is never trained here.

Defined cases: null and empty texts have no tokens; null doc_ids and repeated
rows pass through; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_COST = 10.0
#: Sections whose counts a worker remembers (a bound on its memory only).
REMEMBER = 1_000_000


def vocabulary(model: str = MODEL) -> list[tuple[str, float]]:
    """(piece, score) by id, of a sentencepiece model file."""
    import sentencepiece

    if os.path.sep not in model:
        import public_tokenizers

        model = public_tokenizers.path(model)
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Counts tokens of whole texts under a vocabulary."""

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.pieces = {p for p, _ in vocab}
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_COST
        self.fallback = all(f"<0x{b:02X}>" in self.pieces for b in range(256))
        inner = any(MARK in p.lstrip(MARK) for p in self.pieces)
        newline = any("\n" in p for p in self.pieces)
        if inner:
            self.cut = None
        else:
            self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if newline else f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
        self.plain = not inner and not newline
        self.known: dict[str, int] = {}

    def section(self, text: str) -> int:
        """Tokens of the best segmentation of a section."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(text):
            ends[last + 1].append(match)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        run = [-1] * (n + 1)  # where the run of unknown characters that ends here began
        before = [0] * (n + 1)  # tokens before that run
        for end in range(1, n + 1):
            top, tokens, single = None, 0, False
            for length, score in ends[end]:  # the longest first, so the earliest start
                start = end - length
                got = best[start] + score
                if top is None or got > top:
                    top, tokens = got, count[start] + 1
                if length == 1:
                    single = True
            if not single:
                got = best[end - 1] + self.unknown
                if top is None or got > top:
                    top = got
                    run[end] = run[end - 1] if run[end - 1] >= 0 else end - 1
                    before[end] = before[end - 1] if run[end - 1] >= 0 else count[end - 1]
                    fused = text[run[end] : end]
                    tokens = before[end] + (len(fused.encode()) if self.fallback and fused not in self.pieces else 1)
            best[end], count[end] = top, tokens
        return count[n]

    def _learn(self, section: str) -> int:
        got = self.section(section)
        if len(self.known) < REMEMBER:
            self.known[section] = got
        return got

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if self.cut is None:
            return self.section(marked)
        known = self.known
        if self.plain and MARK + MARK not in marked:
            sections = marked.replace(MARK, " " + MARK).replace("\n", " \n ").split(" ")
            sections = [s for s in sections if s] if "\n" in marked else sections[1:]
        else:
            sections = self.cut.findall(marked)
        total = 0
        for s in sections:
            n = known.get(s)
            total += self._learn(s) if n is None else n
        return total


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and n_tokens of every whole text."""

    def run(batches):
        c = _counters.get(model) or _counters.setdefault(model, Counter(vocabulary(model)))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                n = [c.count(t or "") for t in s.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_tokens long")
