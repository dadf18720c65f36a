"""Toxicity: a factorization machine over hashed terms.

Score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct terms
of a text. Terms are the words (runs of letters and digits, A-Z lower-cased) and
the four-byte stems of words of six bytes or more, hashed to 32 bits. The factor
vectors let a pair of terms count more, or less, than its two linear weights.

Fitting is bounded by one documented parameter: ``PER_CLASS`` labelled texts of
each class (those whose doc_id hashes lowest) are read. The classes are counted
over all labelled rows, and w0 is moved from the odds of the sample to theirs, so
the bound does not raise the odds. A term enters the machine in one of two ways:

* alone, if the classes differ in its share by ``MIN_Z`` standard errors;
* by an interaction: what the terms that entered alone leave unexplained, summed
  over the texts that hold both terms of a pair, is ``MIN_PAIR_Z`` standard errors
  from none. All pairs of terms in a share of the sample between ``PAIR_SHARE`` and
  its complement are tested, by blocks of one matrix product, so a word that tells
  nothing alone is found with its partner. Pairs found set the factor vectors that
  training starts from.

Everything that enters is fitted together, linear weights and factors. Rows
whose crc32(doc_id) mod 4 is 2 are held out of it. Scoring covers whole texts of
all rows and never sees labels, lang, source or doc_id.

Defined cases: null and empty texts have no terms and score sigmoid(w0); a
document labelled more than once is toxic if any label is 1, null labels are
none; repeated rows score alike; without labels of both classes every score is
the share of toxic labels (0 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import discard, lean, materialize

#: Labelled texts read of each class, at most.
PER_CLASS = 10_000
#: Least significance of a term (difference of class shares over its standard
#: error) and of a pair.
MIN_Z, MIN_PAIR_Z = 5.0, 7.0
#: Terms of pairs are in this share of the sample at least, and at most in all but
#: this share: rarer ones meet too seldom for a pair to be told from chance.
PAIR_SHARE = 1 / 64
#: Terms on a side of a block of pairs.
TILE = 128
FACTORS = 4
THRESHOLD = 0.3


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def term_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all terms of the texts, and the number of each text's text."""
    low = K.LOWER[raw]
    start, end, first = K.words(low, offsets, K.ALNUM)
    h = K.word_hashes(low, start, end)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    long = np.flatnonzero(end - start >= 6)
    stem = K.mix64(K.word_hashes(low, start[long], start[long] + 4) + K.STEP)
    return np.concatenate([h, stem]) >> np.uint64(32), np.concatenate([text, text[long]])


@dataclass
class Model:
    terms: np.ndarray  # sorted 32-bit hashes (uint64)
    w0: float
    w: np.ndarray
    v: np.ndarray

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.terms & np.uint64(0xFFFFF)] = True

    def active(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, term number) pairs of the model's terms."""
        h, text = term_hashes(raw, offsets)
        if not len(self.terms):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        near = np.flatnonzero(self.maybe[h & np.uint64(0xFFFFF)])
        h, text = h[near], text[near]
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = self.terms[at] == h
        both = np.unique(text[hit] * len(self.terms) + at[hit])
        return both // len(self.terms), both % len(self.terms)

    def logits(self, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.w0) + np.bincount(text, self.w[term], n)
        for f in range(self.v.shape[1]):
            x = self.v[term, f]
            out += 0.5 * (np.bincount(text, x, n) ** 2 - np.bincount(text, x * x, n))
        return out

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(*self.active(raw, offsets), len(offsets) - 1))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def interactions(y: np.ndarray, p: np.ndarray, texts: list[np.ndarray], n_terms: int, min_z: float = MIN_PAIR_Z) -> list[tuple[int, int, float]]:
    """(a, b, z) of the pairs a < b of terms for which the labels ``y`` less their
    probabilities ``p``, summed over the texts with both, are ``min_z`` standard
    errors from none, the strongest first."""
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    term = np.concatenate(texts).astype(np.int32)
    order = np.argsort(term, kind="stable")
    text, term = text[order], term[order]

    def tile(i: int) -> np.ndarray:
        """Which texts hold the terms from i on."""
        part = slice(*np.searchsorted(term, [i, i + TILE]))
        has = np.zeros((min(TILE, n_terms - i), len(texts)), np.float32)
        has[term[part] - i, text[part]] = 1
        return has

    out = []
    for i in range(0, n_terms, TILE):
        a = tile(i)
        pull, spread = a * (y - p).astype(np.float32), a * (p * (1 - p)).astype(np.float32)
        for j in range(i, n_terms, TILE):
            b = tile(j).T
            z = (pull @ b) / np.sqrt(spread @ b + np.float32(1e-6))
            r, c = np.nonzero(np.abs(z) >= min_z)
            out += [(x, w, float(v)) for x, w, v in zip((r + i).tolist(), (c + j).tolist(), z[r, c].tolist(), strict=True) if x < w]
    return sorted(out, key=lambda r: (-abs(r[2]), r[0], r[1]))


def _train(terms: np.ndarray, rows: list[tuple[int, np.ndarray]], pairs: list[tuple[int, int, float]] = (), epochs: int = 30, l2: float = 2e-4, seed: int = 7) -> Model:
    """Adagrad on the logistic loss, in mini-batches of a fixed order. Terms of a
    pair start on one factor, alike or opposed as the pair's sign says."""
    rng = np.random.default_rng(seed)
    y = np.array([r[0] for r in rows], float)
    rate = y.mean()
    m = Model(terms, float(np.log(rate / (1 - rate))), np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), FACTORS)))
    begun: dict[int, int] = {}
    for a, b, z in pairs:
        if a not in begun and b not in begun:
            begun[a] = begun[b] = f = len(begun) // 2 % FACTORS
            m.v[a, f], m.v[b, f] = 0.5, 0.5 * np.sign(z)
        elif (a in begun) != (b in begun):
            known, other = (a, b) if a in begun else (b, a)
            begun[other] = f = begun[known]
            m.v[other, f] = np.sign(z) * m.v[known, f]
    size = np.array([len(r[1]) for r in rows])
    ends = np.cumsum(size)
    flat = np.concatenate([r[1] for r in rows]) if len(rows) else np.empty(0, np.int64)
    g0, gw, gv = 1e-6, np.full(len(terms), 1e-6), np.full((len(terms), FACTORS), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(rows) // 256)):
            text = np.repeat(np.arange(len(part)), size[part])
            term = np.concatenate([flat[ends[r] - size[r] : ends[r]] for r in part]) if len(text) else np.empty(0, np.int64)
            err = _sigmoid(m.logits(text, term, len(part))) - y[part]
            g = err.mean()
            g0 += g * g
            m.w0 -= 0.1 * g / np.sqrt(g0)
            used, where = np.unique(term, return_inverse=True)
            if not len(used):
                continue
            d = np.bincount(where, err[text], len(used)) / len(part) + l2 * m.w[used]
            gw[used] += d * d
            m.w[used] -= 0.2 * d / np.sqrt(gw[used])
            for f in range(FACTORS):
                x = m.v[term, f]
                total = np.bincount(text, x, len(part))
                d = np.bincount(where, err[text] * (total[text] - x), len(used)) / len(part) + l2 * m.v[used, f]
                gv[used, f] += d * d
                m.v[used, f] -= 0.02 * d / np.sqrt(gv[used, f])
    return m


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, min_z: float = MIN_Z, min_pair_z: float = MIN_PAIR_Z) -> Model:
    """Fit on labelled texts outside the held-out fold."""
    known = labels.filter(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    pick = F.xxhash64("doc_id")
    sample = None
    for c in (0, 1):
        rows = known.filter(F.col("toxic") == c).orderBy(pick, "doc_id").limit(per_class)
        sample = rows if sample is None else sample.unionByName(rows)
    labelled = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # at most 2 * per_class rows of 12 bytes: bounded whatever the corpus
    sample = materialize(sample, "tox-sample")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = materialize(texts.select("text", "toxic"), "tox-texts")
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    empty = np.empty(0, np.uint64)
    if not pos or not neg:
        discard(sample, texts)
        return Model(empty, 35.0 if pos else -35.0, np.empty(0), np.empty((0, FACTORS)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            raw, offsets = K.text_bytes(b.column(0))
            for i, j in K.blocks(offsets):
                h, text = term_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                both = np.unique((h << np.uint64(31)) | text.astype(np.uint64))
                h, text = both >> np.uint64(31), (both & np.uint64(0x7FFFFFFF)).astype(np.int64)
                terms, where = np.unique(h, return_inverse=True)
                p = np.bincount(where, label[i + text] == 1, len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int64)), pa.array(p), pa.array(np.bincount(where, minlength=len(terms)) - p)], ["term", "p", "n"])

    counts = texts.mapInArrow(lean(count), "term long, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    share = (F.col("p") + F.col("n")) / F.lit(float(pos + neg))
    z = F.abs(F.col("p") / F.lit(float(pos)) - F.col("n") / F.lit(float(neg))) / F.sqrt(share * (1 - share) * F.lit(1 / pos + 1 / neg) + F.lit(1e-12))
    alone, paired = z >= min_z, share.between(PAIR_SHARE, 1 - PAIR_SHARE)
    got = counts.select("term", alone.alias("alone"), paired.alias("paired")).filter("alone OR paired").orderBy("term").toArrow()
    terms, alone, paired = (got.column(c).to_numpy() for c in range(3))
    terms = terms.astype(np.uint64)
    blank = Model(terms, 0.0, np.zeros(len(terms)), np.zeros((len(terms), FACTORS)))

    def reduce(batches):
        for b in batches:
            raw, offsets = K.text_bytes(b.column(0))
            for i, j in K.blocks(offsets):
                text, term = blank.active(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cut = np.searchsorted(text, np.arange(j - i + 1))
                packed = [term[cut[k] : cut[k + 1]].astype("<i4").tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), pa.array(packed, pa.binary())], ["toxic", "terms"])

    got = texts.mapInArrow(lean(reduce), "toxic int, terms binary").toArrow()
    discard(sample, texts)
    rows = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    rows = [(t, np.frombuffer(x, "<i4")) for t, x in rows]
    model = _fitted(terms, alone, paired, rows, min_pair_z)
    model.w0 -= _odds_shift(labelled, per_class)
    return model


def _fitted(terms: np.ndarray, alone: np.ndarray, paired: np.ndarray, rows: list[tuple[int, np.ndarray]], min_pair_z: float) -> Model:
    """Terms alone, then pairs in their residuals, then all of them together."""
    first = _train(*_narrow(terms, rows, alone))
    at = np.cumsum(alone) - 1
    active = [at[t[alone[t]]] for _, t in rows]
    text = np.repeat(np.arange(len(rows)), [len(t) for t in active])
    y = np.array([r[0] for r in rows], float)
    p = _sigmoid(first.logits(text, np.concatenate(active), len(rows)))
    open_, within = _narrow(terms, rows, paired)
    pairs = interactions(y, p, [t for _, t in within], len(open_), min_pair_z)
    if not pairs:
        return first
    place = np.flatnonzero(paired)
    pairs = [(int(place[a]), int(place[b]), z) for a, b, z in pairs]
    enter = alone.copy()
    for a, b, _ in pairs:
        enter[a] = enter[b] = True
    at = np.cumsum(enter) - 1
    return _train(*_narrow(terms, rows, enter), [(int(at[a]), int(at[b]), z) for a, b, z in pairs])


def _narrow(terms: np.ndarray, rows: list[tuple[int, np.ndarray]], keep: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    at = np.cumsum(keep) - 1
    return terms[keep], [(y, at[t[keep[t]]].astype(np.int64)) for y, t in rows]


def _odds_shift(labelled: dict[int, int], per_class: int) -> float:
    """Log of the sample's odds over those of all labelled rows."""
    rate = [min(labelled[c], per_class) / labelled[c] for c in (0, 1)]
    return float(np.log(rate[1] / rate[0]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = _batch_scores(shared.value, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    d = docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def _batch_scores(model: Model, column: pa.Array) -> np.ndarray:
    raw, offsets = K.text_bytes(column)
    parts = [model.scores(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in K.blocks(offsets)]
    return np.concatenate(parts) if parts else np.empty(0)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, all columns kept."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_batch_scores(shared.value, b.column(at)) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
