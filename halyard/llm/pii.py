"""Personal data by a skip-chain conditional random field.

Base spans are exact: the four patterns of email address, IP address, payment
card and phone number, leftmost and non-overlapping within a kind, with failing
matches dropped. They are found in time linear in the text.

The field then labels further mentions. Its nodes are the base spans (whose
labels are observed) and loose candidates outside them: runs of seven digits or
more in any grouping, words with an at sign, and words equal to the local part of
an address found in the document (of six characters or more, a digit among them:
shorter parts and plain words such as "info" are also other things' names).
Neighbouring nodes are joined by a chain edge; mentions of one thing anywhere in a
document (equal text, equal digits, equal last seven digits, equal local part) by
skip edges, each to the mention before it and to the nearest base span, or the
nearest mention with a way to one, so edges are linear in the nodes and a base span
is as near to its hundredth repeat as to its first. Loopy belief propagation with damping runs
over all documents of a batch at once, and a candidate whose probability of a
kind passes ``CERTAIN`` becomes a span of that kind.

Weights are learned by pseudo-likelihood from ``SAMPLE`` documents at most (those
whose doc_id hashes lowest), the base kinds as labels; every node counts a second
time with its deciding features hidden, which is how potentials of the edges are
learned. Extraction covers whole texts of all rows.

Defined cases: null and empty texts have no spans; null doc_ids and repeated rows
pass through; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections import Counter
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Documents read for learning, at most.
SAMPLE = 4000
CERTAIN = 0.5
SWEEPS, DAMPING = 12, 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
# runs that can hold an address, card or phone number: all their characters, at least seven
_REGION = re.compile(r"[+0-9(][0-9+\x20().-]{6,}")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = re.compile(r"\(?[0-9][0-9\x20().-]*[0-9]")
_AT_WORD = re.compile(r"(?<![^\s@])[^\s@]++@[^\s@]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern: a local part is the whole run before an
    at sign, back to the match before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the base matches in order, and the number regions."""
    spans = [(s, 0, e) for s, e in emails(text)]
    regions = [m.span() for m in _REGION.finditer(text)]
    for lo, hi in regions:
        r = text[lo:hi]
        for m in _IP.finditer(r):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append((lo + m.start(), 1, lo + m.end()))
        for m in _CARD.finditer(r):
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                spans.append((lo + m.start(), 2, lo + m.end()))
        for m in _PHONE.finditer(r):
            if 10 <= len(_digits(m[0])) <= 15:
                spans.append((lo + m.start(), 3, lo + m.end()))
    return sorted(spans), regions


FEATURES = ("always", "at", "domain", "dots", "small_parts", "plus", "luhn", "grouped", "under_10", "under_14", "under_20", "longer", "letters")
#: Features that stay when a node is seen without what decides its kind.
WEAK = sum(1 << FEATURES.index(f) for f in ("always", "at", "letters"))


def features(s: str) -> int:
    d = _digits(s)
    parts = s.split(".")
    on = {
        "always": True,
        "at": "@" in s,
        "domain": "@" in s and bool(_DOMAIN.fullmatch(s[s.rfind("@") + 1 :])),
        "dots": len(parts) == 4 and all(p.isdigit() for p in parts),
        "small_parts": len(parts) == 4 and all(len(p) < 4 and p.isdigit() and int(p) < 256 for p in parts),
        "plus": s.startswith("+"),
        "luhn": 14 <= len(d) <= 19 and luhn(d),
        "grouped": any(c in s for c in " ()-"),
        "under_10": len(d) < 10,
        "under_14": 10 <= len(d) < 14,
        "under_20": 14 <= len(d) < 20,
        "longer": len(d) >= 20,
        "letters": any(c.isalpha() for c in s),
    }
    return sum(1 << i for i, f in enumerate(FEATURES) if on[f])


def keys(s: str, kind: int) -> list[str]:
    """What else names the same thing: its text, digits, last digits, local part."""
    d = _digits(s)
    if "@" in s or kind == 0:
        return [s.casefold(), s.partition("@")[0].casefold()]
    if s.count(".") == 3:
        return [s]
    return [s, d, d[-7:]] if len(d) >= 7 else [s.casefold()]


def nodes(text: str, spans: list, regions: list) -> list[tuple[int, int, int]]:
    """(start, end, label) of the field's nodes in order; label 0 is none yet,
    1 + kind is observed. A span that overlaps one before it is no node."""
    out, end = [], 0
    for s, k, e in spans:
        if s >= end:
            out.append((s, e, k + 1))
            end = e
    taken = sorted((s, e) for s, _, e in spans)
    loose = []
    for lo, hi in regions:
        loose += [(lo + m.start(), lo + m.end()) for m in _LOOSE.finditer(text[lo:hi]) if len(_digits(m[0])) >= 7]
    if "@" in text:
        loose += [m.span() for m in _AT_WORD.finditer(text)]
        local = {text[s:e].partition("@")[0] for s, k, e in spans if k == 0}
        local = {x for x in local if len(x) >= 6 and _DIGIT.search(x)}
        if local:
            loose += [m.span() for m in _LOCAL.finditer(text) if m[0].rstrip(".") in local]
    i, last = 0, 0
    for s, e in sorted(loose):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= last and not (i < len(taken) and taken[i][0] < e):
            out.append((s, e, 0))
            last = e
    return sorted(out)


def edges(text: str, ns: list[tuple[int, int, int]]) -> tuple[list, list]:
    """(chain, skip) pairs of node numbers."""
    chain = [(i, i + 1) for i in range(len(ns) - 1)]
    named: dict[str, list[int]] = {}
    names = [set(keys(text[s:e].rstrip("."), label - 1)) for s, e, label in ns]
    for i, ks in enumerate(names):
        for k in ks:
            named.setdefault(k, []).append(i)
    skip = {p for same in named.values() for p in pairwise(same)}
    reached = {i for i, n in enumerate(ns) if n[2]}
    fresh, done = reached, set()
    while fresh:  # a key at a time, from the base spans on
        found = set()
        for k in {k for i in fresh for k in names[i]} - done:
            done.add(k)
            near = [i for i in named[k] if i in reached]
            for i in named[k]:
                if i not in reached:
                    at = bisect(near, i)
                    j = min(near[max(at - 1, 0) : at + 1], key=lambda j: (abs(ns[j][0] - ns[i][0]), j))
                    skip.add((min(i, j), max(i, j)))
                    found.add(i)
        reached, fresh = reached | found, found
    return chain, sorted(skip)


@dataclass
class Field:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray


def _bits(x: np.ndarray) -> np.ndarray:
    return (x[:, None] >> np.arange(len(FEATURES)) & 1).astype(float)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def learn(rows: list[tuple], steps: int = 400, l2: float = 1e-3) -> Field:
    """Pseudo-likelihood over (features, label, neighbours' labels by edge kind,
    count) rows, by Adagrad over all of them."""
    n = len(KINDS) + 1
    model = Field(np.zeros((len(FEATURES), n)), np.zeros((n, n)), np.zeros((n, n)))
    if not rows:
        return model
    x = _bits(np.array([r[0] for r in rows]))
    y = np.eye(n)[[r[1] for r in rows]]
    chain, skip = (np.array([r[c] for r in rows], float).reshape(-1, n) for c in (2, 3))
    w = np.array([r[4] for r in rows], float)
    w /= w.sum()
    parts = [model.unary, model.chain, model.skip]
    inputs = [x, chain, skip]
    sums = [np.full_like(p, 1e-8) for p in parts]
    for _ in range(steps):
        err = (_softmax(x @ model.unary + chain @ model.chain + skip @ model.skip) - y) * w[:, None]
        for p, s, i in zip(parts, sums, inputs, strict=True):
            g = i.T @ err + l2 * p * w.mean()
            if p is not model.unary:
                g = g + g.T  # one potential for both directions
            s += g * g
            p -= 0.3 * g / np.sqrt(s)
    return model


def kinds_in_reach(label: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """nodes x labels: a candidate may have no kind, or one that is observed
    among the mentions its skip edges lead to. Left to themselves, two equal dates
    pass for phone numbers and a version number for an address: a document that
    names nothing in full has nothing that its mentions could be consistent with."""
    n = len(KINDS) + 1
    out = np.zeros((len(label), n), bool)
    out[:, 0] = True
    out[np.arange(len(label)), label] = True
    root = list(range(len(label)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in skip.tolist():
        root[find(int(a))] = find(int(b))
    top = np.array([find(i) for i in range(len(label))], int)
    joint = np.zeros_like(out)
    np.logical_or.at(joint, top, out)
    return joint[top]


def marginals(model: Field, x: np.ndarray, label: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Loopy belief propagation; observed labels are fixed."""
    n = len(KINDS) + 1
    local = np.where(kinds_in_reach(label, skip), _bits(x) @ model.unary, -50.0)
    seen = label > 0
    local[seen] = -50.0
    local[seen, label[seen]] = 0.0
    if not len(chain) + len(skip):
        return _softmax(local)
    pairs = np.concatenate([chain, skip]).astype(int)
    potential = np.concatenate([np.broadcast_to(model.chain, (len(chain), n, n)), np.broadcast_to(model.skip, (len(skip), n, n))])
    a, b = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    m = np.zeros((len(a), n))
    for _ in range(SWEEPS):
        belief = local.copy()
        np.add.at(belief, b, m)
        z = (belief[a] - m[back])[:, :, None] + potential
        top = z.max(axis=1)
        new = top + np.log(np.exp(z - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        m = DAMPING * m + (1 - DAMPING) * new
    belief = local.copy()
    np.add.at(belief, b, m)
    return _softmax(belief)


def _sample_rows(texts: list[str]) -> Counter:
    n, out = len(KINDS) + 1, Counter()
    for t in texts:
        spans, regions = base_spans(t)
        ns = nodes(t, spans, regions)
        near = [[0] * (2 * n) for _ in ns]
        for at, es in zip((0, n), edges(t, ns), strict=True):
            for i, j in es:
                near[i][at + ns[j][2]] += 1
                near[j][at + ns[i][2]] += 1
        for (s, e, label), c in zip(ns, near, strict=True):
            f = features(t[s:e])
            c = tuple(c)
            out[f, label, c] += 1
            out[f & WEAK, label, c] += 1
    return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Learn the field from a bounded sample of documents."""
    ids = docs.filter("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` ids: bounded whatever the corpus
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(materialize(ids, "pii-sample")), "doc_id").select("text")

    def count(batches):
        total = Counter()
        for b in batches:
            total.update(_sample_rows([t or "" for t in b.column(0).to_pylist()]))
        rows = [(f, y, list(c), k) for (f, y, c), k in total.items()]
        cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["f", "y", "near", "k"])

    counted = texts.mapInArrow(count, "f int, y int, near array<int>, k long").groupBy("f", "y", "near").agg(F.sum("k").alias("k")).collect()
    n = len(KINDS) + 1
    return learn(sorted((r["f"], r["y"], tuple(r["near"][:n]), tuple(r["near"][n:]), r["k"]) for r in counted))


def find(texts: list[str], model: Field) -> list[tuple[list, list]]:
    """Base and added spans (start, kind, end) of each text."""
    based, x, label, owner, chain, skip = [], [], [], [], [], []
    where = []
    for t in texts:
        spans, regions = base_spans(t) if _DIGIT.search(t) or "@" in t else ([], [])
        ns = nodes(t, spans, regions) if regions or spans or "@" in t else []
        based.append(spans)
        if any(not k for _, _, k in ns):
            c, s = edges(t, ns)
            chain += [(i + len(x), j + len(x)) for i, j in c]
            skip += [(i + len(x), j + len(x)) for i, j in s]
            owner += [len(based) - 1] * len(ns)
            where += ns
            x += [features(t[a:b]) for a, b, _ in ns]
            label += [k for _, _, k in ns]
    added: list[list] = [[] for _ in texts]
    if x:
        label = np.array(label)
        p = marginals(model, np.array(x), label, np.array(chain).reshape(-1, 2), np.array(skip).reshape(-1, 2))
        kind = p.argmax(axis=1)
        for i in np.flatnonzero((label == 0) & (kind > 0) & (p.max(axis=1) > CERTAIN)):
            added[owner[i]].append((where[i][0], int(kind[i]) - 1, where[i][1]))
    return list(zip(based, added, strict=True))


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def personal_data(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans and n_added of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs) if model is None else model)
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                found = find([t or "" for t in s.column(1).to_pylist()], shared.value)
                counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(len(KINDS))]
                sha = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
                cols = [*[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array([_joined(base + more) for base, more in found], pa.string()), pa.array([len(more) for _, more in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([s.column(0), *cols], names)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
