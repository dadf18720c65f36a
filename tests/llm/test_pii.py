import hashlib
import itertools
import re

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    """The contract's patterns, as written."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab.@-+ ()0125é\n", max_size=40))
def test_base_spans_random(t):
    assert pii.base_spans(t)[0] == brute(t)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111-1111 1111", "10.0.0.1", "1.2.3.999", "+1 (743) 555-3824", "a.b@c-d.ex", "@", ".", " ", "-", "+", "1", "23", "x", "(", ")"]), max_size=9))
def test_base_spans_pieces(parts):
    t = "".join(parts)
    assert pii.base_spans(t)[0] == brute(t)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_corpus(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    for i, text in zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True):
        want = brute(text)
        r = out[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == n for _, x, _ in want) for n in range(4)]
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(","))


def _corpus():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        d = [int(x) for x in rng.integers(0, 10, 10)]
        n = "".join(map(str, d))
        phone = f"+1 ({n[:3]}) {n[3:6]}-{n[6:]}"
        mail = f"user.{n[:4]}@mail.example.com"
        ip = f"10.{d[0]}.{d[1]}.{d[2]}"
        rows.append((i, f"call {phone} or {phone} soon. write {mail}, {mail}. host {ip} and {ip} in {n[:4]}; order 20{n[2:]}{n[:3]} done", "x"))
    return rows


def test_distant_mentions_are_labelled(spark):
    rows = _corpus()
    t = "reach me: +1 (743) 555-3824 please" + " filler" * 300 + " again (743) 555-3824 thanks. order 2098765412 and user.4321 alone"
    rows += [(1000, t, "x"), (1001, "only 5553824 and 743 555 3824 stand here", "x"), (1002, "mail user.4321@mail.example.com then the user.4321 account", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    s = t.rindex("(743)")
    assert f"phone:{s}:{s + 14}" in out[1000]["spans"].split(",") and out[1000]["n_added"] == 1 and out[1000]["n_phone"] == 1
    assert out[1001]["spans"] == ""
    assert out[1002]["n_added"] == 1 and out[1002]["n_email"] == 1
    assert sum(out[i]["n_added"] for i in range(400)) == 0


def test_repeats_do_not_hide_the_base_span(spark):
    for form, base in (("(743) 555-3824", "+1 (743) 555-3824"), ("user.4321", "user.4321@mail.example.com")):
        side = f" then {form} again" * 30
        t = f"first{side} and {base} now{side} end"
        docs = spark.createDataFrame([*_corpus(), (1000, t, "x")], "doc_id long, text string, spans string")
        r = pii.personal_data(docs).filter("doc_id = 1000").first()
        assert r["n_added"] == 60 and r["n_phone"] + r["n_email"] == 1


def test_propagation_equals_enumeration_on_trees():
    rng = np.random.default_rng(3)
    n = len(pii.KINDS) + 1
    model = pii.Field(rng.normal(size=(len(pii.FEATURES), n)), *(m + m.T for m in rng.normal(size=(2, n, n))))
    for label in ([0, 2, 0, 0], [1, 0, 0, 2]):
        label, x = np.array(label), rng.integers(1, 1 << len(pii.FEATURES), 4)
        chain, skip = np.array([(0, 1), (1, 2)]), np.array([(1, 3)] if label[1] else [(0, 3)])
        allowed = pii.kinds_in_reach(label, skip)
        weight = np.zeros((4, n))
        for y in itertools.product(range(n), repeat=4):
            if any(label[i] not in (0, y[i]) or not allowed[i, y[i]] for i in range(4)):
                continue
            z = sum((pii._bits(x[i : i + 1]) @ model.unary)[0, y[i]] for i in range(4) if not label[i])
            z += sum(model.chain[y[a], y[b]] for a, b in chain) + sum(model.skip[y[a], y[b]] for a, b in skip)
            weight[range(4), y] += np.exp(z)
        want = weight / weight.sum(axis=1, keepdims=True)
        assert np.abs(pii.marginals(model, x, label, chain, skip) - want).max() < 0.01


def test_edges_reach_every_mention():
    t = "a 743 555 3824 " * 200 + "b +1 (743) 555-3824 c " + "d 5553824 " * 200
    spans, regions = pii.base_spans(t)
    ns = pii.nodes(t, spans, regions)
    base = next(i for i, n in enumerate(ns) if n[2])
    skip = pii.edges(t, ns)[1]
    assert len(ns) == 401 and all((min(i, base), max(i, base)) in skip for i in range(len(ns)) if i != base)
    assert len(skip) < 4 * len(ns)


def test_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a@b.co", "x"), (3, "1" * 200_000, "x"), (4, "a" * 200_000 + "@", "x"), (4, "a@b.co " * 3000, "x"), (5, "1.2.3.4 " * 3000, "x")]
    out = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(out) == 7 and sum(r["n_email"] for r in out) == 3001 and sum(r["n_ip"] for r in out) == 3000
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
