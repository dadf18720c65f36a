"""MinHash near-deduplication with tensored banding.

A text's set is its distinct shingles of five words (64-bit hashes). Instead of
``SIDE ** 2`` independent tables of four minhashes, two small collections of
``SIDE`` sub-keys (pairs of minhashes) are computed, and table (i, j) is keyed by
the i-th sub-key of the first and the j-th of the second: 32 minhashes serve 64
tables. A pair of similarity s shares a table with probability
``(1 - (1 - s**2) ** SIDE) ** 2``: 0.99993 at 0.85, 0.9999995 at 0.92.

1. Signatures: one pass over the texts; equal sets (128-bit digest) form a class,
   whose smallest doc_id stands for it from here on.
2. Only sub-keys that two classes share can lead to a shared table, so tables are
   keyed from those alone. Tables with the same members are looked at once.
3. Rounds. In each table that still spans several components a few members become
   pivots, and every member of another component is compared with them: first by
   sizes and a bound on the sets' difference, then on the full sets. Verified links
   join components. A table is finished once it lies in one component or all but
   one of its members have been pivots, so every candidate pair is either compared
   or already joined. A member meets about ``WHOLE`` pivots of a table in a round
   (more in later rounds, which few tables reach), whatever the table's size.
   Larger tables still open after two rounds hold mostly unlike members (texts that
   share a common line); they are split, without loss, by their members' rarest
   shingles, one of which any similar pair shares. A pair is a candidate only if
   it shares a table of the banding, in the split ones too.
4. Components by alternating large-star and small-star steps.

Everything is a table in the shared folder; no documents, links or components
are collected. Texts are dealt once, by doc_id; the sets made of them lie in
buckets, so that rounds move pairs, and of each pair one set. A table, class or component of any size is aggregated with
map-side combining and joined by keys that adaptive execution can split.

Defined cases: a text without words has an empty set, links with nothing and is
its own component; fewer than five words are one shingle; null doc_ids link with
nothing and have a null component and kept; rows repeating a doc_id are judged
by their own texts, equal rows alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernel as K
from .common import bucketed, discard, fresh_name, lean, materialize

SHINGLE = 5
#: 100 * intersection >= PERCENT * union, unless the caller says otherwise.
PERCENT = 85
#: Sub-keys in each of the two collections.
SIDE = 8
#: Minhashes in a sub-key.
WIDTH = 2
#: 64-bit words of parity bits kept with a set.
PARITY_WORDS = 16

_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1, 2**63, 2 * SIDE * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their counts before it."""
    low = K.LOWER[raw]
    start, end, first = K.words(low, offsets, K.NOT_SPACE)
    return K.distinct_per_text(*K.shingles(K.word_hashes(low, start, end), first, SHINGLE))


def _per_text(ufunc, values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """ufunc over each text's values; 0 where it has none."""
    out = np.zeros(len(before) - 1, np.uint64)
    some = np.flatnonzero(np.diff(before))
    if len(some):
        out[some] = ufunc.reduceat(values, before[some])
    return out


def _signatures(docs: DataFrame) -> DataFrame:
    names = ["doc_id", "n_shingles", "d1", "d2", *[f"k{i}" for i in range(2 * SIDE)]]

    def run(batches):
        for b in batches:
            raw, offsets = K.text_bytes(b.column(1))
            for i, j in K.blocks(offsets):
                v, before = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cols = [np.diff(before).astype(np.uint64), _per_text(np.add, K.mix64(v), before), _per_text(np.add, K.mix64(v ^ K.STEP), before)]
                for s in range(2 * SIDE):
                    key = np.zeros(j - i, np.uint64)
                    for w in range(WIDTH):
                        h = v * _MULTIPLIERS[s * WIDTH + w]
                        h ^= h >> np.uint64(32)
                        h *= K.STEP
                        key = K.mix64(key * K.BASE + _per_text(np.minimum, h, before))
                    cols.append(key)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *[pa.array(c.view(np.int64)) for c in cols]], names)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, size, parities and set (sorted 64-bit values) of the documents in
    ``ids`` (doc_id)."""

    def run(batches):
        for b in batches:
            raw, offsets = K.text_bytes(b.column(1))
            for i, j in K.blocks(offsets):
                v, before = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(v.view(np.int64)))
                parity = parities(v, np.repeat(np.arange(j - i), np.diff(before)), j - i)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * PARITY_WORDS, pa.int32()), pa.array(parity))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(before), pa.int64()), bits, lists], ["doc_id", "n", "parity", "set"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the only time that texts move, and alike at every size
    return d.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(lean(run), "doc_id long, n long, parity array<long>, set array<long>")


def parities(values: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Of each text PARITY_WORDS words of bits: whether an odd number of its
    values fall on the bit. Two sets differ by at least the bits in which these
    differ, which is a bound, not an estimate."""
    out = np.zeros(texts * PARITY_WORDS, np.int64)
    bit = (K.mix64(values ^ K.BASE) >> np.uint64(32)).astype(np.int64) % (64 * PARITY_WORDS)
    np.bitwise_xor.at(out, text * PARITY_WORDS + bit // 64, np.left_shift(np.int64(1), bit % 64))
    return out


def _apart(x: str, y: str):
    """At least so many values are in one of two sets only."""
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(PARITY_WORDS)), F.lit(0))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough. Sets lie dealt by
    doc_id, so the pairs go to them first, then with one set each to the other."""

    def run(batches):
        for b in batches:
            keep = []
            (xs, xo), (ys, yo) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (b.column(2), b.column(3)))
            for k in range(b.num_rows):
                a, c = xs[xo[k] : xo[k + 1]], ys[yo[k] : yo[k + 1]]
                both = len(np.intersect1d(a, c, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(a) + len(c) - both))
            kept = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], ["x", "y"])

    # a pivot may be in very many pairs: those go to as many copies of its set as needed
    per = pairs.groupBy("y").agg(F.ceil(F.count("*") / CROWD).alias("copies"))
    hot = materialize(per.filter("copies > 1"), "nd-hot", few=True)
    x = sets.select(F.col("doc_id").alias("x"), F.col("set").alias("set_x"))
    salted = pairs.join(hot, "y", "left").withColumn("salt", F.pmod(F.xxhash64("x"), F.coalesce("copies", F.lit(1))))
    y = sets.join(per.withColumnRenamed("y", "doc_id").hint("merge"), "doc_id")
    y = y.select(F.col("doc_id").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"), F.col("set").alias("set_y"))
    both = salted.select("x", "y", "salt").hint("merge").join(x, "x").hint("merge").join(y, ["y", "salt"])
    return both.select("x", "y", "set_x", "set_y").mapInArrow(lean(run), "x long, y long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(x, y) -> (node, component): the smallest node reachable. Only nodes with
    an edge, and other than their component, are listed."""
    e = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "nd-components", few=True)
        if last is not None:
            discard(last)
        last = e
        # done when every node hangs on one root that hangs on nothing
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        loose = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("root")).filter("ups > 1 OR (ups = 1 AND root = 0)")
        if loose.isEmpty():
            named = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            named._halyard_path = e._halyard_path
            return named


def _tables(reps: DataFrame) -> DataFrame:
    """(t, rep, n): the members of each table with at least two, every set of
    members once."""
    rows = reps.select("rep", "n", F.explode(_sub_keys()).alias("e")).select("rep", "n", "e.side", "e.k")
    shared = rows.groupBy("k").agg(F.count("*").alias("c")).filter("c > 1").select("k")
    live = rows.join(shared, "k").groupBy("rep", "n").agg(*[F.collect_list(F.when(F.col("side") == s, F.col("k"))).alias(f"side{s}") for s in (0, 1)])
    pairs = F.flatten(F.transform("side0", lambda a: F.transform("side1", lambda b: F.xxhash64(a, b))))
    return _once(live.select("rep", "n", F.explode(pairs).alias("t")))


def _sub_keys():
    return F.array(*[F.struct(F.lit(s // SIDE).alias("side"), F.xxhash64(F.lit(s), F.col(f"k{s}")).alias("k")) for s in range(2 * SIDE)])


def _once(keyed: DataFrame) -> DataFrame:
    """The rows of tables with two members or more; of tables with the same
    members one is kept."""
    keyed = materialize(keyed, "nd-keyed")
    of = keyed.groupBy("t").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("mark"), F.min("rep").alias("low"), F.max("rep").alias("high")).filter("c > 1")
    once = of.groupBy("c", "mark", "low", "high").agg(F.min("t").alias("t")).select("t")
    members = materialize(keyed.join(once, "t").select("t", "rep", "n"), "nd-members")
    discard(keyed)
    return members


def _prefix_tables(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Splits tables whose members are mostly unlike each other, without loss.

    Two sets that are similar enough share one of their rarest shingles: with
    the shingles of each set ordered by frequency, one of the first
    ``n - ceil(n * percent / 100) + 1``. Those shingles key the parts."""
    ids = members.select(F.col("rep").alias("doc_id"), "n").distinct()
    rows = sets.join(ids.hint("merge"), ["doc_id", "n"]).select(F.col("doc_id").alias("rep"), "n", F.explode("set").alias("t"))
    often = rows.groupBy("t").agg(F.count("*").alias("often"))
    place = F.row_number().over(W.partitionBy("rep", "n").orderBy("often", "t"))
    ranked = rows.join(often, "t").withColumn("place", place)
    need = F.floor((F.col("n") * percent + 99) / 100)
    return _once(ranked.filter((F.col("place") <= F.col("n") - need + 1) & (F.col("often") > 1)).select("rep", "n", "t"))


def _banded(x: str, y: str):
    """Two members share a table of the banding: a sub-key on either side."""
    sides = [F.arrays_overlap(F.slice(x, 1 + s * SIDE, SIDE), F.slice(y, 1 + s * SIDE, SIDE)) for s in (0, 1)]
    return sides[0] & sides[1]


#: In the first round a table has one pivot. Later on, tables with up to WHOLE
#: members that were none yet make pivots of all of them. Larger ones are split by
#: their members' rarest shingles after the second round, and then have about
#: WHOLE pivots, chosen by hash, and GROWTH times as many each round after.
WHOLE, GROWTH, SPLIT_AT = 16, 4, 2
#: Bytes of sets in a bucket, about, and buckets at most.
BUCKET_BYTES, BUCKETS = 16 << 20, 100_000
#: Pairs of a pivot that go to one copy of its set, about.
CROWD = 256


def links(docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes that are not their component's smallest."""
    spark = docs.sparkSession
    first_tables = tables = _tables(reps)
    ids = tables.select("rep", "n").distinct()
    volume = (ids.agg(F.sum("n")).first()[0] or 0) * 8
    buckets = min(BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(volume) // BUCKET_BYTES)))
    sets = bucketed(_sets(docs, ids.select(F.col("rep").alias("doc_id")).distinct()), "nd-sets", "doc_id", buckets)
    # what a member carries into pairs: its parities, and its sub-keys in the order of the collections
    carried = sets.select(F.col("doc_id").alias("rep"), "n", "parity")
    carried = carried.join(reps.select("rep", "n", F.transform(_sub_keys(), lambda e: e["k"]).alias("keys")), ["rep", "n"])
    carried = materialize(carried, "nd-carried")
    tables = tables.join(carried, ["rep", "n"]).withColumn("was", F.lit(False))
    comps = spark.range(0).selectExpr("id AS node", "id AS component")
    tested = spark.range(0).selectExpr("id AS x", "id AS y")
    turn, picks, past = 0, WHOLE, [first_tables]
    while True:
        m = tables.join(comps, tables["rep"] == comps["node"], "left").select("t", "rep", "n", "parity", "keys", "was", F.coalesce("component", "rep").alias("comp"))
        fresh = F.when(~F.col("was"), F.col("rep"))
        state = m.groupBy("t").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(fresh).alias("left"), F.min(fresh).alias("first"))
        state = materialize(state.filter("low < high AND left > 1").select("t", "left", "first"), "nd-open", few=True)
        if state.isEmpty():
            discard(state, sets, carried, *past)
            return comps
        chosen = F.col("rep") == F.col("first")
        if turn == 1:
            chosen = F.col("left") <= WHOLE
        elif turn > SPLIT_AT:
            chosen |= F.pmod(F.xxhash64("rep", F.lit(turn)), F.ceil(F.col("left") / picks)) == 0
            picks *= GROWTH
        m = m.join(state, "t").select("t", "rep", "n", "parity", "keys", "was", "comp", (~F.col("was") & chosen).alias("now"))
        m = materialize(m, "nd-split")
        discard(state, *past)
        past = [m]
        turn += 1
        if turn == SPLIT_AT + 1:
            parts = _prefix_tables(m, sets, percent)
            past.append(parts)
            tables = parts.join(carried, ["rep", "n"]).withColumn("was", F.lit(False))
            continue
        y = m.filter("now").select("t", F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("parity").alias("py"), F.col("keys").alias("ky"), F.col("comp").alias("cy"))
        # similarity p needs sizes in that ratio, and at most (1 - p) / (1 + p) of
        # both sizes in one set only
        alike = 100 * F.least("n", "ny") >= percent * F.greatest("n", "ny")
        near = _apart("parity", "py") * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("ny"))
        pairs = m.join(y, "t").filter((F.col("comp") != F.col("cy")) & alike & near & _banded("keys", "ky"))
        pairs = pairs.select(F.greatest("rep", "y").alias("x"), F.least("rep", "y").alias("y")).distinct()
        pairs = materialize(pairs.join(tested, ["x", "y"], "left_anti"), "nd-pairs")
        found = materialize(_linked(pairs, sets, percent), "nd-links", few=True)
        tested = tested.unionByName(pairs)
        if not found.isEmpty():
            joined = components(comps.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(found))
            discard(comps)
            comps = joined
        discard(found)
        tables = m.select("t", "rep", "n", "parity", "keys", (F.col("was") | F.col("now")).alias("was"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    sigs = materialize(_signatures(docs), "nd-signatures")
    some = sigs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    one = ["d1", "d2", "n_shingles"]
    reps = some.groupBy(*one).agg(F.min("doc_id").alias("rep"), *[F.first(f"k{i}").alias(f"k{i}") for i in range(2 * SIDE)])
    reps = materialize(reps.withColumn("n", F.col("n_shingles")), "nd-classes")
    comps = links(docs, reps, percent)
    named = reps.select(*one, "rep").join(comps, F.col("rep") == F.col("node"), "left").select(*one, F.coalesce("component", "rep").alias("component_id"))
    out = sigs.select("doc_id", *one).join(named.select(*[F.col(c).alias(f"_{c}") for c in one], "component_id"), [F.col(c) == F.col(f"_{c}") for c in one], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one of the smallest doc_id, with all
    columns, whatever their names; rows without a doc_id stay."""
    gone = fresh_name("gone", docs.columns)
    dropped = near_duplicates(docs.select("doc_id", "text"), percent).filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
