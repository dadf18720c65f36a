"""Mixing sources to target weights by Efraimidis-Spirakis sampling (native).

Every document gets the exponential key ``-ln(u) / weight``: ``u`` is a uniform
number derived from its doc_id and text (so reruns agree), ``weight`` its quality weight.
Sorted by that key within its source, a document is taken while the running sum
of sizes stays below the source's token budget. Where a budget exceeds the
source, complete epochs come first and only the rest is selected by key.

The running sum is a radix tree rather than one window per source: a key maps
monotonically to ``g`` in [0, 1), whose first 8 and 16 bits name an upper and a
lower bin. Sums over bins are prefix-summed (at most 256 rows to a window), and
only the rows of one lower bin are ever sorted together, so a source that holds
a third of all rows spreads over 65,536 tasks' worth of keys.

Defined cases: null text has size 0; null source is a source of its own, ordered
last; a row's key is drawn from its doc_id and text, so rows that share a doc_id,
or have none, are documents of their own (fully equal rows tie and are
interchangeable: :func:`mix_documents` takes all of them or none); an empty table
gives an empty result; a source whose documents are all empty has target 0. Other
columns are ignored, or kept whatever their names by :func:`mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_name, materialize

#: Weights of the sources in code-point order, repeating.
SOURCE_WEIGHTS = (5, 2, 1)
#: Words to draw, as a share of all words.
TOTAL_SHARE = 1.5
#: No source is repeated more often than this.
MAX_EPOCHS = 2

SPACES = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null counts 0."""
    parts = F.split(text, SPACES)
    n = F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - (F.element_at(parts, -1) == "").cast("int")
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.greatest(n, F.lit(0))).cast("long")


def quality_weight(chars: Column, size: Column) -> Column:
    """Half for texts whose mean word length is not that of prose, three
    quarters for very short texts; between 0.375 and 1."""
    mean = chars / F.greatest(size, F.lit(1))
    return F.when((mean >= 4) & (mean <= 13), 1.0).otherwise(0.5) * F.when(size >= 16, 1.0).otherwise(0.75)


def es_key(doc_id: Column, text: Column, weight: Column, seed: str = "mix") -> Column:
    """Exponential key, ascending: heavier documents tend to come first. The text
    is part of it, so rows without a doc_id, or of one, have keys of their own."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / F.lit(float(2**52 + 1))
    return -F.log(u) / weight


def _sized(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    d = docs.select("doc_id", "source", word_count(text).alias("size"), F.coalesce(F.length(text), F.lit(0)).alias("chars"), text.alias("text"))
    return d.withColumn("key", es_key(F.col("doc_id"), F.col("text"), quality_weight(F.col("chars"), F.col("size")))).drop("text")


def source_targets(sizes: DataFrame, weights=SOURCE_WEIGHTS, share: float = TOTAL_SHARE, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with target: water-filling in closed form.

    A source is full iff the level at which it fills, ``cap / weight``, costs no
    more than the total; the rest share what remains by weight. The windows run
    over one row per source.
    """
    every = W.partitionBy(F.lit(0))
    turn = (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("w"))
    by = every.orderBy("level", F.col("source").asc_nulls_last())
    s = s.withColumn("below", F.sum("cap").over(by) - F.col("cap"))
    s = s.withColumn("open_w", F.sum("w").over(every) - F.sum("w").over(by) + F.col("w"))
    s = s.withColumn("total", F.lit(share) * F.sum("source_size").over(every))
    s = s.withColumn("full", F.col("below") + F.col("level") * F.col("open_w") <= F.col("total"))
    held = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)
    wide = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every)
    shared = (F.col("total") - held) / F.greatest(wide, F.lit(1)) * F.col("w")
    target = F.round(F.when(F.col("full"), F.col("cap").cast("double")).otherwise(shared), 6)
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the row's place in its
    source's order: ``start_words`` (words before it) and ``key``."""
    d = materialize(_sized(docs), "mix-sized")
    g = 1 - F.exp(-F.col("key"))
    d = d.withColumn("bin", F.least(F.floor(g * 65536), F.lit(65535)).cast("int"))
    low = d.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    low = low.withColumn("top", F.shiftright("bin", 8))
    high = low.groupBy("source", "top").agg(F.sum("bin_size").alias("top_size"))
    targets = source_targets(high.groupBy("source").agg(F.sum("top_size").alias("source_size")))
    high = high.withColumn("top_start", F.sum("top_size").over(W.partitionBy("source").orderBy("top")) - F.col("top_size"))
    high = _null_safe(high, targets, ["source"])
    low = low.withColumn("in_top", F.sum("bin_size").over(W.partitionBy("source", "top").orderBy("bin")) - F.col("bin_size"))
    low = _null_safe(low, high, ["source", "top"]).withColumn("bin_start", F.col("top_start") + F.col("in_top"))
    d = _null_safe(d, low.select("source", "bin", "bin_start", "source_size", "target"), ["source", "bin"])
    order = W.partitionBy("source", "bin").orderBy("key", "doc_id", "size", "chars").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("start_words", F.col("bin_start") + F.sum("size").over(order) - F.col("size"))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start_words")))
    return d.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "source", "key", "chars", "start_words", epochs.alias("epochs"), rest.alias("rest"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys meet; the key columns stay single."""
    r = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for k in keys:
        term = left[k].eqNullSafe(r[f"_r_{k}"])
        on = term if on is None else on & term
    return left.join(r, on, "inner").drop(*[f"_r_{k}" for k in keys])


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed documents: each row once per epoch and once more where the
    selection reaches it, with the columns of ``docs``. Texts stay whole: the
    document on which a source's budget ends is written in full.

    Rows are found by their source's last selected key, a table of one row per
    source, so texts are never shuffled by it while that table is small enough
    for Spark's own size-checked broadcast; beyond it the join is a shuffle
    whose skewed sources adaptive execution splits.
    """
    m = mix(docs)
    ends = m.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("start_words") < F.col("rest"), F.struct("key", "doc_id"))).alias("end"))
    names = {}
    for c in ("epochs", "end", "size", "key", "copy", "mixed"):
        names[c] = fresh_name(c, [*docs.columns, *names.values()])
    ends = materialize(ends.select(F.col("source").alias(names["mixed"]), F.col("epochs").alias(names["epochs"]), F.col("end").alias(names["end"])), "mix-ends")
    text, doc_id, size = F.col("text").cast("string"), F.col("doc_id"), F.col(names["size"])
    d = docs.withColumn(names["size"], word_count(text))
    d = d.withColumn(names["key"], es_key(doc_id, text, quality_weight(F.coalesce(F.length(text), F.lit(0)), size)))
    d = d.join(ends, F.col("source").eqNullSafe(F.col(names["mixed"])))
    picked = F.coalesce(F.struct(F.col(names["key"]).alias("key"), doc_id.alias("doc_id")) <= F.col(names["end"]), F.lit(False)) & (size > 0)
    copies = (F.when(size > 0, F.col(names["epochs"])).otherwise(0) + picked.cast("long")).cast("int")
    return d.withColumn(names["copy"], F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(text), 0) AS chars, md5(coalesce(text, '')) AS digest,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '') || digest), 1, 13))::BIGINT + 1) / 4503599627370497.0::DOUBLE)
    / ((CASE WHEN chars::DOUBLE / greatest(size, 1) BETWEEN 4 AND 13 THEN 1.0 ELSE 0.5 END)::DOUBLE
       * (CASE WHEN size >= 16 THEN 1.0 ELSE 0.75 END)::DOUBLE) AS key
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY source),
l AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / w AS level FROM s),
f AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total,
    (coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    + level * (sum(w) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE
    <= 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS filled
  FROM l),
t AS (
  SELECT source, source_size, round(CASE WHEN filled THEN cap::DOUBLE ELSE
    (total - (sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ())::DOUBLE)
    / greatest((sum(CASE WHEN filled THEN 0 ELSE w END) OVER ())::DOUBLE, 1) * w END, 6) AS target
  FROM f),
b AS (SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
o AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
    (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size, k.chars ROWS UNBOUNDED PRECEDING) - k.size)::BIGINT AS start_words
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - start_words)))::BIGINT AS taken FROM o
"""
