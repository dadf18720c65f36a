"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``. :func:`run` writes
each stage's rows to the shared folder and gives them, read back, to the next, so
a lost executor costs one stage's tasks at most.

A document that mixing takes for more than one epoch is as many rows of its
output, and so is encoded as often by the last stage.

Defined cases. Null and empty texts pass toxicity at the model's bias, are near
nothing and unaffected; mixing takes no document without words, so the last stage
never sees them. Rows without a doc_id stay in every stage (near-duplicates are
told by doc_id) and are encoded first. Rows that repeat a doc_id stand or fall
with it in the near-duplicate stage and are rows of their own elsewhere. Ties are
broken by doc_id, then by content. Empty tables give an empty result; without a
benchmark nothing is dropped for it. Further columns, whatever their names, pass
all stages but the last, which returns its own four.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from halyard.llm import decontaminate, mixing, near_dup, token_binary, toxicity
from halyard.llm.common import discard, materialize, read


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return near_dup.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any verbatim match with a benchmark item: a short passage
    in a long text would be trained on as well, so there is no least share here."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), share=None)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: sources near their target weights, epochs as repeated rows."""
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_binary.token_binary(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("token_binary", token_stage),
]

#: A model, similarity components and a tokenizer are not SQL; the tests hold
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
