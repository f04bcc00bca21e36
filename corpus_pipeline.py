"""A corpus pipeline of five stages: each reads what the one before it kept, and its decisions take effect.

The stages are written as Parquet between each other, so a lost executor costs no more than its own tasks. Null and
empty texts pass all of them (as one near-duplicate group), null ids and repeated rows are kept until near-duplicates
go, further columns may have any names, and empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vexilar.llm import decontaminate, pii, sentencepiece_ops, simhash, toxicity
from vexilar.session import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores below their language's cut."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them replaced by its kind."""
    return pii.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, round_trip, samples): the pieces of every text and two sampled segmentations.

    Workers that earlier stages have used hold memory, so fewer stretches are kept than by the operator alone.
    """
    return sentencepiece_ops.encode_and_sample(docs, kept=40_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("pii", redact_private),
    ("sentencepiece", encode),
]

#: The classifier and the sampler can't be expressed in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
