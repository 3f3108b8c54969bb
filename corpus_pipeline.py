"""The training-data pipeline: five stages over `documents`, each one operator of offerscope.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Near duplicates link at five words and a Jaccard similarity of 0.8.

Defined results: null and empty texts are rejected by the rules (they have too few words); a row with a null doc_id passes
the Jaccard join and the decontamination and is packed; rows that repeat one wholly give one row after the Jaccard join, rows that
repeat a doc_id with another text are documents of their own; very long texts are worked on whole;
further columns, whatever their names, are carried to the packing; empty tables give empty stages.

Stages hold texts in the executors' memory beside their heap. So a stage lowers the session's rows in an Arrow batch, and they
stay low, as its result is only computed when it is written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from offerscope.llm import decontaminate, jaccard_join, packing, quality_rules, secret_scan
from offerscope.llm.queries import byte_bpe
from offerscope.llm.shared import small_batches, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy rejects go."""
    return quality_rules.keep_documents(docs)


@_in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


@_in_small_batches
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's shingles go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_in_small_batches
def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return secret_scan.redact_documents(docs, vocabulary=byte_bpe())


@_in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, byte_bpe(), end_id=1)


STAGES = [
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", redacted),
    ("packing", packed),
]
#: SQL can express neither the guess costs of the secret scan nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, with a table in the shared folder between two of them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
