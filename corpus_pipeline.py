"""From raw documents to packed sequences: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes null texts as empty, keeps null, repeated and tied ids apart by their place in the
input, reads whole texts of any length, passes extra columns of any name on, and gives an empty
table for an empty one; what else a case means is said by the operator that the stage calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sweepgrid.llm import exact_dedup, mixing, near, packing, toxicity
from sweepgrid.llm.shared import materialise, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; empty texts stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays, a null one last."""
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the row with the smallest doc_id stays; texts without words all do."""
    return near.keep_one(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mix of the sources by the target weights, as large as its input: documents of starved leaves
    come once for each seeded epoch, three at most, and the last one of a leaf may be a prefix."""
    return mixing.keep_mix(docs)


def to_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 2048 tokens, with their ids."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_join", without_near_copies),
    ("mixing", to_weights),
    ("packing", to_sequences),
]

#: Toxicity scores, hashes of shingles and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
