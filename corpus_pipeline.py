"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage works on all rows that the one before kept, and all but the last return the columns of
``documents``: toxicity (rejected documents go), SimHash near-dedup (the smallest id of each class
stays), benchmark decontamination (contaminated documents go), mixing of sources to target weights
(documents go or repeat by Poisson counts), and token ids packed into rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placeforge.llm import decontam, mixing, packing, simhash, toxicity
from placeforge.llm.common import discard, materialize, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below one half by a lexicon learned from ``labels`` and the documents at hand.

    Null and empty texts stay, null and repeated ids are rows like others; without labels nothing goes.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, overlap 0.8 or more): the smallest id.

    Texts without a word are one class; rows with a null id stay; rows that share an id stay or go together.
    """
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no item of ``benchmark``; null and empty texts stay."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, shuffled: rows go or repeat, all their columns stay as they are.

    A null source is one; a source without text has rate 0 and goes.
    """
    return mixing.remix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids; a null or empty text is a segment of the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("token packing", packing_stage),
]

#: SQL can't express the learned, hashed and packed stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return docs
