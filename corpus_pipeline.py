"""The training-data pipeline: five stages over `documents`, each written and read again.

Stages take (spark, docs, sf_dir) and return all columns of docs, with one row for each
document kept; the last returns the pieces of the packed sequences. A row's text may be
shorter after the substring stage; n_chars then counts the new text. Null texts count as
empty; clean documents stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspan.llm import exact_dedup, packing, simhash, substring_dedup, toxicity
from graphspan.llm.common import free_name, table

#: Words of the shortest passage that may not be repeated: more than 50.
PASSAGE = 51


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the classifier, trained on the labels, rejects."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "toxicity")
    return toxicity.score(docs, model, out=score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id. Groups
    are joined by links whose five-word shingles confirm a similarity of 0.8; fingerprints as
    op4 links them, and bands of min-hashes, only propose them. Rows with a null or repeated
    id are documents of their own and stand before the others."""
    return simhash.drop_near_copies(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without strings of 400 bytes and passages of PASSAGE words, in however few bytes, that
    occur elsewhere too. Characters of which only a part would stay go as a whole; documents
    of which nothing stays go."""
    return substring_dedup.without_repeated(docs, words=PASSAGE)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences, with the pieces' ids."""
    return packing.op8(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("suffix_array_dedup", substring_stage),
    ("packing", packing_stage),
]

#: No SQL: the classifier and the substring stage cannot be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
