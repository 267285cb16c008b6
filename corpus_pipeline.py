"""Cleaning a corpus of documents for training, stage by stage.

Each stage takes the documents that the one before it kept, with all their columns, and returns those that it keeps; the
last one returns their tokens. Between stages the documents are written as Parquet in the shared folder.

Defined results: a null text counts as empty, and of empty texts one stays; rows with a null id are documents like others,
of which exact copies and near copies go, and whose class they name only where no row with an id does; of rows that
repeat one stays; texts are read whole, very long ones too; columns that a stage doesn't know are kept, whatever their
names; without labels of both kinds nothing is learned and nothing rejected; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taskscope.llm import decontamination, duplicates, near_duplicates, pieces, toxicity
from taskscope.llm.store import written

#: Documents that reach this score are rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the classifier rejects; it learns from the labelled rows of the stage's own input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels), TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text."""
    return duplicates.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_duplicates.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a test item."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left."""
    import public_tokenizers

    coded = pieces.tokenize(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.selectExpr("id AS doc_id", "ids", "cast(size(ids) AS bigint) AS n_tokens", "decoded AS text")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: Trained scores, near copies and token ids are beyond SQL; the tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
