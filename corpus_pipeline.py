"""The corpus pipeline: five stages over documents, each one an operator of vitalframe.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result in the shared
folder and reads it back, so a lost executor costs no finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm import language_id, mixing, near_dedup, subwords, toxicity
from vitalframe.llm.common import id_remainder, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.5; learned from the labels whose fold is not held out."""
    labels = table(spark, sf_dir, "labels").filter(id_remainder(F.col("doc_id"), 5) != 0)
    terms, weights = toxicity.train(docs, labels)
    return toxicity.without_toxic(docs, terms, weights)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text one or several known languages explain; learned from the rows whose fold is not held out."""
    names, model = language_id.train(docs.filter(id_remainder(F.col("doc_id"), 4) != 2))
    return language_id.with_language(docs, names, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates."""
    return near_dedup.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mixture: files and rows follow it, so any prefix has the target shares."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids and lossless of every row, in the order of docs."""
    return subwords.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("minhash_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn models and use keyed hashes that SQL cannot express; tests/llm holds the brute-force version.
ORACLE_SQL = None
