"""A corpus pipeline of five stages, each on all that its predecessor kept.

Toxic documents go, one document of each near-duplicate group stays, documents with benchmark
passages go, sources are mixed to their target weights, and what is left is written as token ids.
All stages but the last return the columns of `documents`; the last returns the token index.
Stages are written as Parquet and read again, so a lost executor costs no finished stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, mixing, near_dedup, token_store, toxicity
from quillspark.llm.common import materialise
from quillspark.llm.queries import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones, does not reject."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked at a Jaccard similarity of 0.8 or more."""
    return near_dedup.drop_duplicates(docs, percent=80).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item at a shingle containment of 0.8 or more."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected token shares meet the source, language and topic targets."""
    return mixing.sample(docs).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the token files."""
    return token_store.document_index(token_store.write_store(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: A trained model, MinHash and a tokenizer have no SQL form; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", __file__.rpartition("/")[0] or ".")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
