"""A training-data pipeline over ``documents``: five stages, each one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read back as the next stage's ``docs``. All but the last return
the columns they were given, whatever their names; where a stage changes
``text``, ``n_chars`` (if there) follows. Rows without a ``doc_id`` pass the
stages that decide by id. A text all of whose lines stand in documents of
smaller ids is left empty by line dedup; its row stays, links with nothing,
and is packed as its closing id alone. An empty table passes every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.llm import line_dedup, near_dup, packing, secrets, toxicity
from tavola.llm.common import read, written


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go (operator 4)."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay only in the smallest doc_id that holds them (operator 3)."""
    return _same_columns(line_dedup.dedup_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 (operator 9)."""
    return near_dup.without_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts (operator 1)."""
    return _same_columns(secrets.masked(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens (operator 10)."""
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


STAGES = [
    ("toxicity", toxic),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: SQL cannot express a trained classifier or the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
