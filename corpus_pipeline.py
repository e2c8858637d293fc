"""The corpus pipeline: toxic texts out, shared lines out, one of each near copy, mix, encode.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All
but the last return the columns of `documents`; the last adds what encoding gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorstep.llm import bpe, jaccard, lines, mixing, toxicity
from doorstep.llm.queries import SEED, WEIGHTS, vocabulary_path
from doorstep.llm.store import ready, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    ready(spark)
    return docs.select(*COLUMNS)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts scoring 0.3 or more go; learned from the labelled rows that may be learned from."""
    return toxicity.without_toxic(_documents(spark, docs), table(spark, sf_dir, "labels"))


def shared_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more lose all their copies; n_chars follows the text."""
    return lines.without_shared_lines(_documents(spark, docs), least=10, shortest=1)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word n-grams, similarity 0.8 or more."""
    return jaccard.one_of_each(_documents(spark, docs), width=5, num=4, den=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as it draws for its source's weight, in shuffled order."""
    return mixing.mix(_documents(spark, docs), WEIGHTS, seed=SEED).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents plus `ids` and `n_tokens`."""
    rows = bpe.encode(_documents(spark, docs), vocabulary_path())
    return rows.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", shared_lines_out),
    ("ngram_jaccard_join", near_copies_out),
    ("mix_sources", mixed),
    ("bpe_encoding", encoded),
]

#: Training, components and tokens have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
