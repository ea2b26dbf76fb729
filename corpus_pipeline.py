"""A training corpus from raw documents: quality, near-duplicates, benchmark leaks, source weights, token files.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import decontaminate, mixing, near_dedup, quality, token_store
from tickloom.llm.common import stage, table
from tickloom.llm.queries import sites, tokenizer


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, _ = quality.train(docs, table(spark, sf_dir, "labels"), **sites())
    return quality.keep_good(docs, model, **sites())


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), shortest=1)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.token_table(docs, tokenizer())


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_leaks),
    ("mixing to target weights", mixed),
    ("token files", token_files),
]

#: The classifier, the similarities and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
