"""Corpus pipeline: documents to token ids in five stages, each an operator of ``ratingloom.llm``.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each stage's rows as Parquet into the shared folder and reads them back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm import bpe, mixing, quality, simhash, toxicity
from ratingloom.llm.common import cut, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: No SQL can train and apply the models of the first stages; tests/llm/test_pipeline_stages.py compares each stage with a plain computation.
ORACLE_SQL = None


def whole_rows(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, text): rows in one column, so that the columns of an operator don't replace any of theirs."""
    return docs.select(F.struct("*").alias("_row"), "doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model doesn't call toxic."""
    scored = toxicity.classify(whole_rows(docs), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select("_row.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose posterior quality is at least one half."""
    measured = cut(quality.measure(whole_rows(docs)).drop("doc_id", "text"))
    return quality.judge(measured, quality.fit(measured)).where("kept").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar texts."""
    return simhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of source, language and topic."""
    return mixing.sample(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every document that is left."""
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir).withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids")
