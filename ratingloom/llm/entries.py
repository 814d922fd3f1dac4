"""Registered queries of this subpackage: thin functions (spark, sf_dir) -> DataFrame, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, mixing, negatives, packing, ppm, quality, simhash, toxicity, tries, urls, warc, webp
from .common import bucket, cut, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"), "worst_sentence")


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op4_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.round_trip(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    out = quality.judge(measured, quality.fit(measured))
    return out.select("doc_id", *quality.STATS, "base_failed", "kept", "quality", "pattern")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", mixing.topic(text).alias("topic"), mixing.n_tokens(text).alias("n_tokens"))
    return mixing.draw(cut(docs), "n_tokens").select("doc_id", "source", "lang", "topic", "n_tokens", F.round("rate", 4).alias("rate"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_rows(packing.pack(table(spark, sf_dir, "documents"), packing.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))))


def op12_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tries.nodes(tries.rebuilt(table(spark, sf_dir, "conversations")))
    return found.withColumns({c: F.col(c).cast("long") for c in ("depth", "n_children")})


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(negatives.usable(rows), F.col("id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_ppm, op3_simhash, op4_webp, op5_quality, op6_urls, op7_mixing, op8_bpe, op9_licenses, op10_warc, op11_packing, op12_tries, op13_negatives)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": mixing.mixture_sql(), "op10_warc": warc.roundtrip_sql(), "op12_tries": tries.trie_sql(), "op13_negatives": negatives.mining_sql()}
