"""Registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import (bpe, embed_dedup, exact_dedup, language, lexical, line_dedup, mixing, negatives, packing, sharding, simhash, substring,
                             toxicity)
from scriptorium.llm.common import Scratch


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks removed: what each document lost, and a digest of its new text."""
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents", "doc_id", "text"), Scratch(spark))
    return out.select(F.col("row.doc_id").alias("doc_id"), "chunks_removed", "lines_removed", F.length("new_text").cast("long").alias("n_chars"),
                      F.sha2("new_text", 256).alias("text_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(read(spark, sf_dir, "documents", "doc_id", "text", "lang"), Scratch(spark))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(read(spark, sf_dir, "documents", "doc_id", "text"), Scratch(spark))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_groups(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), Scratch(spark))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents", "doc_id", "source"), Scratch(spark))
    return out.select("row.doc_id", "row.source", "epoch", "slot", "place")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"), Scratch(spark))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(read(spark, sf_dir, "documents", "doc_id", "text"), Scratch(spark))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents", "doc_id", "text"), Scratch(spark))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(read(spark, sf_dir, "documents", "doc_id", "text"), Scratch(spark))
    return out.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), Scratch(spark))
    return out.pieces.drop("row")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector counts under the next label."""
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), Scratch(spark))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"), Scratch(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_dedup, op2_language_id, op3_substring_dedup, op4_embedding_dedup, op5_mix_sources, op6_byte_bpe, op7_toxicity,
    op8_exact_dedup, op9_shard, op10_simhash_dedup, op11_packing, op12_hard_negatives, op13_ranked_search)} | {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {"op4_embedding_dedup": embed_dedup.SQL, "op5_mix_sources": mixing.SQL, "op8_exact_dedup": exact_dedup.SQL,
                       "op12_hard_negatives": negatives.SQL, "op13_ranked_search": lexical.SQL}
