"""A corpus pipeline of five stages, each written as Parquet and read again as the documents of the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, line_dedup, minhash, mixing, toxicity
from scriptorium.llm.common import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that occurred before; ``n_chars`` follows the text where a text changed."""
    out = line_dedup.dedup_lines(docs, Scratch(spark))
    changed = F.col("chunks_removed") > 0
    values = {"text": F.col("new_text"), "n_chars": F.when(changed, F.length("new_text")).otherwise(F.col("row.n_chars"))}
    kinds = dict(docs.dtypes)
    return out.select(*[values.get(c, F.col(f"row.`{c}`")).cast(kinds[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: SimHash links and banded minima, five-word shingles similar by 0.8 or more in the whole texts."""
    return minhash.drop_near_duplicates(docs, Scratch(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mixed order; those of sources below their weight are used more than once."""
    out = mixing.mix(docs, Scratch(spark))
    return out.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources), ("byte_bpe", tokenize)]

#: A learned classifier, rolling hashes and BPE are beyond SQL; the pipeline is tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
