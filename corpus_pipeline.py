"""Corpus pipeline: quality rules, line dedup, near-dedup, source mix, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``; so a stage's scratch tables
can go when the next one begins. All stages but the last return the columns of
``documents``; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import bpe, jaccard, linededup, mixing, quality, simhash
from kinlink.sources.shared import discard, materialize, release

SCOPE = "pipeline"
#: Words of a shingle of the near-duplicate stage's sets, and the least Jaccard similarity that links beside SimHash.
SHINGLE, LEAST = 5, (4, 5)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    release(spark, SCOPE)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.fit(docs, labels, scope=SCOPE))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that three documents hold stay in the one with the largest id."""
    release(spark, SCOPE)
    return _counted(linededup.deduped(docs, scope=SCOPE))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that near fingerprints or alike shingle sets link."""
    release(spark, SCOPE)
    return simhash.firsts(docs, jaccard.linked_by_either(docs, shingle=SHINGLE, least=LEAST, scope=SCOPE))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    release(spark, SCOPE)
    return _counted(mixing.mixed(docs, scope=SCOPE))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their digests."""
    release(spark, SCOPE)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_digest(docs, path, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the fitted quality threshold, the fingerprints or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name, "pipeline-run")
        discard(before)
    release(spark, SCOPE)
    return docs
