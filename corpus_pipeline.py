"""A training corpus from raw documents: quality, near-duplicates, benchmark leaks, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import staged, table
from framelake.llm.decontam import clean
from framelake.llm.kneser_ney import keep_good
from framelake.llm.packing import pack
from framelake.llm.pii import sanitise
from framelake.llm.simhash import drop_near_duplicates
from framelake.session import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def settled(stage: Stage) -> Stage:
    """``stage`` on executors that have given back what the stage before it used."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        settle(spark)
        return stage(spark, docs, sf_dir)

    return run


@settled
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's bound."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


@settled
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return drop_near_duplicates(docs, words=5, radius=4)


@settled
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


@settled
def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms replaced."""
    return sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@settled
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("packing", packing)]

#: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
