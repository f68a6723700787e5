"""The corpus pipeline: a chain of stages, each written and read again before the next one.

All stages but the last return the columns of ``documents``, whatever further columns it has. Null and empty texts count as
empty and are kept by every stage (equal ones are copies, of which one stays); very long texts are read whole; an empty
table gives an empty table; rows without id are kept; of repeated ids one row stays after ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import bpe, decontaminate, order_minhash, secret_scan, toxicity
from lexmill.llm.common import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from the labels outside the held-out fold.

    Without labels nothing is rejected. Repeated rows go or stay together; a score equal to 0.5 goes.
    """
    return toxicity.clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that of the least id; of equal ids that of the least text."""
    return order_minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty items match nothing; an empty benchmark removes nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark; all documents, other characters and columns stay."""
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``token_ids`` of every document; an empty or null text has none."""
    return bpe.encode(docs).selectExpr("doc_id", "cast(size(ids) AS bigint) AS n_tokens", "ids AS token_ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: No SQL twin: the stages train models and align texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
