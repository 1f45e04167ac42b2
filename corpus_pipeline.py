"""A corpus from documents: quality rules, near-dedup, benchmark decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as the
next stage's docs. All but the last keep the columns of documents, under any names, and their order.

Defined results: a null or empty text fails the quality rules, so no later stage of ``run`` meets one; a stage by itself
takes them (they have no near copies, no hits and no secrets, and pack as the end mark alone). A null doc_id stays, and is
never taken for a copy of another document. Equal rows of one doc_id all stay or go together. Empty documents give no rows at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import decontaminate, neardup, packing, quality, secrets
from wayfold.llm.common import remove, scratch, table
from wayfold.llm.queries import tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs.select(F.struct("*").alias("row"), "text"), rules).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return packing.best_fit(docs, tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Learned rules and a tokenizer's ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents. What a stage gives is kept in the shared folder until the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
