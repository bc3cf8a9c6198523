"""The corpus pipeline: stages that each read all that the one before kept.

run(spark, sf_dir) applies STAGES to the documents table; what a stage returns is
written as Parquet to the shared folder and read again as the next one's documents.  Tables that
no later stage reads are removed; the result reads the last ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, langid, linededup, mixing, neardup
from quillon.llm.shared import kept, stage
from quillon.shipping import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go."""
    ship(spark)
    return langid.keep_identified(docs, langid.fit(docs, langid.learnable()))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go, and documents that had words and lose all of them."""
    ship(spark)
    return linededup.dedup_lines(docs, drop_emptied=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship(spark)
    return neardup.drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    ship(spark)
    return decontaminate.drop_leaked(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate that meets the target weights, and how many copies to take; none, and it goes."""
    ship(spark)
    return mixing.mix(docs, _table(spark, sf_dir, "labels"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("mixing", mixture),
]

#: SQL expresses neither the language model nor the fitted rates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, apply in STAGES[:-1]:
        with stage(spark):
            docs, own = kept(apply(spark, docs, sf_dir), name)
        if before is not None:
            before.clear()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
