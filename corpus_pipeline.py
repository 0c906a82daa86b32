"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and its result is written as Parquet
and read again as the next one's docs. ORACLE_SQL is None: boosted trees, learned grammars and byte-pair merges can't be
written in SQL; tests/llm/test_plain.py holds every stage, and the whole, against plain Python on the smallest table.

Edge cases: null and empty texts fail the quality rules; a null id goes through all stages like any other; repeated rows
are one group of near duplicates, of which one stays; extra columns go along as they are, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import ngram_join, packing, quality_rules, queries, suffix_dedup, toxicity
from factloom.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality_rules.keep_clean(docs, table(spark, sf_dir, "labels"))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are predicted toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest id."""
    return ngram_join.one_of_each(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out of every text the passages that repeat anywhere, and counts its characters anew."""
    left = suffix_dedup.without_repeats(docs)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences."""
    return packing.best_fit_packing(docs, queries.byte_bpe())


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality), ("toxicity", civil), ("ngram_jaccard_join", distinct), ("suffix_array_dedup", unrepeated), ("best_fit_packing", packed)]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; between stages the rows go through the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
