"""A corpus pipeline of four operators: quality rules, near-duplicate removal, mixing, encoding.

Defined results, for every stage: a null text is empty, and the quality rules reject it; null ids, sources and
other columns pass through as they are; a text of any length is read whole and kept or dropped whole; rows that
repeat an id and text are copies of each other, so one stays; of a group of near copies the one with the
smallest id stays, null ids last; an empty table gives an empty result with the same columns; columns beside
those of documents pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import jaccard, mixing, pieces, quality
from tidewater.llm.shared import new_path, ship, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    ship(spark)
    return quality.keep(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship(spark)
    return jaccard.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, kept, cut or dropped to meet each source's target."""
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text is encoded and decoded again."""
    ship(spark)
    return pieces.digests(docs)


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("source_mixing", source_mixing), ("sentencepiece", sentencepiece)]

#: zstandard ratios and SentencePiece have no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
