"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import interactions, jaccard, lm, merkle, mixing, pieces, quality, sharding, suffixes, urlfilter, vectors, warc, wrappers
from tidewater.llm.shared import new_path, ship, table

_record_page = lambda c: F.nullif(F.regexp_extract(c, "<urn:record:(.*)>", 1), F.lit("")).try_cast("long")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    found = warc.read(spark, path)
    return found.select(_record_page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _record_page("refers_to").alias("refers_to"))


def op2_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 24, new_path(spark, "slot-map"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).drop("block_probability")


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = [op1_warc, op2_wrappers, op3_pieces, op4_jaccard, op5_vectors, op6_sharding, op7_quality, op8_mixing, op9_lm, op10_urlfilter, op11_suffixes, op12_merkle, op13_interactions]
ORACLES = {"op1_warc": warc.ORACLE, "op4_jaccard": jaccard.ORACLE, "op5_vectors": vectors.ORACLE, "op8_mixing": mixing.ORACLE, "op11_suffixes": suffixes.ORACLE, "op12_merkle": merkle.ORACLE, "op13_interactions": interactions.ORACLE}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _shipped(q) for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
