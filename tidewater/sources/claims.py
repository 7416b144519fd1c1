"""Which login claimed a session, and when, kept by file: only files that changed are read again.

A login's folder tells its claims in ``sessions/*.json`` (one process each, with its start) and in
``history.jsonl`` (one prompt a line). A file's fingerprint is its path, length and time of change. The stored
claims are partitioned by file, so a changed file replaces its own rows; a version of the manifest
says which files count, so one that is gone takes its claims with it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIMS = "group string, path string, length bigint, changed timestamp, session string, ts_us bigint, file string"
MANIFEST = "group string, path string, length bigint, changed timestamp, version bigint"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def listed(spark: SparkSession, folders: Mapping[str, str]) -> DataFrame:
    """(group, path, length, changed) of the files that tell claims; no file is opened."""
    out = spark.createDataFrame([], "group string, path string, length bigint, changed timestamp")
    for group, folder in folders.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        out = out.unionByName(files.select(F.lit(group).alias("group"), "path", "length", F.col("modificationTime").alias("changed")))
    return out.filter(F.col("path").rlike(r"/sessions/[^/]+\.json$|/history\.jsonl$"))


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The claims of the files named; a line that is not JSON, or has no session or instant, is none.

    Only the session and the instant are kept of a line.
    """
    paths = [r[0] for r in files.select("path").distinct().collect()]  # names of changed files
    if not paths:
        return spark.createDataFrame([], CLAIMS)
    row = F.from_json("value", "sessionId string, startedAt double, timestamp double")
    told = spark.read.text(paths).select(F.col("_metadata.file_path").alias("_path"), row.alias("r"))
    at = F.when(F.endswith("_path", F.lit(".json")), F.col("r.startedAt")).otherwise(F.col("r.timestamp"))
    told = told.select(F.regexp_replace("_path", "^file:/+", "/").alias("_at"), F.col("r.sessionId").alias("session"), F.round(at * 1000).cast("bigint").alias("ts_us")).filter("session is not null and ts_us is not null and ts_us <> 0")
    known = files.withColumn("_at", F.regexp_replace("path", "^file:/+", "/"))
    return known.join(told, "_at").select("group", "path", "length", "changed", "session", "ts_us", F.sha2("path", 256).alias("file"))


def refresh(spark: SparkSession, folders: Mapping[str, str], cache: str) -> int:
    """Bring the stored claims up to date; returns how many files were read."""
    manifest = _stored(spark, f"{cache}/manifest", MANIFEST)
    version = manifest.agg(F.max("version")).first()[0]
    files = listed(spark, folders)
    key = ["group", "path", "length", "changed"]
    new = files.join(manifest.filter(F.col("version") == version), key, "left_anti") if version is not None else files
    count = new.count()
    if count:
        read(spark, new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(f"{cache}/claims")
    files.withColumn("version", F.lit((version or 0) + 1).cast("bigint")).coalesce(1).write.mode("append").partitionBy("version").parquet(f"{cache}/manifest")
    return count


def claims(spark: SparkSession, cache: str, version: int | None = None) -> DataFrame:
    """(group, session, ts_us) of the files that the newest (or a named) version of the manifest lists, as they were then."""
    manifest = _stored(spark, f"{cache}/manifest", MANIFEST)
    version = manifest.agg(F.max("version")).first()[0] if version is None else version
    key = ["group", "path", "length", "changed"]
    return _stored(spark, f"{cache}/claims", CLAIMS).join(manifest.filter(F.col("version") == version).select(*key), key, "left_semi").select("group", "session", "ts_us")
