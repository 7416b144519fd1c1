"""The daily run as a stream: each day's units come as a micro-batch, and the run of the midnight after follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.stats import daily


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, empty before its first write."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _put(df: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that ``df`` brings, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def state(spark: SparkSession, folder: str) -> DataFrame:
    """All runs so far, by day."""
    return _table(spark, f"{folder}/runs", daily.STATE)


def units(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, f"{folder}/units", f"{daily.UNITS}, day int, batch bigint")


def run(spark: SparkSession, folder: str, day: int, rules: daily.Rules = daily.Rules()) -> None:
    """One day's run of all plans on the stored units; again, it replaces that day's rows only."""
    _put(daily.next_run(units(spark, folder), state(spark, folder), day, rules), f"{folder}/runs", "day")


def follow(stream: DataFrame, folder: str, checkpoint: str, rules: daily.Rules = daily.Rules()) -> StreamingQuery:
    """Store each micro-batch's units, then run the midnight after each of its days, the earliest first.

    A batch that is delivered again replaces its own units and its days' runs. Units that come late change
    the runs of later days only; :func:`run` does a day anew.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumns({"day": F.floor(F.col("t") / 24).cast("int"), "batch": F.lit(number).cast("bigint")})
        _put(batch, f"{folder}/units", "day", "batch")
        for (day,) in batch.select("day").distinct().orderBy("day").collect():
            run(spark, folder, day + 1, rules)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
