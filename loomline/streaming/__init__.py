"""Structured Streaming: windows with watermarks, keyed merges of micro-batches, deduplication."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares. Only a local master may do without: it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, path: str, schema, files: int = 1000) -> DataFrame:
    """A stream of the files at path (a glob), with ts as a timestamp; `files` of them in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, spark: SparkSession, keys: list[str], order: str) -> DataFrame:
    """Runs a stream over all that is there and returns the newest row of each key.

    Every micro-batch is written as a table of its own, named by its number, so that a batch that runs again after a
    failure replaces itself.
    """
    at = folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_", F.lit(number)).write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{at}/rows").drop("batch")
    names = [c for c in rows.columns if c != "batch_"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct("batch_", order)).alias("r")).select("r.*")


def tumbling(stream: DataFrame, ts: str, width: str, late: str, keys: list[str], aggs: list) -> DataFrame:
    """Aggregates per window; a row later than `late` behind the newest is left out, and old state goes."""
    got = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(*aggs)
    return got.select(F.col("w.start").alias("start"), *[c for c in got.columns if c != "w"])


def first_of(stream: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """The first row to arrive of each key, remembered for as long as the watermark allows."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def limited(stream: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, passed and seen after each micro-batch: at most `most` rows of a key pass, over the whole stream. The state of
    a key is one count, as what passed follows from it; rows are counted before they are shuffled."""
    return stream.groupBy(*keys).agg(F.count("*").alias("seen")).select(*keys, F.least("seen", F.lit(most)).cast("long").alias("passed"), "seen")
