"""Places within groups of any size: counted over ranges of rows, so that no group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.streaming import folder


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place (from 1) in its group's order; rows of one place in the order are numbered as they come.

    Rows are dealt out by ranges of (keys, order) and written once to the shared folder; a place is the row's place in its
    range, after the rows that the group has in ranges before. A null key is a group like any other. The one window over a
    group has a row for each range.
    """
    at = folder(df.sparkSession)
    df.repartitionByRange(*keys, *order).select("*", F.to_json(F.struct(*keys)).alias("own_"), F.spark_partition_id().alias("part_")).write.parquet(at)
    rows = df.sparkSession.read.parquet(at)
    before = Window.partitionBy("own_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("own_", "part_").agg(F.count("*").alias("n_")).select("own_", "part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    within = F.row_number().over(Window.partitionBy("own_", "part_").orderBy(*order))
    return rows.withColumn("within_", within).join(base, ["own_", "part_"]).withColumn(name, F.col("base_") + F.col("within_")).drop("own_", "part_", "within_", "base_")
