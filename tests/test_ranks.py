"""Places against one window over each group, with a group that holds most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.operators import ranks


def test_places_of_a_large_group(spark):
    rng = random.Random(71)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i long")
    order = [F.desc("v"), F.col("i")]
    got = {r.i: r.place for r in ranks.numbered(df, ["k"], order).collect()}
    want = {r.i: r.p for r in df.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy(*order))).collect()}
    assert got == want
    assert ranks.numbered(df.limit(0), ["k"], order).collect() == []
    parts = ranks.numbered(df, ["k"], order).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 1 and sorted(r.place for r in ranks.numbered(df.select("k", F.lit(1).alias("v"), F.lit(2).alias("i")).where("k = 'hot'"), ["k"], order).collect()) == list(range(1, sum(r[0] == "hot" for r in rows) + 1))
