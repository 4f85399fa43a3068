"""Streams over many small files in no order: no row is lost, and each key comes first once."""

from pyspark.sql import functions as F

from loomline import streaming

SF = "/root/testdata/sf0.001"


def small_files(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.repartition(12, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events")
    return rows


def test_hourly_over_many_batches(spark, tmp_path):
    rows = small_files(spark, tmp_path)
    stream = streaming.events(spark, f"{tmp_path}/events", rows.schema, files=2)
    hourly = streaming.tumbling(stream, "ts", "1 hour", "400 days", ["event_type"], [F.count("*").alias("n"), F.max("value").alias("top")])
    got = streaming.drained(hourly, spark, ["start", "event_type"], "n")
    want = rows.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    assert sorted(map(tuple, got.select("start", "event_type", "n", "top").collect())) == sorted(map(tuple, want.collect()))


def test_first_of_each_key_once(spark, tmp_path):
    rows = small_files(spark, tmp_path)
    stream = streaming.first_of(streaming.events(spark, f"{tmp_path}/events", rows.schema, files=3), "ts", "400 days", ["user_id", "event_type"])
    out = f"{tmp_path}/out"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(out).awaitTermination()
    got = [(r.user_id, r.event_type) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) == rows.select("user_id", "event_type").distinct().count()


def test_limited_counts_over_many_batches_without_a_call_a_key(spark, tmp_path):
    rows = small_files(spark, tmp_path)
    stream = streaming.limited(streaming.events(spark, f"{tmp_path}/events", rows.schema, files=3), ["user_id", "event_type"], 8)
    assert "InPandasWithState" not in stream._jdf.queryExecution().logical().toString()
    got = streaming.drained(stream, spark, ["user_id", "event_type"], "seen")
    want = rows.groupBy("user_id", "event_type").agg(F.least(F.count("*"), F.lit(8)).alias("passed"), F.count("*").alias("seen"))
    assert sorted(map(tuple, got.select("user_id", "event_type", "passed", "seen").collect())) == sorted(map(tuple, want.collect()))
