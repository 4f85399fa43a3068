"""Queries on feed formats and rule tables, written from the driver's tables and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline import streaming
from loomline.operators import joins
from loomline.plans.registry import registry
from loomline.sources import feeds, table

QUERIES, SQL, query = registry()


@query("""WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 9 <> 0 THEN date_trunc('second', ts) END AS published FROM events), c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY published DESC NULLS LAST, 'https://x.org/' || event_id) AS r FROM r WHERE published IS NULL OR published >= TIMESTAMP '2024-01-10')
SELECT user_id, 'Item ' || event_id || ' & more' AS title, 'https://x.org/' || event_id AS url, published FROM c WHERE r <= 20""")
def rss_scan(spark: SparkSession, d: str) -> DataFrame:
    """Events written as feed items and read back: old ones go, each source keeps its newest twenty."""
    stamp = F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("<pubDate>"), F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate>")))
    xml = F.concat(F.lit("<item><title>Item "), "event_id", F.lit(" &amp; more</title><link>https://x.org/"), "event_id", F.lit("</link>"), F.coalesce(stamp, F.lit("")), F.lit("</item>"))
    got = feeds.rss(table(spark, d, "events").select("user_id", xml.alias("xml")), "user_id", "xml", F.lit("2024-01-10").cast("timestamp"), 20)
    return got.select("user_id", "title", "url", F.col("published").cast("timestamp_ntz").alias("published"))


@query("""WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS high, min(value) AS low, max_by(value, (ts, event_id)) AS price FROM events GROUP BY ALL)
SELECT user_id || '/' || day AS key, CASE WHEN user_id % 5 = 0 THEN day(day) ELSE price END AS price, low, high FROM b WHERE user_id % 5 <> 0 OR (day(day) BETWEEN low * 0.98 AND high * 1.02)""")
def delimited_scan(spark: SparkSession, d: str) -> DataFrame:
    """Daily lines of delimited text; some have another field where the price should be and go unless it could be one."""
    daily = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    moved = F.when(F.col("user_id") % 5 == 0, F.dayofmonth("day").cast("string")).otherwise(F.col("close").cast("string"))
    line = F.concat_ws(";", F.lit("name"), moved, F.col("low").cast("string"), F.col("high").cast("string"))
    lines = daily.select(F.concat_ws("/", "user_id", "day").alias("key"), line.alias("line"))
    return feeds.delimited(lines, "key", "line", {"price": 1, "low": 2, "high": 3}, ";")


@query("SELECT conv_id, turn, text FROM conversations")
def payload_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Messages deflated, masked and in base64, read back."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", feeds.packed(F.col("text"), b"loom").alias("p"))
    return rows.select("conv_id", "turn", feeds.unpacked(F.col("p"), b"loom").alias("text"))


@query("""WITH m AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id, date_trunc('day', ts) + INTERVAL 21 HOUR AS bar FROM events), j AS (SELECT b.user_id, bar, event_id, ts FROM b JOIN m ON m.user_id = b.user_id AND ts >= bar AND ts < bar + INTERVAL 24 HOUR)
SELECT user_id, bar, max_by(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM j GROUP BY ALL""")
def bar_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The last point of each 24-hour bar from 21:00 on; bars without a point are absent."""
    rows = table(spark, d, "events")
    starts = rows.select("user_id", (F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 21 HOURS")).alias("bar")).distinct()
    bars = starts.withColumn("end", F.col("bar") + F.expr("INTERVAL 24 HOURS"))
    points = rows.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    inside = joins.in_range(points, bars, "ts", "bar", "end", 86_400, ["user_id"])
    return inside.groupBy("user_id", "bar").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, max(ts) AS stamp, max_by(value, (ts, event_id)) AS v FROM events GROUP BY ALL), s AS (SELECT user_id, event_type, max(stamp) AS stamp FROM l GROUP BY ALL), k AS (SELECT user_id, event_type FROM s WHERE stamp >= TIMESTAMP '2024-01-29')
SELECT user_id, event_type, day, v FROM l SEMI JOIN k USING (user_id, event_type)""")
def two_step_triage(spark: SparkSession, d: str) -> DataFrame:
    """A cheap scan of stamps picks the series that moved; only their values are read and grouped."""
    rows = table(spark, d, "events")
    moved = rows.select("user_id", "event_type", "ts").where(F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz")).select("user_id", "event_type").distinct()
    daily = rows.join(moved, ["user_id", "event_type"], "left_semi").groupBy("user_id", "event_type", F.to_date("ts").alias("day"))
    return daily.agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))


@query("""WITH q AS (SELECT o_orderkey, o_custkey % 7 AS queue, o_orderstatus AS status, o_orderdate FROM orders) SELECT queue, arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (status = 'P') AS job, count(*) FILTER (status = 'P') AS pending, bool_or(status = 'O' AND o_orderdate < TIMESTAMP '1993-01-01') AS stuck FROM q GROUP BY 1""")
def claimed_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The oldest pending job of each queue, how many wait, and whether an open one is overdue."""
    pending = F.col("o_orderstatus") == "P"
    place = F.when(pending, F.struct("o_orderdate", "o_orderkey"))
    stuck = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp_ntz"))
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 7).alias("queue")).agg(F.min(place).alias("p"), F.count_if(pending).alias("pending"), F.bool_or(stuck).alias("stuck")).select("queue", F.col("p.o_orderkey").alias("job"), "pending", "stuck")


@query("""WITH m AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM m) SELECT conv_id, part, count(*) AS messages, sum(n) AS chars, max(turn) AS last FROM s GROUP BY ALL""")
def exchanges(spark: SparkSession, d: str) -> DataFrame:
    """Messages in exchanges, each begun by the user."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("part", F.sum((F.col("role") == "user").cast("int")).over(w))
    return rows.groupBy("conv_id", "part").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last"))


@query("""WITH a AS (SELECT DISTINCT s_nationkey AS k FROM supplier), b AS (SELECT DISTINCT c_nationkey AS k FROM customer) SELECT n_name, a.k IS NOT NULL AS sells, b.k IS NOT NULL AS buys FROM nation LEFT JOIN a ON n_nationkey = a.k LEFT JOIN b ON n_nationkey = b.k WHERE (a.k IS NULL) <> (b.k IS NULL) OR (a.k IS NULL AND b.k IS NULL)""")
def registry_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Names of the registry that one side or both lack."""
    has = lambda name, key, out: table(spark, d, name).select(F.col(key).alias("n_nationkey")).distinct().withColumn(out, F.lit(True))
    rows = table(spark, d, "nation").join(has("supplier", "s_nationkey", "sells"), "n_nationkey", "left").join(has("customer", "c_nationkey", "buys"), "n_nationkey", "left").fillna(False, ["sells", "buys"])
    return rows.where("NOT (sells AND buys)").select("n_name", "sells", "buys")


@query("""WITH p AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END, CASE WHEN lang IN ('en', 'es') THEN '' ELSE lang END, n_chars DESC NULLS LAST, doc_id) AS place FROM documents) SELECT doc_id, source, place FROM p""")
def preferred_order(spark: SparkSession, d: str) -> DataFrame:
    """Places within each source: listed languages first in the order given, others by name, then by length."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(F.lit("en"), F.lit("es")), F.col("lang")), F.lit(0)), F.lit(3))
    rest = F.when(F.col("lang").isin("en", "es"), "").otherwise(F.col("lang"))
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars", rank.alias("rank"), rest.alias("rest"), F.floor(F.col("n_chars") / 64).alias("size"))
    # Counted by size first, so that a large source is no single window.
    keys = ["source", "rank", "rest", "size"]
    prior = Window.partitionBy("source").orderBy("rank", "rest", F.desc_nulls_last("size")).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(prior), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("n_chars"), "doc_id"))
    ranked = rows.withColumn("place", place)
    same = reduce(lambda a, b: a & b, (ranked[c].eqNullSafe(base[c]) for c in keys))
    return ranked.join(base, same).select("doc_id", ranked["source"], (F.col("place") + F.col("base")).alias("place"))


@query("SELECT user_id, event_type, least(count(*), 8) AS passed, count(*) AS seen FROM events GROUP BY ALL")
def stream_limited(spark: SparkSession, d: str) -> DataFrame:
    """A stream that lets eight events of each user and type pass and counts the rest: two numbers of state a key."""
    rows = streaming.events(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)
    return streaming.drained(streaming.limited(rows.select("user_id", "event_type"), ["user_id", "event_type"], 8), spark, ["user_id", "event_type"], "seen")


@query("""WITH l AS (SELECT doc_id, source, length(text) AS n FROM documents), t AS (SELECT source, sum(n) AS total FROM l GROUP BY 1),
c AS (SELECT source, CASE WHEN total <= 20000 THEN 1.0::DOUBLE ELSE 20000 / total END AS f FROM t) SELECT doc_id, CAST(CASE WHEN f = 1 THEN n ELSE least(n, greatest(300, floor(n * f))) END AS BIGINT) AS chars FROM l JOIN c USING (source)""")
def prompt_budget(spark: SparkSession, d: str) -> DataFrame:
    """How much of each text goes into a prompt of 20,000 characters per source: all are cut in proportion, none below 300."""
    n, total = F.length("text"), F.sum(F.length("text")).over(Window.partitionBy("source"))
    rows = table(spark, d, "documents").select("doc_id", n.alias("n"), total.alias("total"))
    cut = F.least(F.col("n"), F.greatest(F.lit(300), F.floor(F.col("n") * (F.lit(20000) / F.col("total")))))
    return rows.select("doc_id", F.when(F.col("total") <= 20000, F.col("n")).otherwise(cut).cast("long").alias("chars"))
