"""Queries on feeds, streams and stateful rules: what is stale, missing, repeated, capped or due."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline import streaming
from loomline.functions import text, times
from loomline.operators import series
from loomline.plans.registry import registry
from loomline.sources import feeds, table

QUERIES, SQL, query = registry()


@query("SELECT page_id, url FROM pages WHERE url IS NOT NULL")
def sitemap_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as sitemap elements and read back."""
    rows = table(spark, d, "pages").where("url IS NOT NULL")
    safe = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = rows.select(F.concat(F.lit("<url><loc>"), safe, F.lit("</loc><title>"), F.col("page_id").cast("string"), F.lit("</title><lastmod>2024-01-05</lastmod></url>")).alias("xml"))
    return feeds.sitemap(xml, "xml").where("published = TIMESTAMP'2024-01-05'").select(F.col("title").cast("long").alias("page_id"), "url")


@query("SELECT user_id, epoch_us(ts) // 1000000 AS ts, value AS close FROM (SELECT *, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 1000000 ORDER BY event_id) AS r FROM events WHERE event_type = 'view') WHERE r = 1")
def chart_scan(spark: SparkSession, d: str) -> DataFrame:
    """Series written as chart payloads, one per user and day, and read back."""
    rows = table(spark, d, "events").where("event_type = 'view'").withColumn("s", F.floor(times.micros("ts") / 1_000_000))
    rows = series.newest(rows, ["user_id", "s"], [F.col("event_id")])
    points = F.array_sort(F.collect_list(F.struct("s", "value")))
    packed = rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(points.alias("p"))
    payload = F.to_json(F.struct(F.col("p.s").alias("timestamp"), F.col("p.value").alias("close"), F.transform("p", lambda x: F.lit(1)).alias("volume")))
    return feeds.chart(packed.select("user_id", payload.alias("payload")), "user_id", "payload").select("user_id", "ts", "close")


@query("""WITH a AS (SELECT page_id, list_slice(regexp_extract_all(html, '(?s)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>'), 1, 150) AS l FROM pages), u AS (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS place FROM a),
t AS (SELECT page_id, place, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(a, '<[^>]+>', ' ', 'g')) AS title FROM u)
SELECT page_id, CAST(place AS INTEGER) AS place, href, title FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY place) AS r FROM t WHERE length(title) >= 3) WHERE r = 1""")
def listing_scan(spark: SparkSession, d: str) -> DataFrame:
    """Links of listing pages with their titles."""
    return feeds.listing(table(spark, d, "pages"), "page_id", "html")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY ALL")
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    """A stream of events in hourly windows, run over all there is. Files come in no order of time, so the watermark lags
    by more than the table spans; a live stream would take a shorter one."""
    rows = streaming.events(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)
    hourly = streaming.tumbling(rows, "ts", "1 hour", "400 days", ["event_type"], [F.count("*").alias("n"), F.max("value").alias("top")])
    return streaming.drained(hourly, spark, ["start", "event_type"], "n").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of user and type that a stream has seen, each let through once."""
    rows = streaming.events(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)
    first = streaming.first_of(rows.select("user_id", "event_type", "ts"), "ts", "60 days", ["user_id", "event_type"])
    return streaming.drained(first, spark, ["user_id", "event_type"], "ts").select("user_id", "event_type")


@query("""WITH b AS (SELECT user_id, date_trunc('hour', ts) AS slot FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT a.user_id, a.slot FROM b a WHERE NOT EXISTS (SELECT 1 FROM b p WHERE p.user_id = a.user_id AND p.slot < a.slot AND p.slot >= a.slot - INTERVAL 3 HOUR)""")
def seen_before(spark: SparkSession, d: str) -> DataFrame:
    """Hourly stories not seen in the three slots before."""
    rows = table(spark, d, "events").where("event_type = 'error'").select("user_id", F.date_trunc("hour", "ts").alias("slot")).distinct()
    before = F.lag("slot").over(Window.partitionBy("user_id").orderBy("slot"))
    return rows.withColumn("p", before).where("p IS NULL OR p < slot - INTERVAL 3 HOURS").select("user_id", F.col("slot").cast("timestamp_ntz").alias("slot"))


@query("""WITH l AS (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY ALL), n AS (SELECT max(ts) AS now FROM events) SELECT user_id, event_type, last FROM l, n WHERE last < now - INTERVAL 5 DAY""")
def stale_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Series whose last point is five days old."""
    rows = table(spark, d, "events")
    now = rows.agg(F.max("ts").alias("now"))
    return rows.groupBy("user_id", "event_type").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(now)).where("last < now - INTERVAL 5 DAYS").drop("now")


@query("""WITH d AS (SELECT day FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events) WHERE isodow(day) < 6), u AS (SELECT DISTINCT user_id FROM events), g AS (SELECT * FROM d, u)
SELECT day, user_id FROM g WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = g.user_id AND CAST(e.ts AS DATE) = g.day)""")
def missed_captures(spark: SparkSession, d: str) -> DataFrame:
    """Business days on which a user has no event at all."""
    rows = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    span = F.broadcast(rows.agg(F.min("day").alias("a"), F.max("day").alias("b")))  # one row
    days = F.filter(F.sequence("a", "b"), lambda x: F.weekday(x) < 5)
    grid = rows.select("user_id").distinct().crossJoin(span).select("user_id", F.explode(days).alias("day"))
    return grid.join(rows, ["user_id", "day"], "left_anti").select("day", "user_id")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 2 ORDER BY s_acctbal DESC, s_suppkey) AS c FROM supplier)
SELECT s_nationkey, s_suppkey FROM a WHERE r <= 2 OR (c = 1 AND s_suppkey % 2 = 1)""")
def top_with_guarantee(spark: SparkSession, d: str) -> DataFrame:
    """The two greatest of each group, and the greatest of a class that must be in."""
    order = [F.desc("s_acctbal"), F.col("s_suppkey")]
    rows = table(spark, d, "supplier").withColumn("odd", F.col("s_suppkey") % 2)
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(*order))).withColumn("c", F.row_number().over(Window.partitionBy("s_nationkey", "odd").orderBy(*order)))
    return rows.where("r <= 2 OR (c = 1 AND odd = 1)").select("s_nationkey", "s_suppkey")


@query("""WITH t AS (SELECT doc_id, source, lang, length(text) AS n FROM documents) SELECT source, max_by(doc_id, (lang = 'en', -n, -doc_id)) AS doc_id, count(*) AS rows, count(DISTINCT lang) AS langs FROM t GROUP BY source""")
def representative_pick(spark: SparkSession, d: str) -> DataFrame:
    """Of each source the English text that is shortest, the earliest of equals."""
    best = F.struct(F.col("lang") == "en", -F.length("text"), -F.col("doc_id"))
    return table(spark, d, "documents").groupBy("source").agg(F.max_by("doc_id", best).alias("doc_id"), F.count("*").alias("rows"), F.count_distinct("lang").alias("langs"))


@query("""WITH t AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL), c AS (SELECT o_custkey, max(day) - 372 AS cut FROM t GROUP BY 1),
l AS (SELECT o_custkey, date_trunc('month', day)::DATE AS month, max_by(v, day) AS v FROM t JOIN c USING (o_custkey) WHERE day < date_trunc('month', cut) GROUP BY ALL)
SELECT o_custkey, month AS day, v, true AS light FROM l UNION ALL SELECT o_custkey, day, v, false FROM t JOIN c USING (o_custkey) WHERE day >= date_trunc('month', cut)""")
def light_history(spark: SparkSession, d: str) -> DataFrame:
    """Long series: month ends before the month 372 days back, every day from it on."""
    daily = table(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    rows = daily.withColumn("cut", F.trunc(F.date_sub(F.max("day").over(Window.partitionBy("o_custkey")), 372), "month"))
    old = rows.where("day < cut").groupBy("o_custkey", F.trunc("day", "month").alias("month")).agg(F.max_by("v", "day").alias("v"))
    return old.select("o_custkey", F.col("month").alias("day"), "v", F.lit(True).alias("light")).union(rows.where("day >= cut").select("o_custkey", "day", "v", F.lit(False)))


@query("""WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, min_by(value, (ts, event_id)) AS o, max_by(value, (ts, event_id)) AS c FROM events GROUP BY ALL), g AS (SELECT *, o / nullif(lag(c) OVER (PARTITION BY user_id ORDER BY day), 0) - 1 AS gap, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n FROM b)
SELECT user_id, day, round(gap, 6) AS gap FROM g WHERE abs(gap) <= 0.25""")
def outlier_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Opening gaps of a quarter at most; greater ones are taken for splits or errors."""
    rows = series.bars(table(spark, d, "events"), "user_id", "ts", "value", "day")
    w = Window.partitionBy("user_id").orderBy("bar")
    gap = F.col("o") / F.nullif(F.lag("c").over(w), F.lit(0)) - 1
    return rows.withColumn("gap", gap).where(F.abs("gap") <= 0.25).select("user_id", F.to_date("bar").alias("day"), F.round("gap", 6).alias("gap"))


@query("SELECT event_id, CASE WHEN abs(hour(ts) - 9) < abs(hour(ts) - 17) THEN 9 ELSE 17 END AS cut FROM events")
def nearest_cut(spark: SparkSession, d: str) -> DataFrame:
    """The cut whose hour is nearest, the later of equals."""
    h = F.hour("ts")
    return table(spark, d, "events").select("event_id", F.when(F.abs(h - 9) < F.abs(h - 17), 9).otherwise(17).alias("cut"))


@query("""WITH a AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS c FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS t FROM a WHERE c <= 8)
SELECT source, doc_id FROM b WHERE t <= 14""")
def cap_per_class(spark: SparkSession, d: str) -> DataFrame:
    """At most eight rows of a class, then at most fourteen of a source, in order of arrival."""
    rows = table(spark, d, "documents").withColumn("c", F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))).where("c <= 8")
    return rows.withColumn("t", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("t <= 14").select("source", "doc_id")


@query("""WITH l AS (SELECT doc_id, [w for w in string_split(lower(text), ' ') if length(w) > 12] AS w FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(w)), ';') AS long_words, len(w) AS n FROM l WHERE len(w) > 0""")
def list_text(spark: SparkSession, d: str) -> DataFrame:
    """Long words of a text as a list in text form, sorted and distinct."""
    w = F.filter(F.split(F.lower("text"), " "), lambda x: F.length(x) > 12)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(w)), ";").alias("long_words"), F.size(w).cast("long").alias("n")).where("n > 0")


@query("SELECT p_brand, count(*) AS parts, round(avg(p_retailprice), 4) AS mean, median(p_retailprice) AS middle, min(p_size) AS smallest, max(p_size) AS largest FROM part GROUP BY 1")
def brand_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("parts"), F.round(F.avg("p_retailprice"), 4).alias("mean"), F.median("p_retailprice").alias("middle"), F.min("p_size").alias("smallest"), F.max("p_size").alias("largest"))


@query("""SELECT r_name, n_name, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY ROLLUP (r_name, n_name)""")
def sector_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Totals by nation, region and over all."""
    rows = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    both = rows.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.rollup("r_name", "n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


@query("SELECT page_id, sha1(regexp_replace(lower(url), '[?#].*$', '')) AS key FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(url), '[?#].*$', '') ORDER BY page_id) AS r FROM pages) WHERE r = 1")
def canonical_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each canonical address, with a stable key."""
    key = F.regexp_replace(F.lower("url"), r"[?#].*$", "")
    rows = series.newest(table(spark, d, "pages").withColumn("k", key), ["k"], [F.col("page_id")])
    return rows.select("page_id", F.sha1("k").alias("key"))


@query("SELECT regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS domain, count(*) AS pages FROM pages GROUP BY 1")
def pages_by_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(text.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))
