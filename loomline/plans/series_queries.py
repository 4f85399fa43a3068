"""Queries over events, orders and lineitem: sessions, as-of joins, series, gauges and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import numbers, times
from loomline.operators import aggregates, joins, series
from loomline.plans.registry import registry
from loomline.sources import table

QUERIES, SQL, query = registry()


def takes(spark: SparkSession, d: str) -> DataFrame:
    """Events as classified articles: a take from the type, a desk from the user."""
    take = F.when(F.col("event_type") == "purchase", "+").when(F.col("event_type") == "error", "-").when(F.col("event_type") == "view", "=").when(F.col("event_type") == "click", "")
    desk = F.when(F.col("user_id") % 3 == 0, "sm").when(F.col("user_id") % 3 == 1, "pp")
    return table(spark, d, "events").select("event_id", "ts", "user_id", "value", take.alias("take"), desk.alias("desk"))


def cuts(spark: SparkSession, d: str) -> DataFrame:
    """(day, cut, start, end): from 17:00 local of the business day before to the cut of the day, in UTC; days of the events."""
    span = table(spark, d, "events").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))  # one row
    days = span.select(F.explode(F.sequence("a", "b")).alias("day")).where(F.weekday("day") < 5)
    grid = days.select("day", F.explode(F.array(F.lit(9), F.lit(17))).alias("cut"))
    at = lambda d, h: times.to_utc(d.cast("timestamp") + F.make_interval(hours=h))
    return grid.select("day", "cut", at(times.previous_business_day(F.col("day")), F.lit(17)).alias("start"), at(F.col("day"), F.col("cut")).alias("end"))


CUTS = """
days AS (SELECT day FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events) WHERE isodow(day) < 6),
cuts AS (SELECT day, cut, (day - CASE WHEN isodow(day) = 1 THEN 3 ELSE 1 END)::TIMESTAMP + INTERVAL 20 HOUR AS s, day::TIMESTAMP + INTERVAL 3 HOUR + cut * INTERVAL 1 HOUR AS e FROM days, (VALUES (9), (17)) c(cut))"""
TAKES = """
takes AS (SELECT event_id, ts, user_id, value, CASE event_type WHEN 'purchase' THEN '+' WHEN 'error' THEN '-' WHEN 'view' THEN '=' WHEN 'click' THEN '' END AS take,
  CASE user_id % 3 WHEN 0 THEN 'sm' WHEN 1 THEN 'pp' END AS desk FROM events)"""


@query(f"""
WITH {CUTS}, {TAKES}, g AS (SELECT * FROM cuts, (VALUES ('all'), ('sm'), ('pp')) x(desk)),
c AS (SELECT g.day, g.cut, g.desk, count(t.event_id) AS n_items, count(*) FILTER (t.take = '+') AS up, count(*) FILTER (t.take = '-') AS down, count(*) FILTER (t.take = '=') AS neutral,
  count(*) FILTER (t.take = '') AS notake, count(*) FILTER (t.event_id IS NOT NULL AND t.take IS NULL) AS pending
  FROM g LEFT JOIN takes t ON t.ts >= g.s AND t.ts < g.e AND (g.desk = 'all' OR g.desk = t.desk) GROUP BY ALL)
SELECT *, CASE WHEN up + down + neutral >= 20 THEN CAST(round_even(50 + (up - down) / (up + down + neutral) * 50, 0) AS BIGINT) END AS gauge FROM c""")
def gauge_by_session(spark: SparkSession, d: str) -> DataFrame:
    """Takes counted per session, cut and desk, and their gauge. Sessions without a take have rows of zeros."""
    desks = F.explode(F.array_compact(F.array(F.lit("all"), F.col("desk")))).alias("desk")
    hit = joins.in_range(takes(spark, d), cuts(spark, d), "ts", "start", "end", 86_400)
    counts = hit.select("day", "cut", "take", desks).groupBy("day", "cut", "desk").agg(F.count("*").alias("n_items"), *aggregates.take_counts(F.col("take")))
    grid = cuts(spark, d).select("day", "cut").crossJoin(spark.sql("SELECT desk FROM VALUES ('all'), ('sm'), ('pp') AS g(desk)"))
    out = grid.join(counts, ["day", "cut", "desk"], "left").fillna(0)
    scored = F.col("up") + F.col("down") + F.col("neutral")
    return out.withColumn("gauge", aggregates.gauge(F.col("up"), F.col("down"), scored, 20))


@query(f"WITH {CUTS} SELECT day, cut, event_id FROM cuts JOIN events ON ts >= s AND ts < e")
def range_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each event with every (session, cut) whose window holds it."""
    return joins.in_range(table(spark, d, "events").select("event_id", "ts"), cuts(spark, d), "ts", "start", "end", 86_400).select("day", "cut", "event_id")


def _purchases(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("price"))
    return rows


PURCHASES = "p AS (SELECT user_id, ts, max(value) AS price FROM events WHERE event_type = 'purchase' GROUP BY ALL), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')"


@query(f"WITH {PURCHASES} SELECT e.event_id, e.user_id, e.ts, p.ts AS matched_ts, p.price FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts > p.ts")
def asof_prev(spark: SparkSession, d: str) -> DataFrame:
    """Each error with the user's latest purchase strictly before it."""
    errors = table(spark, d, "events").where("event_type = 'error'").select("user_id", "ts", "event_id")
    return joins.asof(errors, _purchases(spark, d), ["user_id"], "ts", ["price"])


@query(f"""WITH {PURCHASES}, j AS (SELECT e.event_id, e.user_id, e.ts, p.ts AS m, p.price FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts)
SELECT event_id, user_id, ts, CASE WHEN m >= ts - INTERVAL 30 HOUR THEN m END AS matched_ts, CASE WHEN m >= ts - INTERVAL 30 HOUR THEN price END AS price FROM j""")
def asof_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Each error with the user's latest purchase at or before it, no more than 30 hours old."""
    errors = table(spark, d, "events").where("event_type = 'error'").select("user_id", "ts", "event_id")
    return joins.asof(errors, _purchases(spark, d), ["user_id"], "ts", ["price"], strict=False, tolerance="30 HOURS")


@query("""
WITH t AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL), l AS (SELECT o_custkey, max(day) AS last_day FROM t GROUP BY 1)
SELECT o_custkey, last_day, max_by(total, day) AS last, max_by(total, day) FILTER (day <= last_day - 30) AS before FROM t JOIN l USING (o_custkey) GROUP BY ALL""")
def trailing_30d(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's last daily total and the one of the last day 30 days or more earlier."""
    daily = table(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    rows = daily.withColumn("last_day", F.max("day").over(Window.partitionBy("o_custkey")))
    early = F.col("day") <= F.date_sub("last_day", 30)
    return rows.groupBy("o_custkey", "last_day").agg(F.max_by("total", "day").alias("last"), F.max_by(F.when(early, F.col("total")), F.when(early, F.col("day"))).alias("before"))


@query("""
WITH a AS (SELECT *, lag(ts) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, 1 + sum(CASE WHEN epoch_us(ts) - epoch_us(p) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM a)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS stamp, max_by(value, (ts, event_id)) AS value, count(*) AS n FROM b GROUP BY ALL""")
def sessionise_gap(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users, ended by six hours without an event: first stamp, last value, events."""
    rows = series.sessions(table(spark, d, "events"), "user_id", "ts", 6 * 3600)
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("stamp"), F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n"))


@query("""
WITH a AS (SELECT user_id, ts, event_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM a WHERE f)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS length FROM b GROUP BY user_id, g HAVING count(*) >= 2""")
def islands_flag(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two or more errors in a row."""
    return series.islands(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2)


@query("SELECT user_id, day, event_id, value FROM (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def dedup_by_day(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user and UTC day."""
    rows = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return series.newest(rows, ["user_id", "day"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "day", "event_id", "value")


DAILY = "daily AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""
WITH {DAILY}, r AS (SELECT *, max(day) OVER (PARTITION BY series) AS e, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS n FROM daily),
b AS (SELECT series, max(day) AS last_day, max_by(total, day) AS last, max(total) FILTER (n = 2) AS d, max_by(total, day) FILTER (day <= e - 7) AS w, max_by(total, day) FILTER (day <= e - 30) AS m,
  max_by(total, day) FILTER (day <= e - 365) AS y, max_by(total, day) FILTER (day < date_trunc('year', e)) AS ytd FROM r GROUP BY series)
SELECT series, last_day, last, round((last - d) / nullif(abs(d), 0) * 100, 2) AS d, round((last - w) / nullif(abs(w), 0) * 100, 2) AS w, round((last - m) / nullif(abs(m), 0) * 100, 2) AS m,
  round((last - y) / nullif(abs(y), 0) * 100, 2) AS y, round((last - ytd) / nullif(abs(ytd), 0) * 100, 2) AS ytd FROM b""")
def period_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes over a point, week, month, year and since the year's start of each priority's daily total."""
    return series.period_changes(_daily(spark, d), "series", "day", "total")


@query(f"WITH {DAILY} SELECT series, day, round(total / nullif(lag(total) OVER (PARTITION BY series ORDER BY day), 0) - 1, 6) AS ret FROM daily")
def lag_return(spark: SparkSession, d: str) -> DataFrame:
    return series.lag_return(_daily(spark, d), "series", "day", "total").select("series", "day", F.round("ret", 6).alias("ret"))


BARS = "bars AS (SELECT user_id, date_trunc('{0}', ts) AS bar, min_by(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l, max_by(value, (ts, event_id)) AS c, count(*) AS volume FROM events GROUP BY ALL)"


@query(f"WITH {BARS.format('day')} SELECT user_id, bar, o, h, l, c, volume, round(o / nullif(lag(c) OVER (PARTITION BY user_id ORDER BY bar), 0) - 1, 6) AS gap FROM bars")
def opening_gap(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of each user and the gap from the close before to the open."""
    w = Window.partitionBy("user_id").orderBy("bar")
    rows = series.bars(table(spark, d, "events"), "user_id", "ts", "value", "day")
    return rows.withColumn("gap", F.round(F.col("o") / F.nullif(F.lag("c").over(w), F.lit(0)) - 1, 6))


@query(f"WITH {BARS.format('hour')} SELECT user_id, CAST(bar AS DATE) AS day, count(*) AS bars, count(*) FILTER (volume <= 1 AND o = h AND h = l AND l = c) AS phantom FROM bars GROUP BY ALL")
def phantom_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars per user and day, and those with one price and no trade beyond the first."""
    rows = series.bars(table(spark, d, "events"), "user_id", "ts", "value")
    flat = (F.col("volume") <= 1) & (F.col("o") == F.col("h")) & (F.col("h") == F.col("l")) & (F.col("l") == F.col("c"))
    return rows.groupBy("user_id", F.to_date("bar").alias("day")).agg(F.count("*").alias("bars"), F.count_if(flat).alias("phantom"))


@query("""
WITH b AS (SELECT user_id, ts, max(value) AS value FROM events GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM b),
k AS (SELECT *, least(n, 30) AS k FROM a), p AS (SELECT *, floor(i * (k - 1) / greatest(n - 1, 1) + 0.5) AS place FROM k)
SELECT user_id, CAST(place AS BIGINT) AS place, CAST(CASE WHEN hi = lo THEN 500 ELSE floor((value - lo) / (hi - lo) * 1000 + 0.5) END AS BIGINT) AS scaled
FROM p WHERE floor(place * (n - 1) / greatest(k - 1, 1) + 0.5) = i""")
def resample_scale(spark: SparkSession, d: str) -> DataFrame:
    """Sparklines: at most 30 points of each user's series, scaled to 0..1000."""
    rows = table(spark, d, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return series.resampled(rows, "user_id", "ts", "value", 30)


@query("""
WITH s AS (SELECT l_returnflag, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS month, round(sum(l_quantity), 2) AS value FROM lineitem WHERE month(l_shipdate) <> 6 GROUP BY ALL),
g AS (SELECT l_returnflag, unnest(range(min(month), max(month) + 1)) AS month FROM s GROUP BY 1)
SELECT l_returnflag, CAST(month AS INTEGER) AS month, value FROM g LEFT JOIN s USING (l_returnflag, month)""")
def month_dense(spark: SparkSession, d: str) -> DataFrame:
    """Monthly quantity per return flag; June is missing in the source and comes out as null."""
    rows = table(spark, d, "lineitem").where(F.month("l_shipdate") != 6)
    return series.dense_months(rows, ["l_returnflag"], "l_shipdate", F.round(F.sum("l_quantity"), 2))


RARE = "m AS (SELECT l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS month, round(sum(l_quantity), 2) AS value FROM lineitem WHERE l_suppkey % 10 = month(l_shipdate) % 10 OR l_quantity > 49 GROUP BY ALL)"
RUNS = f"""WITH {RARE}, a AS (SELECT *, sum(CASE WHEN month - p - 1 > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY month) AS run FROM (SELECT *, lag(month) OVER (PARTITION BY l_suppkey ORDER BY month) AS p FROM m)),
s AS (SELECT l_suppkey, run, min(month) AS start, max(month) AS stop FROM a GROUP BY ALL)"""


def _rare(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where((F.col("l_suppkey") % 10 == F.month("l_shipdate") % 10) | (F.col("l_quantity") > 49))
    return rows.groupBy("l_suppkey", times.month_index(F.col("l_shipdate")).alias("month")).agg(F.round(F.sum("l_quantity"), 2).alias("value"))


@query(f"{RUNS} SELECT l_suppkey, CAST(start AS INTEGER) AS start, CAST(stop - start + 1 AS INTEGER) AS months, count(value) AS filled FROM s JOIN m USING (l_suppkey) WHERE month BETWEEN start AND stop GROUP BY ALL")
def rle_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of months of each supplier, broken by more than three missing ones."""
    rows = series.run_length(_rare(spark, d), "l_suppkey", "month", "value", 3)
    return rows.select("l_suppkey", "start", F.size("values").alias("months"), F.size(F.array_compact("values")).cast("long").alias("filled"))


@query(f"WITH {RARE} SELECT l_suppkey, CAST(month AS INTEGER) AS month, value FROM m")
def rle_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Runs encoded and decoded again: the series as it was."""
    return series.run_decode(series.run_length(_rare(spark, d), "l_suppkey", "month", "value", 3), "l_suppkey")


@query("WITH v AS (SELECT p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM part) SELECT DISTINCT p_name, CAST(code AS BIGINT) AS code FROM v")
def dict_encode(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary of part names: codes by order."""
    return aggregates.dictionary(table(spark, d, "part"), "p_name")


@query("SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'")
def pair_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of supplier and brand on both sides of the trade."""
    both = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    side = lambda flag: both.where(F.col("l_returnflag") == flag).select("l_suppkey", "p_brand")
    return side("A").intersect(side("R"))


@query("""
WITH f AS (SELECT o_custkey, count(*) AS orders_n, round(sum(o_totalprice), 2) AS total, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1)
SELECT c_custkey, n_name, r_name, coalesce(orders_n, 0) AS orders_n, total, latest FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN f ON c_custkey = o_custkey""")
def facts_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their nation, region and facts of their orders; no orders: nulls and a count of zero."""
    facts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders_n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    out = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.join(facts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "n_name", "r_name", F.coalesce("orders_n", F.lit(0)).alias("orders_n"), "total", "latest")


@query("""
SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END), 2) AS net, count(*) AS trades, bool_or(l_quantity > 49) AS any_large, count(DISTINCT l_partkey) AS parts
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY 1""")
def signed_net(spark: SparkSession, d: str) -> DataFrame:
    """Net quantity (returns negative), trades, any large one and distinct parts of each supplier."""
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp"))
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return rows.groupBy("l_suppkey").agg(F.round(F.sum(signed), 2).alias("net"), F.count("*").alias("trades"), F.bool_or(F.col("l_quantity") > 49).alias("any_large"), F.count_distinct("l_partkey").alias("parts"))


@query("""
SELECT n_nationkey, s_suppkey, s_name FROM nation LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_suppkey % 25 = s_nationkey) DESC, s_suppkey) AS r FROM supplier) s ON s_nationkey = n_nationkey AND r = 1""")
def preferred_match(spark: SparkSession, d: str) -> DataFrame:
    """Each nation with its preferred supplier, else its first."""
    suppliers = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return joins.preferred_match(table(spark, d, "nation").select("n_nationkey"), suppliers, "n_nationkey", F.col("s_suppkey") % 25 == F.col("n_nationkey"), [F.col("s_suppkey")]).select("n_nationkey", "s_suppkey", "s_name")


@query("""
WITH n AS (SELECT max(ts) AS now FROM events), c AS (SELECT user_id, count(*) AS seen, max(ts) AS last, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000 AS span FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 5)
SELECT user_id, seen, last, round(span / (seen - 1), 4) AS avg_gap_h, round(least(greatest(span / (seen - 1) * 5, 72), 336), 4) AS limit_h, (epoch_us(now) - epoch_us(last)) / 3600000000 > least(greatest(span / (seen - 1) * 5, 72), 336) AS silent FROM c, n""")
def coverage_cadence(spark: SparkSession, d: str) -> DataFrame:
    """How often each user buys, and who has fallen silent."""
    rows = table(spark, d, "events")
    last = rows.agg(F.max("ts").alias("now"))
    bought = rows.where("event_type = 'purchase'").crossJoin(F.broadcast(last))
    return aggregates.cadence(bought, "user_id", "ts", F.max("now"))


@query(f"""WITH {TAKES}, c AS (SELECT CAST(ts AS DATE) AS day, coalesce(take, '?') AS k, count(*) AS n FROM takes GROUP BY ALL) SELECT day, string_agg(k || ':' || n, ',' ORDER BY k) AS counts FROM c GROUP BY day""")
def counter_maps(spark: SparkSession, d: str) -> DataFrame:
    """Takes per day as a map, written out in key order."""
    out = aggregates.counter_map(takes(spark, d).withColumn("day", F.to_date("ts")), ["day"], F.col("take"))
    return out.select("day", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("counts"))


@query("""WITH b AS (SELECT user_id, date_trunc('day', ts) AS day, avg(value) AS x, max(value) AS y FROM events GROUP BY ALL), c AS (SELECT user_id, round(x, 6) AS x, y FROM b),
r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY x) + (count(*) OVER (PARTITION BY user_id, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY user_id ORDER BY y) + (count(*) OVER (PARTITION BY user_id, y) - 1) / 2 AS ry FROM c)
SELECT user_id, count(*) AS n, round(CASE WHEN count(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END, 6) AS rho FROM r GROUP BY user_id""")
def spearman_ic(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation, per user, of a day's mean and greatest value."""
    daily = table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("x"), F.max("value").alias("y"))
    return aggregates.spearman(daily, ["user_id"], "x", "y").select("user_id", "n", F.round("rho", 6).alias("rho"))


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM events GROUP BY 1)
SELECT event_type, round(lo, 6) AS q10, round(hi, 6) AS q90, round(avg(CASE WHEN value >= lo AND value <= hi THEN 1.0 ELSE 0.0 END), 6) AS covered FROM events JOIN q USING (event_type) GROUP BY event_type, lo, hi""")
def quantile_band(spark: SparkSession, d: str) -> DataFrame:
    """The middle four fifths of values per type, and the share that they hold."""
    rows = table(spark, d, "events")
    band = rows.groupBy("event_type").agg(F.percentile("value", 0.1).alias("lo"), F.percentile("value", 0.9).alias("hi"))
    hit = F.avg(((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))).cast("int"))
    return rows.join(band, "event_type").groupBy("event_type", "lo", "hi").agg(F.round(hit, 6).alias("covered")).select("event_type", F.round("lo", 6).alias("q10"), F.round("hi", 6).alias("q90"), "covered")


@query("""WITH b AS (SELECT CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS band, user_id, event_type FROM events)
SELECT user_id % 10 AS grp, band, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(avg(CASE WHEN event_type IN ('purchase', 'click') THEN 1.0 ELSE 0.0 END), 6) END AS hit FROM b GROUP BY ALL""")
def hit_bands(spark: SparkSession, d: str) -> DataFrame:
    """Hit rates by band of magnitude, null for fewer than 20 rows."""
    band = F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "mid").otherwise("high")
    hit = F.avg(F.col("event_type").isin("purchase", "click").cast("int"))
    return table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("grp"), band.alias("band")).agg(F.count("*").alias("n"), F.when(F.count("*") >= 20, F.round(hit, 6)).alias("hit"))


WEIGHTS = [round((k % 7 - 3) / 10, 1) for k in range(64)]


@query(f"SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: ({WEIGHTS})[i]::DOUBLE * embedding[i]::DOUBLE)), 5) AS score FROM embeddings")
def dot_score(spark: SparkSession, d: str) -> DataFrame:
    """A linear score of each vector; null if any element is missing."""
    return table(spark, d, "embeddings").select("vec_id", F.round(aggregates.dot(WEIGHTS, F.col("embedding")), 5).alias("score"))


@query(f"""WITH a AS (SELECT vec_id, unnest(range(1, 65)) AS i, embedding FROM embeddings), b AS (SELECT vec_id, i - 1 AS feature, round(({WEIGHTS})[i]::DOUBLE * embedding[i]::DOUBLE, 6) AS part FROM a)
SELECT vec_id, CAST(feature AS INTEGER) AS feature, part FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(part) DESC, feature) AS r FROM b) WHERE r <= 5""")
def top5_drivers(spark: SparkSession, d: str) -> DataFrame:
    """The five largest contributions to each score, picked inside the row."""
    w = F.array(*[F.lit(x) for x in WEIGHTS])
    parts = F.transform(F.col("embedding"), lambda x, i: F.struct((-F.abs(F.round(F.get(w, i) * x.cast("double"), 6))).alias("o"), i.alias("feature"), F.round(F.get(w, i) * x.cast("double"), 6).alias("part")))
    return table(spark, d, "embeddings").select("vec_id", F.explode(F.slice(F.array_sort(parts), 1, 5)).alias("p")).select("vec_id", "p.feature", "p.part")


@query("""WITH r AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), s AS (SELECT label, count(*) AS n, avg(y) AS intercept, corr(x, y) * stddev_samp(y) * (count(*) - 1) / (count(*) - 1 + 10) AS beta FROM r GROUP BY label)
SELECT label, n, round(intercept, 5) AS intercept, round(beta, 5) AS beta FROM s""")
def ridge_fit(spark: SparkSession, d: str) -> DataFrame:
    """Ridge with one feature per label, where SQL has the closed form."""
    rows = table(spark, d, "embeddings").select("label", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    return aggregates.ridge(rows, ["label"], ["x"], "y", 10).select("label", "n", F.round("intercept", 5).alias("intercept"), F.round("beta_x", 5).alias("beta"))


@query()
def ridge_panel(spark: SparkSession, d: str) -> DataFrame:
    """Ridge with eight features per label."""
    rows = table(spark, d, "embeddings").select("label", *[F.get("embedding", i).cast("double").alias(f"x{i}") for i in range(9)])
    return aggregates.ridge(rows, ["label"], [f"x{i}" for i in range(8)], "x8", 10)


@query("SELECT strftime(ts, '%G-w%V') AS week, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last, count(*) AS n FROM events GROUP BY 1")
def iso_week_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Events per ISO week."""
    return table(spark, d, "events").groupBy(times.iso_week(F.col("ts")).alias("week")).agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"), F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT user_id, fold, count(*) AS tested FROM (SELECT user_id, CAST(floor((n - 21) / 10) AS BIGINT) AS fold FROM a WHERE n > 20) GROUP BY ALL""")
def walk_forward_folds(spark: SparkSession, d: str) -> DataFrame:
    """Folds of a walk forward: 20 rows to begin with, blocks of ten."""
    rows = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return series.folds(rows, "user_id", "at", 20, 10).where("fold IS NOT NULL").groupBy("user_id", "fold").agg(F.count("*").alias("tested"))


@query("""WITH s AS (SELECT event_type, avg(value) AS mu, stddev_samp(value) AS sd FROM events GROUP BY 1) SELECT event_id, round((value - mu) / coalesce(nullif(sd, 0), 1), 5) AS z FROM events JOIN s USING (event_type)""")
def standardised_values(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.standardised(table(spark, d, "events"), ["event_type"], "value", "z").select("event_id", F.round("z", 5).alias("z"))


@query("SELECT o_orderkey, d - CAST(CASE isodow(d) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS INTEGER) AS prior_day, d - CAST(greatest(isodow(d) - 5, 0) AS INTEGER) AS friday, CAST(last_day(d + INTERVAL 18 MONTH) AS DATE) AS horizon, CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) + CAST(day(d) - 1 AS INTEGER) AS month_ago FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def calendar_marks(spark: SparkSession, d: str) -> DataFrame:
    """Previous business day, Friday for weekends, month end 18 months on, and a month back that runs over."""
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", times.previous_business_day(day).alias("prior_day"), times.back_to_friday(day).alias("friday"), times.month_end_plus(day, 18).alias("horizon"), times.minus_months(day, 1).alias("month_ago"))


@query("""WITH l AS (SELECT ts - INTERVAL 3 HOUR AS t, value FROM events), s AS (SELECT CASE WHEN hour(t) < 7 THEN date_trunc('day', t)::TIMESTAMP - INTERVAL 4 HOUR WHEN hour(t) >= 20 THEN date_trunc('day', t)::TIMESTAMP + INTERVAL 20 HOUR ELSE date_trunc('hour', t)::TIMESTAMP END AS slot, value FROM l)
SELECT slot, count(*) AS n, max(value) AS top FROM s GROUP BY slot""")
def hour_and_night_slots(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour from 7 to 20 local time, and by night."""
    return table(spark, d, "events").groupBy(times.slot_start(F.col("ts")).alias("slot")).agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def keep_last_points(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return series.keep_last(rows, "user_id", "at", 5).select("user_id", "event_id")


@query("""WITH a AS (SELECT user_id AS k, CAST(ts AS DATE) AS day, sum(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL), b AS (SELECT user_id AS k, CAST(ts AS DATE) AS day, sum(value) AS v FROM events WHERE event_type = 'click' GROUP BY ALL),
j AS (SELECT k, day, b.v / a.v AS r, row_number() OVER (PARTITION BY k ORDER BY day) AS n FROM a JOIN b USING (k, day) WHERE a.v <> 0)
SELECT k, round(CASE WHEN count(*) >= 3 THEN median(r) END, 5) AS ratio FROM j WHERE n <= 10 GROUP BY k""")
def scale_bridge(spark: SparkSession, d: str) -> DataFrame:
    """The median ratio of two series of a user over their first ten common days."""
    daily = lambda kind: table(spark, d, "events").where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("k"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return joins.bridge(daily("view"), daily("click"), "k", "day", "v").select("k", F.round("ratio", 5).alias("ratio"))


@query("""WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY ALL)
SELECT feature, round(share, 6) AS share, share >= 0.35 AS kept FROM (SELECT unnest(['view', 'click', 'purchase']) AS feature, unnest([avg(CASE WHEN view IS NULL THEN 0 ELSE 1 END), avg(CASE WHEN click IS NULL THEN 0 ELSE 1 END), avg(CASE WHEN purchase IS NULL THEN 0 ELSE 1 END)]) AS share FROM p)""")
def feature_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A panel by user and day: which features are there often enough."""
    panel = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).pivot("event_type", ["view", "click", "purchase"]).agg(F.max("value"))
    return aggregates.coverage(panel, ["view", "click", "purchase"], 0.35)


@query("SELECT event_id, floor(value + 0.5)::BIGINT AS rounded, CASE WHEN value > 100 THEN 100 WHEN value < 1 THEN 1 ELSE value END AS clipped, round((value - 20) / 20 * 100, 4) AS change FROM events")
def number_marks(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", numbers.half_up(v).alias("rounded"), numbers.clip(v, 1, 100).alias("clipped"), F.round(numbers.percent_change(v, F.lit(20.0)), 4).alias("change"))
