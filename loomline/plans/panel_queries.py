"""Queries on repaired series, budgets, rankings, fingerprints, scores and marks of the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import times
from loomline.operators import aggregates, budgets, repair
from loomline.plans.registry import registry
from loomline.plans.series_queries import WEIGHTS
from loomline.sources import table

QUERIES, SQL, query = registry()


_DAILY = """s AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS v, count(*) = 1 AS phantom FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL),
b AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL)"""


def _daily(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored daily values (of one event: a phantom) and rebuilt ones."""
    rows = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    stored = rows.where("event_type IN ('view', 'click')").groupBy("user_id", "day").agg(F.max("value").alias("v"), (F.count("*") == 1).alias("phantom"))
    return stored, rows.where("event_type = 'purchase'").groupBy("user_id", "day").agg(F.max("value").alias("v"))


@query(f"""WITH {_DAILY}, r AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM s GROUP BY 1), j AS (SELECT coalesce(s.user_id, b.user_id) AS user_id, coalesce(s.day, b.day) AS day, s.v AS sv, b.v AS bv, phantom FROM s FULL JOIN b ON s.user_id = b.user_id AND s.day = b.day)
SELECT j.user_id, day, CASE WHEN phantom = false THEN sv ELSE bv END AS v, CASE WHEN phantom IS NULL THEN 'filled' WHEN phantom THEN 'rebuilt' ELSE 'stored' END AS origin FROM j JOIN r ON j.user_id = r.user_id WHERE day BETWEEN lo AND hi AND (phantom = false OR bv IS NOT NULL)""")
def series_repair(spark: SparkSession, d: str) -> DataFrame:
    """Phantom days replaced by rebuilt values or removed, gaps inside the span filled."""
    stored, rebuilt = _daily(spark, d)
    return repair.repaired(stored, rebuilt, "user_id", "day", "v", "phantom")


@query(f"WITH {_DAILY} SELECT user_id, count(*) AS n, count(*) FILTER (s.v = b.v) AS identical, round(avg(abs(b.v / nullif(s.v, 0) - 1) * 100), 4) AS mean_pct, round(max(abs(b.v / nullif(s.v, 0) - 1) * 100), 4) AS worst_pct FROM s JOIN b USING (user_id, day) GROUP BY user_id")
def rebuild_errors(spark: SparkSession, d: str) -> DataFrame:
    """How far rebuilt values are from the stored ones."""
    return repair.errors(*_daily(spark, d), "user_id", "day", "v")


@query(f"""WITH {_DAILY}, l AS (SELECT user_id, day, CASE WHEN user_id % 4 = 0 AND day = DATE '2024-01-20' THEN v + 1 ELSE v END AS v FROM s WHERE day >= DATE '2024-01-10'),
c AS (SELECT s.user_id, bool_or(s.v <> l.v) AS conflict FROM s JOIN l USING (user_id, day) GROUP BY 1), u AS (SELECT user_id, day, v FROM s WHERE day < DATE '2024-01-15' UNION ALL SELECT user_id, day, v FROM l WHERE day >= DATE '2024-01-15')
SELECT u.*, coalesce(conflict, false) AS conflict FROM u LEFT JOIN c USING (user_id)""")
def series_junction(spark: SparkSession, d: str) -> DataFrame:
    """Old points before a cut, light ones from it on, and whether the two disagree where both hold a day."""
    old = _daily(spark, d)[0]
    odd = (F.col("user_id") % 4 == 0) & (F.col("day") == F.lit("2024-01-20").cast("date"))
    light = old.where("day >= '2024-01-10'").withColumn("v", F.when(odd, F.col("v") + 1).otherwise(F.col("v")))
    return repair.junction(old, light, "user_id", "day", "v", F.lit("2024-01-15").cast("date"))


@query(f"""WITH {_DAILY}, m AS (SELECT *, max(day) OVER (PARTITION BY user_id) - day AS back FROM s), g AS (SELECT user_id, count(*) FILTER (back < 7) AS a, count(*) FILTER (back < 14) AS b2, count(*) FILTER (back < 21) AS c,
count(DISTINCT v) FILTER (back < 7) AS da, count(DISTINCT v) FILTER (back < 14) AS db FROM m GROUP BY 1) SELECT user_id, CASE WHEN a >= 6 AND da >= 4 THEN 7 WHEN b2 >= 6 AND db >= 4 THEN 14 ELSE 21 END AS width, CASE WHEN a >= 6 AND da >= 4 THEN a WHEN b2 >= 6 AND db >= 4 THEN b2 ELSE c END AS n FROM g""")
def adaptive_window(spark: SparkSession, d: str) -> DataFrame:
    """The narrowest window of weeks that holds enough points."""
    return repair.widened(_daily(spark, d)[0], "user_id", "day", "v", 7, 6, 4)


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id FROM events),
r AS (SELECT user_id, n, event_id, t, value, 500.0::DOUBLE AS available FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.event_id, e.t, e.value, least(500.0, r.available - r.value + (e.t - r.t) / 1000000.0 * 0.002) FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, round(available, 3) AS available FROM r""")
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    """The budget each user has left before each event: it accrues up to 500, events spend their value."""
    rows = budgets.token_bucket(table(spark, d, "events"), "user_id", ["ts", "event_id"], "ts", "value", 500.0, 0.002)
    return rows.select("event_id", F.round("available", 3).alias("available"))


@query("""WITH a AS (SELECT event_id, row_number() OVER w AS attempt, coalesce(sum((event_type IN ('error', 'view'))::INT) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS bad FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id))
SELECT event_id, attempt, attempt <= 8 AND bad < 3 AS allowed FROM a""")
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    """Attempts per user and day: eight at most, none just after three failures in a row."""
    rows = table(spark, d, "events").withColumn("k", F.concat_ws("|", "user_id", F.to_date("ts")))
    return budgets.attempts(rows, "k", ["ts", "event_id"], F.col("event_type").isin("error", "view"), 8, 3).select("event_id", "attempt", "allowed")


@query("""SELECT event_id, round(used, 2) AS used FROM (SELECT event_id, sum(value) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_type = 'purchase' DESC, event_id) AS used FROM events) WHERE used <= 400""")
def daily_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Work of each day within its quota, purchases first."""
    rows = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return budgets.backlog(rows, "day", F.col("event_type") == "purchase", "event_id", "value", 400.0).select("event_id", F.round("used", 2).alias("used"))


@query("""WITH l AS (SELECT l_suppkey, count(*) AS load, sum(l_quantity) AS q FROM lineitem GROUP BY 1), h AS (SELECT s_nationkey, s_suppkey, s_acctbal < 3000 AS slow, s_acctbal, 1 - load / 700 AS headroom FROM supplier JOIN l ON s_suppkey = l_suppkey),
k AS (SELECT *, max(headroom) OVER (PARTITION BY s_nationkey) AS top, row_number() OVER (PARTITION BY s_nationkey ORDER BY headroom DESC, s_suppkey) AS b FROM h)
SELECT s_nationkey, s_suppkey, round(headroom, 6) AS headroom, row_number() OVER (PARTITION BY s_nationkey ORDER BY slow, s_acctbal DESC, headroom DESC, s_suppkey) AS place FROM k WHERE headroom >= 0.2 OR (top < 0.2 AND b = 1)""")
def provider_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of each nation with room for more work, in the order to ask them."""
    load = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("load"))
    rows = table(spark, d, "supplier").join(load, "s_suppkey").withColumns({"slow": F.col("s_acctbal") < 3000, "capacity": F.lit(700)})
    return budgets.ranked_providers(rows, "s_nationkey", "s_suppkey", "load", "capacity", "slow", "s_acctbal").select("s_nationkey", "s_suppkey", F.round("headroom", 6).alias("headroom"), "place")


@query("SELECT o_orderpriority, count(*) AS n, sum(('0x' || substr(sha1(o_orderkey || '|' || o_orderstatus), 1, 12))::BIGINT)::VARCHAR AS print FROM orders GROUP BY 1")
def group_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Digests of groups that do not depend on the order of rows."""
    return aggregates.fingerprint(table(spark, d, "orders"), ["o_orderpriority"], ["o_orderkey", "o_orderstatus"]).withColumn("print", F.col("print").cast("string"))


@query("""WITH a AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-04' GROUP BY ALL), b AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-28' GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, round((coalesce(a.v, 0) + coalesce(b.v, 0)) / 2, 5) AS v FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def sparse_model_mean(spark: SparkSession, d: str) -> DataFrame:
    """Two sparse sets of weights averaged over the union of their keys."""
    rows, cut = table(spark, d, "events"), lambda s: F.lit(s).cast("timestamp_ntz")
    side = lambda c: rows.where(c).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    got = aggregates.sparse_mean(side(F.col("ts") < cut("2024-01-04")), side(F.col("ts") >= cut("2024-01-28")), ["user_id", "event_type"], "v")
    return got.withColumn("v", F.round("v", 5))


@query("WITH r AS (SELECT user_id, event_type, value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS x FROM events) SELECT user_id, event_type, count(x) AS n, round(abs(avg(sign(x))), 6) AS agreement FROM r GROUP BY ALL")
def sign_concordance(spark: SparkSession, d: str) -> DataFrame:
    """How far the changes of each series go one way."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("x", F.col("value") - F.lag("value").over(w))
    return rows.groupBy("user_id", "event_type").agg(F.count("x").alias("n"), F.round(aggregates.concordance(F.col("x")), 6).alias("agreement"))


@query("""WITH p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), r AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY x) + (count(*) OVER (PARTITION BY label, x) - 1) / 2 AS a, rank() OVER (PARTITION BY label ORDER BY y) + (count(*) OVER (PARTITION BY label, y) - 1) / 2 AS b FROM p),
c AS (SELECT label, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY 1) SELECT label, n, round(rho, 6) AS rho, CASE WHEN n < 10 OR rho IS NULL THEN 'few' WHEN rho * sqrt(n) < -1 THEN 'broken' WHEN rho * sqrt(n) < 1.65 THEN 'weak' ELSE 'holds' END AS verdict FROM c""")
def drift_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether a rank correlation holds, by group."""
    rows = table(spark, d, "embeddings").select("label", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    got = aggregates.spearman(rows, ["label"], "x", "y")
    return got.select("label", "n", F.round("rho", 6).alias("rho"), aggregates.drift(F.col("rho"), F.col("n")).alias("verdict"))


@query(f"""WITH a AS (SELECT vec_id, unnest(range(1, 65)) AS i, embedding FROM embeddings), b AS (SELECT vec_id, (i - 1) // 16 AS block, sum(({WEIGHTS})[i]::DOUBLE * embedding[i]::DOUBLE) AS part FROM a GROUP BY ALL)
SELECT vec_id, CAST(block AS INTEGER) AS block, round(part, 5) AS part, row_number() OVER (PARTITION BY vec_id ORDER BY abs(round(part, 5)) DESC, block) AS place FROM b""")
def block_contributions(spark: SparkSession, d: str) -> DataFrame:
    """Contributions to a score by block of features, the greatest first, within the row."""
    w = F.array(*[F.lit(x) for x in WEIGHTS])
    parts = F.zip_with(w, F.col("embedding"), lambda a, x: a * x.cast("double"))
    total = lambda b: F.round(F.aggregate(F.slice("parts", b * 16 + 1, 16), F.lit(0.0), lambda s, x: s + x), 5)
    blocks = F.array_sort(F.array(*[F.struct((-F.abs(total(b))).alias("o"), F.lit(b).alias("block"), total(b).alias("part")) for b in range(4)]))
    rows = table(spark, d, "embeddings").select("vec_id", parts.alias("parts")).select("vec_id", F.posexplode(blocks).alias("p", "b"))
    return rows.select("vec_id", "b.block", "b.part", (F.col("p") + 1).cast("long").alias("place"))


@query("""WITH r AS (SELECT vec_id, label, embedding[1]::DOUBLE AS y, embedding[2]::DOUBLE AS t FROM embeddings), s AS (SELECT label, stddev_pop(y) AS sigma, quantile_cont(t - y, 0.1) AS lo, quantile_cont(t - y, 0.9) AS hi, corr(y, t) AS ic, count(*) AS n FROM r GROUP BY 1)
SELECT vec_id, round(greatest(-1, least(1, y / (2 * sigma))) * 100, 1) AS score, round((y + lo) * 100, 4) AS low, round((y + hi) * 100, 4) AS high, CASE WHEN n < 10 THEN 'no data' WHEN ic < 0 THEN 'no signal' ELSE 'ok' END AS status FROM r JOIN s USING (label)""")
def publish_gate(spark: SparkSession, d: str) -> DataFrame:
    """A score with its band from residuals, and whether it may be published. The statistics are one row per label."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.get("embedding", 0).cast("double").alias("y"), F.get("embedding", 1).cast("double").alias("t"))
    e = F.col("t") - F.col("y")
    stats = rows.groupBy("label").agg(F.stddev_pop("y").alias("sigma"), F.percentile(e, 0.1).alias("lo"), F.percentile(e, 0.9).alias("hi"), F.corr("y", "t").alias("ic"), F.count("*").alias("n"))
    status = F.when(F.col("n") < 10, "no data").when(F.col("ic") < 0, "no signal").otherwise("ok")
    band = lambda q: F.round((F.col("y") + F.col(q)) * 100, 4)
    return rows.join(stats, "label").select("vec_id", aggregates.score(F.col("y"), F.col("sigma")).alias("score"), band("lo").alias("low"), band("hi").alias("high"), status.alias("status"))


@query("""WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS k FROM customer GROUP BY ALL), t AS (SELECT *, sum(k) OVER (PARTITION BY c_nationkey) AS n FROM g) SELECT c_nationkey, c_mktsegment, round(100.0 * k / n, 2) AS pct FROM t WHERE n >= 5""")
def family_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of segments per nation, for nations of enough customers."""
    each = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("k"))
    rows = each.withColumn("n", F.sum("k").over(Window.partitionBy("c_nationkey"))).where("n >= 5")
    return rows.select("c_nationkey", "c_mktsegment", F.round(F.col("k") * 100.0 / F.col("n"), 2).alias("pct"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS v FROM events GROUP BY ALL), p AS (SELECT user_id, day + 1 AS day, v AS guess FROM d WHERE dayofmonth(day) % 3 = 0)
SELECT user_id, day, guess, v AS outcome, sign(guess - 50) = sign(v - 50) AS hit FROM p JOIN d USING (user_id, day)""")
def outcome_join(spark: SparkSession, d: str) -> DataFrame:
    """Open predictions and what came of them the day after."""
    daily = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("v"))
    made = daily.where("day(day) % 3 = 0").select("user_id", F.date_add("day", 1).alias("day"), F.col("v").alias("guess"))
    hit = F.signum(F.col("guess") - 50) == F.signum(F.col("v") - 50)
    return made.join(daily, ["user_id", "day"]).select("user_id", "day", "guess", F.col("v").alias("outcome"), hit.alias("hit"))


@query("""SELECT event_id, CASE WHEN ts >= date_trunc('day', ts) + INTERVAL '6 hours 30 minutes' THEN date_trunc('day', ts) + INTERVAL '6 hours 30 minutes' ELSE date_trunc('day', ts) - INTERVAL '17 hours 30 minutes' END AS daily,
CASE WHEN ts >= date_trunc('week', ts) + INTERVAL '8 hours' THEN date_trunc('week', ts) + INTERVAL '8 hours' ELSE date_trunc('week', ts) - INTERVAL '160 hours' END AS weekly FROM events""")
def due_marks(spark: SparkSession, d: str) -> DataFrame:
    """The last daily mark at 06:30 and the last weekly one, on Monday at 08:00, that each event has passed."""
    mark = lambda unit, back: times.last_mark(F.col("ts"), unit, back).cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", mark("day", 390).alias("daily"), mark("week", 480).alias("weekly"))


@query("""WITH l AS (SELECT max(CAST(ts AS DATE)) AS last FROM events) SELECT event_id FROM events, l WHERE CAST(ts AS DATE) >= last - 10 AND date_trunc('week', ts) < date_trunc('week', last)""")
def evicted_state(spark: SparkSession, d: str) -> DataFrame:
    """Rows of complete weeks within ten days of the last day: what a bounded state keeps besides the week that runs."""
    rows = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))
    last = rows.agg(F.max("day").alias("last"))
    kept = (F.col("day") >= F.date_sub("last", 10)) & (F.date_trunc("week", "day") < F.date_trunc("week", "last"))
    return rows.crossJoin(F.broadcast(last)).where(kept).select("event_id")


@query("""WITH n AS (SELECT DISTINCT event_type FROM events), c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM n) SELECT user_id, array_to_string(list(DISTINCT code ORDER BY code), ',') AS codes FROM events JOIN c USING (event_type) GROUP BY user_id""")
def index_encoded(spark: SparkSession, d: str) -> DataFrame:
    """Names as places in the sorted list of all names; the dictionary is the small side."""
    names = aggregates.dictionary(table(spark, d, "events"), "event_type")
    code = [c for c in names.columns if c != "event_type"][0]
    rows = table(spark, d, "events").select("user_id", "event_type").distinct().join(names, "event_type")
    return rows.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(code)), ",").alias("codes"))
