"""Queries on views and their refresh, guards of updates, precedence, and further projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import text
from loomline.operators import aggregates, series, views
from loomline.plans.registry import registry
from loomline.sources import table

QUERIES, SQL, query = registry()


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS top FROM events WHERE ts < TIMESTAMP '2024-01-29' GROUP BY ALL), p AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS top FROM events GROUP BY ALL)
SELECT p.user_id, p.event_type, p.n, p.top, CASE WHEN s.n IS NULL THEN 'new' WHEN s.n = p.n AND s.top = p.top THEN 'keep' ELSE 'reread' END AS decision FROM p LEFT JOIN s ON p.user_id = s.user_id AND p.event_type = s.event_type""")
def probe_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Views whose probe of rows and greatest id has moved since it was stored are read again."""
    rows, keys = table(spark, d, "events"), ["user_id", "event_type"]
    stored = views.probe(rows.where("ts < '2024-01-29'"), keys, "event_id")
    return views.refreshed(stored, views.probe(rows, keys, "event_id"), keys)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS bucket FROM orders), l AS (SELECT *, coalesce(max(bucket) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > bucket, false) AS late FROM r)
SELECT bucket, count(*) FILTER (NOT late) AS appended, count(*) FILTER (late) AS patched FROM l GROUP BY 1""")
def late_routing(spark: SparkSession, d: str) -> DataFrame:
    """Orders as they arrive: a late one patches the week that it belongs to."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    found = views.routed(rows, "o_custkey", "o_orderkey", F.to_date(F.date_trunc("week", "o_orderdate")))
    return found.groupBy("bucket").agg(F.count_if(~F.col("late")).alias("appended"), F.count_if("late").alias("patched"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type <> 'error') AS before FROM events WHERE ts IS NOT NULL GROUP BY 1), m AS (SELECT max(day) AS last FROM d)
SELECT day, CASE WHEN day > last - 5 THEN n ELSE before END AS n, day > last - 5 AS recomputed FROM d, m""")
def converging_days(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts of which the last five days are computed anew, so that what is classified late still counts."""
    days = table(spark, d, "events").where("ts IS NOT NULL").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("all_"), F.count_if(F.col("event_type") != "error").alias("before"))
    last = days.agg(F.max("day").alias("last"))
    fresh = F.col("day") > F.date_sub("last", 5)
    return days.join(F.broadcast(last)).select("day", F.when(fresh, F.col("all_")).otherwise(F.col("before")).alias("n"), fresh.alias("recomputed"))


@query("""WITH s AS (SELECT user_id, max(ts) FILTER (event_type = 'error') AS new, max(ts) FILTER (event_type = 'error' AND ts < TIMESTAMP '2024-01-28') AS stored FROM events GROUP BY 1), q AS (SELECT user_id FROM s WHERE new > stored OR (new IS NOT NULL AND stored IS NULL) ORDER BY new DESC, user_id LIMIT 5)
SELECT s.user_id, CASE WHEN q.user_id IS NOT NULL THEN 'replace' WHEN new > stored OR (new IS NOT NULL AND stored IS NULL) THEN 'queued' ELSE 'append' END AS action FROM s LEFT JOIN q ON s.user_id = q.user_id""")
def split_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Series with a newer split stamp than the stored one are replaced, five in a run; the others wait or are appended to."""
    split = F.when(F.col("event_type") == "error", F.col("ts"))
    s = table(spark, d, "events").groupBy("user_id").agg(F.max(split).alias("new"), F.max(F.when(F.col("ts") < "2024-01-28", split)).alias("stored"))
    s = s.withColumn("moved", F.coalesce(F.col("new") > F.col("stored"), F.col("new").isNotNull()))
    picked = s.where("moved").orderBy(F.desc("new"), "user_id").limit(5).select("user_id", F.lit(True).alias("picked"))
    return s.join(picked, "user_id", "left").select("user_id", F.when(F.col("picked"), "replace").when(F.col("moved"), "queued").otherwise("append").alias("action"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS r FROM events), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM d WHERE r = 1)
SELECT user_id, day, value FROM t WHERE k <= 10""")
def accrual_append(spark: SparkSession, d: str) -> DataFrame:
    """A series takes one value a day, the newest, and keeps its last ten days."""
    rows = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return series.keep_last(series.newest(rows, ["user_id", "day"], [F.desc("ts"), F.desc("event_id")]), "user_id", "day", 10).select("user_id", "day", "value")


@query("""WITH o AS (SELECT user_id, event_type AS op, json_extract_string(props, '$.k') AS item, event_id FROM events), l AS (SELECT user_id, item, arg_max(op, event_id) AS op, max(event_id) AS seen FROM o GROUP BY ALL), w AS (SELECT user_id, max(event_id) FILTER (op = 'signup') AS mark FROM o GROUP BY 1)
SELECT l.user_id, count(*) FILTER (op <> 'error') AS kept, count(*) FILTER (op = 'error') AS removed, count(*) FILTER (mark IS NULL OR seen > mark) AS pending FROM l LEFT JOIN w ON l.user_id = w.user_id GROUP BY l.user_id""")
def op_log_state(spark: SparkSession, d: str) -> DataFrame:
    """Items upserted and removed (by errors): how many a user holds, and how many changed since the last publication."""
    ops = table(spark, d, "events").select("user_id", F.col("event_type").alias("op"), F.get_json_object("props", "$.k").alias("item"), "event_id")
    last = ops.groupBy("user_id", "item").agg(F.max_by("op", "event_id").alias("op"), F.max("event_id").alias("at"), F.max(F.when(F.col("op") == "signup", F.col("event_id"))).alias("sent"))
    mark = F.max("sent").over(Window.partitionBy("user_id"))
    held = last.withColumn("mark", mark).withColumn("gone", F.col("op") == "error")
    pending = F.coalesce(F.col("at") > F.col("mark"), F.lit(True))
    return held.groupBy("user_id").agg(F.count_if(~F.col("gone")).alias("kept"), F.count_if("gone").alias("removed"), F.count_if(pending).alias("pending"))


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","place":{"c_nationkey":' || c_nationkey || '}}') AS digest FROM customer""")
def content_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of records that do not depend on the order of keys nor on stamps, at any level."""
    rows = table(spark, d, "customer").select(F.struct(F.current_timestamp().alias("updated_at"), "c_nationkey").alias("place"), "c_name", F.lit("x").alias("generated_at"), "c_mktsegment", "c_custkey")
    return rows.select("c_custkey", views.content_hash(rows, {"updated_at", "generated_at"}).alias("digest"))


@query("""WITH t AS (SELECT event_id, CAST(hour(ts) + 4 AS VARCHAR) || ':' || CAST(minute(ts) AS VARCHAR) AS x FROM events)
SELECT event_id, CASE WHEN CAST(split_part(x, ':', 1) AS INTEGER) < 24 THEN lpad(split_part(x, ':', 1), 2, '0') || ':' || lpad(split_part(x, ':', 2), 2, '0') END AS clock FROM t""")
def clock_text(spark: SparkSession, d: str) -> DataFrame:
    """Times of day in text, checked and padded."""
    rows = table(spark, d, "events").select("event_id", F.concat_ws(":", (F.hour("ts") + 4).cast("string"), F.minute("ts").cast("string")).alias("x"))
    part = lambda i: F.regexp_extract("x", r"^\s*(\d{1,2}):(\d{1,2})", i)
    good = F.col("x").rlike(r"^\s*([01]?\d|2[0-3]):[0-5]?\d")
    return rows.select("event_id", F.when(good, F.concat(F.lpad(part(1), 2, "0"), F.lit(":"), F.lpad(part(2), 2, "0"))).alias("clock"))


@query("SELECT c_custkey, c_name, c_acctbal >= 0 AS visible, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, c_nationkey FROM customer")
def restricted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers that are not visible keep four fields only."""
    seen = F.col("c_acctbal") >= 0
    return table(spark, d, "customer").select("c_custkey", "c_name", seen.alias("visible"), *[F.when(seen, F.col(c)).alias(c) for c in ("c_mktsegment", "c_acctbal")], "c_nationkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN round((l_extendedprice / 1.13 - 150) / l_tax, 4) END AS price FROM lineitem")
def converted_prices(spark: SparkSession, d: str) -> DataFrame:
    """Prices net of tax and freight in another currency; no rate, no price."""
    price = F.when(F.col("l_tax") > 0, F.round((F.col("l_extendedprice") / F.lit(1.13) - 150) / F.col("l_tax"), 4))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", price.alias("price"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus <> 'P') AS taken, count(*) FILTER (o_orderstatus = 'P') AS rejected, max(CAST(o_orderdate AS DATE)) FILTER (o_orderstatus <> 'P') AS last FROM orders GROUP BY 1""")
def grid_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a grid of raw cells; a price without a readable date in its row is rejected."""
    day = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    cells = table(spark, d, "orders").select(F.array("o_orderpriority", F.col("o_totalprice").cast("string"), day).alias("cells"))
    read = cells.select(F.col("cells")[0].alias("o_orderpriority"), F.expr("try_cast(cells[1] AS double)").alias("price"), F.to_date(F.try_to_timestamp(F.col("cells")[2], F.lit("dd/MM/yyyy"))).alias("day"))
    good = F.col("day").isNotNull() & F.col("price").isNotNull()
    return read.groupBy("o_orderpriority").agg(F.count_if(good).alias("taken"), F.count_if(~good).alias("rejected"), F.max(F.when(good, F.col("day"))).alias("last"))


@query("SELECT p_partkey, replace(lower(p_name), ' ', '-') AS file_id, regexp_full_match(replace(lower(p_name), ' ', '-'), '[a-z0-9][a-z0-9_-]*') AS valid, lower(p_name) AS name FROM part")
def id_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Names as file ids and back."""
    rows = table(spark, d, "part").select("p_partkey", F.translate(F.lower("p_name"), " ", "-").alias("file_id"))
    return rows.select("p_partkey", "file_id", F.col("file_id").rlike("^[a-z0-9][a-z0-9_-]*$").alias("valid"), F.translate("file_id", "-", " ").alias("name"))


_SPACED = "'  ' || regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', '  ', 'g') || '  '"


@query(f"""WITH t AS (SELECT doc_id, {_SPACED} AS s FROM documents)
SELECT doc_id, len(regexp_extract_all(s, ' the ')) - len(regexp_extract_all(s, ' the  (?:and|of) ')) AS counted, len(regexp_extract_all(s, ' The ')) - len(regexp_extract_all(s, ' (?:la|un)  The ')) AS names FROM t""")
def idiom_veto(spark: SparkSession, d: str) -> DataFrame:
    """A word counts unless an idiom follows; a capitalised form counts unless an article stands before it."""
    s = F.concat(F.lit("  "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r]+", "  "), F.lit("  "))
    count = lambda pattern: F.regexp_count(s, F.lit(pattern)).cast("long")
    return table(spark, d, "documents").select("doc_id", count(" the (?! (?:and|of) )").alias("counted"), count("(?<! la )(?<! un ) The ").alias("names"))


@query("""WITH t AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS m, dayofweek(ts) AS w FROM events), c AS (SELECT *, CASE WHEN m < 720 THEN 540 ELSE 1020 END AS target FROM t)
SELECT event_id, CASE WHEN w IN (0, 6) THEN 'weekend' WHEN m < target - 60 THEN 'too early' WHEN target = 540 AND m >= 600 THEN 'market open' ELSE 'ok' END AS verdict FROM c""")
def capture_window(spark: SparkSession, d: str) -> DataFrame:
    """Whether a capture falls into the window of its cut: from an hour before, to the opening or the end of the day."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    target = F.when(minute < 720, 540).otherwise(1020)
    verdict = F.when(F.dayofweek("ts").isin(1, 7), "weekend").when(minute < target - 60, "too early").when((target == 540) & (minute >= 600), "market open").otherwise("ok")
    return table(spark, d, "events").select("event_id", verdict.alias("verdict"))


@query("""WITH c AS (SELECT o_custkey, max(o_orderdate) FILTER (o_orderstatus = 'F') AS stored, max(o_orderdate) FILTER (o_orderstatus = 'O') AS given FROM orders GROUP BY 1)
SELECT o_custkey, CAST(CASE WHEN given >= coalesce(stored, given) THEN given ELSE stored END AS DATE) AS day, CASE WHEN given IS NULL THEN 'undated' WHEN given < stored THEN 'older' ELSE 'taken' END AS verdict FROM c""")
def monotone_dates(spark: SparkSession, d: str) -> DataFrame:
    """Updates without a date, or with one before the stored date, are refused."""
    at = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderdate")))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(at("F").alias("stored"), at("O").alias("given"))
    verdict = F.when(F.col("given").isNull(), "undated").when(F.col("given") < F.col("stored"), "older").otherwise("taken")
    return rows.select("o_custkey", F.to_date(F.when(verdict == "taken", F.col("given")).otherwise(F.col("stored"))).alias("day"), verdict.alias("verdict"))


@query("""WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_min(value, event_id) AS o, arg_max(value, event_id) AS c FROM events GROUP BY ALL), l AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY day) AS p FROM b)
SELECT user_id, day, abs(o / p - 1) < 1e-9 AS untraded FROM l WHERE p > 0""")
def no_auction(spark: SparkSession, d: str) -> DataFrame:
    """Days that open at the close before: no auction took place."""
    bars = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by("value", "event_id").alias("o"), F.max_by("value", "event_id").alias("c"))
    before = F.lag("c").over(Window.partitionBy("user_id").orderBy("day"))
    return bars.withColumn("p", before).where("p > 0").select("user_id", "day", (F.abs(F.col("o") / F.col("p") - 1) < 1e-9).alias("untraded"))


@query("""WITH e AS (SELECT l_orderkey, max(l_shipdate) AS ends FROM lineitem GROUP BY 1) SELECT o_orderkey, o_orderpriority FROM orders LEFT JOIN e ON l_orderkey = o_orderkey
WHERE o_orderpriority = '1-URGENT' OR (o_orderdate <= TIMESTAMP '1996-03-31' AND coalesce(ends, o_orderdate) >= TIMESTAMP '1996-01-01')""")
def range_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Orders that run within a quarter; urgent ones recur and are always in."""
    ends = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ends"))
    rows = table(spark, d, "orders").join(ends, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return rows.where(views.overlapping(F.col("o_orderdate"), F.col("ends"), F.col("o_orderpriority") == "1-URGENT", at("1996-01-01"), at("1996-03-31"))).select("o_orderkey", "o_orderpriority")


@query("""WITH a AS (SELECT user_id, max(CAST(ts AS DATE)) FILTER (ts < TIMESTAMP '2024-01-30' AND event_type = 'purchase') AS anchor FROM events GROUP BY 1)
SELECT user_id, anchor, coalesce(date_diff('day', anchor, DATE '2024-01-30') <= 5, false) AS usable FROM a""")
def anchor_max_age(spark: SparkSession, d: str) -> DataFrame:
    """The latest anchor before a day, usable for five days."""
    anchor = F.max(F.when((F.col("ts") < "2024-01-30") & (F.col("event_type") == "purchase"), F.to_date("ts")))
    rows = table(spark, d, "events").groupBy("user_id").agg(anchor.alias("anchor"))
    return rows.withColumn("usable", F.coalesce(F.datediff(F.lit("2024-01-30").cast("date"), "anchor") <= 5, F.lit(False)))


@query("""SELECT DISTINCT user_id, CAST(ts + INTERVAL 3 HOUR AS DATE) AS session FROM events e WHERE event_type = 'error' AND EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND CAST(p.ts + INTERVAL 3 HOUR AS DATE) = CAST(e.ts + INTERVAL 3 HOUR AS DATE))""")
def traded_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with an error that some purchase confirms; a session begins at 21:00."""
    rows = table(spark, d, "events").select("user_id", F.to_date(F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias("session"), "event_type")
    return rows.where("event_type = 'error'").select("user_id", "session").distinct().join(rows.where("event_type = 'purchase'"), ["user_id", "session"], "left_semi")


@query("""SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS v FROM events e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'view' AND s.user_id = e.user_id AND CAST(s.ts AS DATE) = CAST(e.ts AS DATE)) GROUP BY ALL""")
def missing_days(spark: SparkSession, d: str) -> DataFrame:
    """Rebuilt points of days that the stored series lacks."""
    rows = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "value", "event_type")
    built = rows.where("event_type = 'purchase'").groupBy("user_id", "day").agg(F.max("value").alias("v"))
    return built.join(rows.where("event_type = 'view'"), ["user_id", "day"], "left_anti")


@query("""SELECT doc_id, CASE WHEN b.text IS NOT NULL THEN 'pasted' WHEN p.html IS NOT NULL THEN 'cached' ELSE 'live' END AS origin, length(coalesce(b.text, p.html, d.text)) AS n FROM documents d LEFT JOIN benchmark b ON b.item_id = doc_id LEFT JOIN pages p ON p.page_id = doc_id""")
def body_precedence(spark: SparkSession, d: str) -> DataFrame:
    """The body of each document: a pasted one, else the cached one, else its own."""
    size = lambda name, key, text: table(spark, d, name).select(F.col(key).alias("doc_id"), F.length(text).cast("long").alias(name))
    rows = size("documents", "doc_id", "text")  # lengths are taken before the joins, so that no text is shuffled
    for name, key, text in (("benchmark", "item_id", "text"), ("pages", "page_id", "html")):
        rows = rows.join(size(name, key, text), "doc_id", "left")
    origin = F.when(F.col("benchmark").isNotNull(), "pasted").when(F.col("pages").isNotNull(), "cached").otherwise("live")
    return rows.select("doc_id", origin.alias("origin"), F.coalesce("benchmark", "pages", "documents").alias("n"))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN s_acctbal / 1000 WHEN s_nationkey < 10 THEN s_acctbal / 500 WHEN s_nationkey < 15 THEN s_acctbal / nullif(round((s_nationkey + s_suppkey) / 5.0), 0) END AS ratio FROM supplier""")
def class_float(spark: SparkSession, d: str) -> DataFrame:
    """A ratio whose denominator depends on the class; no class, no ratio."""
    n, bal = F.col("s_nationkey"), F.col("s_acctbal")
    unit = F.round((n + F.col("s_suppkey")) / F.lit(5.0))
    base = F.when(n < 5, F.lit(1000.0)).when(n < 10, F.lit(500.0)).when((n < 15) & (unit != 0), unit)
    return table(spark, d, "supplier").select("s_suppkey", (bal / base).alias("ratio"))


@query("SELECT event_id, round(1 / (1 + exp(-greatest(-30, least(30, -2 + 0.04 * value)))), 6) AS confidence FROM events")
def logistic_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence by a logistic of fitted weights, clamped."""
    z = F.lit(-2.0) + F.lit(0.04) * F.col("value")
    return table(spark, d, "events").select("event_id", F.round(1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))), 6).alias("confidence"))


@query("SELECT source, lang, count(*) AS items, sum(strlen(text)) AS bytes FROM documents GROUP BY ROLLUP (source, lang)")
def item_counts(spark: SparkSession, d: str) -> DataFrame:
    """Items and bytes per source and language, per source and over all."""
    return table(spark, d, "documents").rollup("source", "lang").agg(F.count("*").alias("items"), F.sum(F.octet_length("text")).alias("bytes"))


@query("""WITH u AS (SELECT o_custkey, o_orderdate AS stamp, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS src FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY stamp DESC NULLS LAST, src DESC, o_orderkey DESC) AS k FROM u)
SELECT o_custkey, CAST(stamp AS DATE) AS day, o_orderkey, src FROM r WHERE k = 1""")
def newest_stamp_merge(spark: SparkSession, d: str) -> DataFrame:
    """Stored and incoming rows of a key: the later stamp wins, of equals the incoming one, and none loses."""
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("stamp"), "o_orderkey", "o_orderstatus")
    part = lambda test: rows.where(test).drop("o_orderstatus")
    best = views.newest_stamp(part("o_orderstatus = 'F'"), part("o_orderstatus <> 'F' OR o_orderstatus IS NULL"), ["o_custkey"], "stamp")
    return best.select("o_custkey", F.to_date("stamp").alias("day"), "o_orderkey", "src")


@query("""SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal > 2000 AND row_number() OVER (PARTITION BY s_nationkey, s_acctbal > 2000 ORDER BY s_acctbal DESC, s_suppkey) <= 3 THEN row_number() OVER (PARTITION BY s_nationkey, s_acctbal > 2000 ORDER BY s_acctbal DESC, s_suppkey) END AS pin FROM supplier""")
def pins_renumbered(spark: SparkSession, d: str) -> DataFrame:
    """Pinned rows of each nation renumbered from one to three; the excess is not pinned."""
    found = views.renumbered(table(spark, d, "supplier"), "s_nationkey", F.col("s_acctbal") > 2000, [F.desc("s_acctbal"), F.col("s_suppkey")], 3)
    return found.select("s_suppkey", "s_nationkey", F.col("pin").cast("long").alias("pin"))


@query("""WITH m AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'PULP']) AS c_mktsegment), c AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), k AS (SELECT c_mktsegment FROM m UNION SELECT c_mktsegment FROM c)
SELECT k.c_mktsegment, coalesce(n, 0) AS n FROM k LEFT JOIN c ON k.c_mktsegment = c.c_mktsegment""")
def fixed_members(spark: SparkSession, d: str) -> DataFrame:
    """Customers per segment; segments of a fixed list are there without any."""
    counts = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    members = spark.sql("SELECT * FROM VALUES ('AUTOMOBILE'), ('BUILDING'), ('PULP') AS m(c_mktsegment)")
    return views.with_fixed(counts, "c_mktsegment", members).fillna(0, ["n"])


@query("""WITH u AS (SELECT count(DISTINCT user_id) AS all_ FROM events) SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS captured, count(DISTINCT user_id) >= 0.75 * any_value(all_) AS enough FROM events, u GROUP BY 1""")
def capture_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether a day has captured three quarters of all users."""
    pairs = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.lit(1).alias("one"))
    total = table(spark, d, "events").agg(F.count_distinct("user_id").alias("all_"))
    days = pairs.groupBy("day").agg(F.count("user_id").alias("captured"))
    return days.join(F.broadcast(total)).select("day", "captured", (F.col("captured") >= 0.75 * F.col("all_")).alias("enough"))


@query("""SELECT doc_id, CASE WHEN source = 'web' AND lang = 'de' THEN NULL WHEN source = 'web' THEN 'news' WHEN source = 'books' THEN 'library' END AS section, source IS NULL OR source NOT IN ('web', 'books') AS unknown FROM documents""")
def glossary_routing(spark: SparkSession, d: str) -> DataFrame:
    """Documents by place to sections; unknown places are noted, and an exception may take a document out."""
    sections = F.create_map(*[F.lit(x) for x in ("web", "news", "books", "library")])
    section = sections[F.col("source")]
    exempt = (F.col("source") == "web") & (F.col("lang") == "de")
    return table(spark, d, "documents").select("doc_id", F.when(~F.coalesce(exempt, F.lit(False)), section).alias("section"), section.isNull().alias("unknown"))


@query("""WITH p AS (SELECT doc_id, string_split(text, CASE WHEN contains(text, chr(10) || chr(10)) THEN chr(10) || chr(10) ELSE chr(10) END) AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS t FROM p)
SELECT doc_id, count(*) AS paragraphs, sum(length(trim(t))) AS chars FROM u WHERE length(trim(t)) > 5 GROUP BY 1""")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of texts, by empty lines if a text has any and else by lines, of more than five characters."""
    by = F.when(F.contains("text", F.lit("\n\n")), F.split("text", "\n\n")).otherwise(F.split("text", "\n"))
    rows = table(spark, d, "documents").select("doc_id", F.explode(by).alias("t")).select("doc_id", F.length(F.trim("t")).alias("n")).where("n > 5")
    return rows.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum("n").alias("chars"))


@query("""WITH e AS (SELECT conv_id, turn, role, replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;') AS t FROM conversations)
SELECT conv_id, turn, CASE role WHEN 'user' THEN '<p>' || t || '</p>' WHEN 'assistant' THEN '<blockquote>' || t || '</blockquote>' ELSE '' END || '<img src="https://example.com/' || conv_id || '.png">' AS html FROM e""")
def items_html(spark: SparkSession, d: str) -> DataFrame:
    """Typed items in JSON to HTML: unknown types go, and so do images that are not by https."""
    kind = F.when(F.col("role") == "user", "p").when(F.col("role") == "assistant", "quote").otherwise("other")
    item = lambda t, x: F.struct(t.alias("type"), x.alias("text"))
    image = lambda scheme: item(F.lit("img"), F.concat(F.lit(f"{scheme}://example.com/"), F.col("conv_id").cast("string"), F.lit(".png")))
    packed = F.to_json(F.array(item(kind, F.coalesce("text", F.lit(""))), image("http"), image("https")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", packed.alias("items"))
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), safe(x.text), F.lit(f"</{name}>"))
    picture = lambda x: F.concat(F.lit('<img src="'), safe(x.text), F.lit('">'))
    html = lambda x: F.when(x.type == "p", tag("p", x)).when(x.type == "quote", tag("blockquote", x)).when((x.type == "img") & x.text.startswith("https://"), picture(x)).otherwise("")
    return rows.select("conv_id", "turn", F.array_join(F.transform(F.from_json("items", "array<struct<type: string, text: string>>"), html), "").alias("html"))


@query("""SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN '{"k":"' || json_extract_string(props, '$.k') || '"}' ELSE '{}' END AS kept FROM events""")
def known_keys(spark: SparkSession, d: str) -> DataFrame:
    """Maps reduced to the keys of a list."""
    given = F.map_concat(F.from_json(F.coalesce("props", F.lit("{}")), "map<string, string>"), F.create_map(F.lit("other"), F.col("event_type")))
    return table(spark, d, "events").select("event_id", F.to_json(F.map_filter(given, lambda k, v: k.isin("k", "until", "count"))).alias("kept"))


@query("""WITH t AS (SELECT o_orderkey, o_orderdate + INTERVAL 15 HOUR AS ts FROM orders), l AS (SELECT *, date_trunc('day', ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AT TIME ZONE 'America/New_York' AS start FROM t)
SELECT o_orderkey, CAST((epoch(start) - epoch(date_trunc('day', ts))) / 60 AS BIGINT) AS minutes FROM l""")
def local_midnight(spark: SparkSession, d: str) -> DataFrame:
    """Where a local day begins, in minutes of the UTC day; the zone has summer time."""
    zone = "America/New_York"
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 15 HOURS")).cast("timestamp").alias("ts"))
    start = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp("ts", zone)), zone)
    return rows.select("o_orderkey", ((F.unix_timestamp(start) - F.unix_timestamp(F.date_trunc("day", "ts"))) / 60).cast("long").alias("minutes"))


@query("""SELECT page_id, 'Write to [email] or [phone], see ' || CASE WHEN regexp_matches(url, '(?i)[?&](token|sig|signature|key|apikey|password|secret)=') THEN '[link]' ELSE url END || ' and [link]' AS cleaned FROM pages""")
def free_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts with contacts masked and links checked."""
    rows = table(spark, d, "pages")
    given = F.concat(F.lit("Write to ed"), F.col("page_id").cast("string"), F.lit("@mail.example.com or +1 555 1234 5678, see "), F.col("url"), F.lit(" and http://localhost/"), F.col("page_id").cast("string"))
    return rows.select("page_id", text.free_text(given, []).alias("cleaned"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def charset_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Texts as bytes of either charset, read back: German ones are sent as Latin-1 where it has all their letters."""
    single = (F.col("lang") == "de") & F.col("text").rlike(r"^[\x00-\xFF]*$")
    raw = F.when(single, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return table(spark, d, "documents").select("doc_id", F.sha2(text.resolved(raw, F.lit(None).cast("string")), 256).alias("digest"))


@query("""WITH w AS (SELECT doc_id, list_distinct(string_split_regex(lower(coalesce(text, '')), '[^a-z]+')) AS l, lower(coalesce(text, '')) AS t FROM documents), s AS (SELECT doc_id, len(list_intersect(l, ['the', 'of', 'and'])) + CAST(contains(t, 'tion') AS INTEGER) AS a, len(list_intersect(l, ['der', 'das', 'von'])) + CAST(contains(t, 'lich') AS INTEGER) AS b, len(list_intersect(l, ['la', 'el', 'de'])) + CAST(contains(t, 'ado') AS INTEGER) AS c FROM w)
SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a >= b AND a >= c THEN 'english' WHEN b >= c THEN 'german' ELSE 'spanish' END AS sector FROM s""")
def keyword_sectors(spark: SparkSession, d: str) -> DataFrame:
    """The sector with most hits of its words and parts of words; the first of equals."""
    t = F.lower(F.coalesce("text", F.lit("")))
    rows = table(spark, d, "documents").select("doc_id", F.split(t, "[^a-z]+").alias("l"), t.alias("t"))
    hits = lambda words, part: F.size(F.array_intersect("l", F.array(*[F.lit(w) for w in words]))) + F.contains("t", F.lit(part)).cast("int")
    rows = rows.select("doc_id", hits(["the", "of", "and"], "tion").alias("a"), hits(["der", "das", "von"], "lich").alias("b"), hits(["la", "el", "de"], "ado").alias("c"))
    return rows.select("doc_id", aggregates.first_of_greatest([("english", F.col("a")), ("german", F.col("b")), ("spanish", F.col("c"))]).alias("sector"))


@query("""WITH s AS (SELECT l_orderkey, year(l_shipdate) AS y, l_quantity FROM lineitem WHERE l_returnflag <> 'A'), m AS (SELECT *, bool_or(y = 1996) OVER (PARTITION BY l_orderkey) AS any_ FROM s)
SELECT l_orderkey, count(*) AS sheets, sum(l_quantity) AS quantity FROM m WHERE y = 1996 OR NOT any_ GROUP BY 1""")
def sheet_selection(spark: SparkSession, d: str) -> DataFrame:
    """Sheets that are drawn, cut to a year only where any of them has it."""
    drawn = table(spark, d, "lineitem").where("l_returnflag <> 'A'").groupBy("l_orderkey", (F.year("l_shipdate") == 1996).alias("cut")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    value = lambda c: F.coalesce(F.max(F.when(F.col("cut"), F.col(c))), F.sum(c))  # noqa: E731 - one row of the year, if any
    return drawn.groupBy("l_orderkey").agg(value("n").alias("sheets"), value("q").alias("quantity"))


@query("""WITH r AS (SELECT p_brand, p_type, p_partkey, sum(p_retailprice) OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey ROWS UNBOUNDED PRECEDING) AS spent FROM part) SELECT p_partkey, spent <= 3000 AS runs FROM r""")
def work_queue(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by cadence and place, run until the deadline of their queue."""
    spent = F.sum("p_retailprice").over(Window.partitionBy("p_brand", "p_type").orderBy("p_size", "p_partkey").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "part").select("p_partkey", (spent <= 3000).alias("runs"))


@query("""WITH r AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), q AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity >= 49) SELECT p_partkey, r.k IS NOT NULL AS returned, q.k IS NOT NULL AS bulk FROM part LEFT JOIN r ON p_partkey = r.k LEFT JOIN q ON p_partkey = q.k WHERE r.k IS NULL OR q.k IS NULL""")
def symmetric_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the registry that one side or both lack, from one pass over the items."""
    flags = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.bool_or(F.col("l_quantity") >= 49).alias("bulk"))
    rows = table(spark, d, "part").select("p_partkey").join(flags, "p_partkey", "left").fillna(False, ["returned", "bulk"])
    return rows.where("NOT (returned AND bulk)")
