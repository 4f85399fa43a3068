"""Queries of sector and market views: dense blocks, groups, orders, ladders of dates, and columns of other shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import contacts
from loomline.operators import ranks
from loomline.plans.registry import registry
from loomline.sources import table

QUERIES, SQL, query = registry()
# Fixed values of the queries: flags shown, metrics, and the months of a block.
FLAGS, METRICS = ["A", "R"], ["qty", "value"]


@query("""WITH m AS (SELECT l_returnflag AS flag, l_linestatus AS status, datediff('month', DATE '1970-01-01', l_shipdate::DATE) AS m, sum(l_quantity) AS qty, sum(l_extendedprice) AS value FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
b AS (SELECT min(m) AS a, max(m) AS b FROM m), g AS (SELECT flag, status, unnest(range(a, b + 1)) AS m FROM (SELECT DISTINCT flag, status FROM m), b),
d AS (SELECT g.flag, g.status, g.m, qty, value FROM g LEFT JOIN m USING (flag, status, m))
SELECT flag, status, metric, array_to_string(list(coalesce(round(v, 2)::DECIMAL(20, 2)::VARCHAR, '-') ORDER BY m), ',') AS series FROM (SELECT flag, status, m, 'qty' AS metric, qty AS v FROM d UNION ALL SELECT flag, status, m, 'value', value FROM d) GROUP BY ALL""")
def trade_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Per flag, status and metric a dense array over all months of the table; months without rows hold a dash."""
    ship = F.col("l_shipdate").cast("date")
    rows = table(spark, d, "lineitem").where(F.col("l_returnflag").isin(FLAGS)).groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.year(ship) * 12 + F.month(ship)).alias("m")).agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("value"))
    span = rows.agg(F.min("m").alias("a"), F.max("m").alias("b"))  # one row
    long = rows.unpivot(["flag", "status", "m"], METRICS, "metric", "v")
    found = long.groupBy("flag", "status", "metric").agg(F.map_from_entries(F.collect_list(F.struct("m", F.round("v", 2).cast("decimal(20,2)").cast("string").alias("v")))).alias("of"))
    dense = F.transform(F.sequence("a", "b"), lambda m: F.coalesce(F.try_element_at("of", m), F.lit("-")))
    return found.crossJoin(F.broadcast(span)).select("flag", "status", "metric", F.array_join(dense, ",").alias("series"))


@query("""WITH r AS (SELECT p_brand AS brand, date_trunc('month', l_shipdate) AS m, sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END) AS volume, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
c AS (SELECT min(m) AS first FROM r WHERE volume > 60) SELECT brand, m::DATE AS month, volume, qty FROM r, c WHERE m >= first""")
def leading_cut(spark: SparkSession, d: str) -> DataFrame:
    """Months before the first with enough volume anywhere are cut, for every brand alike."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("brand"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"))
    rows = rows.agg(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).otherwise(0.0)).alias("volume"), F.sum("l_quantity").alias("qty"))
    first = rows.where("volume > 60").agg(F.min("month").alias("first"))  # one row
    return rows.crossJoin(F.broadcast(first)).where("month >= first").drop("first")


@query("""SELECT coalesce(n_name, '-') AS port, coalesce(r_name, '-') AS destination, count(*) AS n, round(sum(o_totalprice), 2) AS total, list_sort(list(DISTINCT month(o_orderdate)))[1] AS first_month FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 7 <> 0 LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def port_destination(spark: SparkSession, d: str) -> DataFrame:
    """Sums per port and destination; what is not known of them is a dash."""
    known = table(spark, d, "customer").where("c_custkey % 7 <> 0")
    rows = table(spark, d, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    keys = [F.coalesce("n_name", F.lit("-")).alias("port"), F.coalesce("r_name", F.lit("-")).alias("destination")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min(F.month("o_orderdate")).alias("first_month"))


@query("""SELECT 'orders' AS name, max(o_orderdate) FILTER (o_orderstatus = 'F') AS last, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', max(l_shipdate) FILTER (l_linestatus = 'F'), count(*) FROM lineitem UNION ALL SELECT 'events', max(ts) FILTER (event_type <> 'error'), count(*) FROM events""")
def sector_index(spark: SparkSession, d: str) -> DataFrame:
    """Of each table its newest period, of the rows that count for it, and how many rows it has."""
    parts = [("orders", "o_orderdate", "o_orderstatus = 'F'"), ("lineitem", "l_shipdate", "l_linestatus = 'F'"), ("events", "ts", "event_type <> 'error'")]
    rows = [table(spark, d, n).agg(F.max(F.when(F.expr(c), F.col(ts))).cast("timestamp").alias("last"), F.count("*").alias("n")).select(F.lit(n).alias("name"), "last", "n") for n, ts, c in parts]
    return rows[0].union(rows[1]).union(rows[2])


@query("""SELECT c_nationkey AS nation, c_mktsegment AS segment, array_to_string(list(c_custkey || ':' || floor(c_acctbal + 0.5)::BIGINT ORDER BY c_custkey), ',') AS series FROM customer GROUP BY ALL""")
def grouped_series(spark: SparkSession, d: str) -> DataFrame:
    """Of each nation and segment its rows in order, as one series."""
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    point = F.struct("c_custkey", F.concat_ws(":", "c_custkey", F.floor(F.col("c_acctbal") + 0.5)).alias("p"))
    return rows.agg(F.array_sort(F.collect_list(point)).alias("all")).select("nation", "segment", F.array_join(F.transform("all", lambda x: x.p), ",").alias("series"))


@query("""WITH e AS (SELECT o_custkey AS code, o_orderdate AS ts_, o_orderkey AS id, o_orderstatus AS rating, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS name FROM orders WHERE o_orderstatus <> 'O')
SELECT code, arg_min(name, (ts_, id)) FILTER (name IS NOT NULL) AS name, count(*) AS n, array_to_string(list(rating ORDER BY ts_, id), '>') AS path, max(ts_)::DATE AS last FROM e GROUP BY code""")
def rating_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of each code in order of date, with its first name that is known; codes without events are left out."""
    rows = table(spark, d, "orders").where("o_orderstatus <> 'O'").withColumn("name", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    when = F.struct("o_orderdate", "o_orderkey")
    out = rows.groupBy(F.col("o_custkey").alias("code")).agg(F.min_by("name", F.when(F.col("name").isNotNull(), when)).alias("name"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))).alias("all"), F.max("o_orderdate").cast("date").alias("last"))
    return out.select("code", "name", "n", F.array_join(F.transform("all", lambda x: x.o_orderstatus), ">").alias("path"), "last")


@query("""SELECT o_custkey AS company, bool_or(o_orderstatus = 'O' AND o_totalprice > 200000) AS any_active, count(*) AS programs FROM orders GROUP BY o_custkey""")
def any_active(spark: SparkSession, d: str) -> DataFrame:
    """Whether a company has any active program; unknown counts as not."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("company")).agg(F.bool_or(F.coalesce((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 200000), F.lit(False))).alias("any_active"), F.count("*").alias("programs"))


@query("""WITH v AS (SELECT p_type AS v, count(*) AS n FROM part GROUP BY 1), x AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM v) SELECT p_partkey, p_type AS decoded, code FROM part JOIN x ON p_type = v""")
def decoded_column(spark: SparkSession, d: str) -> DataFrame:
    """A column stored as a dictionary and codes, decoded again by place; nothing but codes is shuffled."""
    rows = table(spark, d, "part").select("p_partkey", "p_type")
    words = rows.agg(F.array_sort(F.collect_set("p_type")).alias("words"))  # kinds of parts, a bounded list
    coded = rows.crossJoin(F.broadcast(words)).select("p_partkey", "words", (F.array_position("words", F.col("p_type")) - 1).alias("code"))
    return coded.select("p_partkey", F.element_at("words", (F.col("code") + 1).cast("int")).alias("decoded"), "code")


@query("""SELECT s_nationkey AS nation, '["key","name","balance"]' AS columns, '[' || string_agg('[' || s_suppkey || ',"' || s_name || '",' || round(s_acctbal)::BIGINT || ']', ',' ORDER BY s_suppkey) || ']' AS rows FROM supplier GROUP BY 1""")
def row_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Names of columns once, then rows as arrays."""
    row = F.concat(F.lit("["), F.col("s_suppkey").cast("string"), F.lit(',"'), F.col("s_name"), F.lit('",'), F.round("s_acctbal").cast("long").cast("string"), F.lit("]"))
    got = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))).alias("all"))
    return got.select("nation", F.lit('["key","name","balance"]').alias("columns"), F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x.r), ","), F.lit("]")).alias("rows"))


@query("""SELECT * FROM (SELECT 'documents' AS kind, doc_id AS id, substr(text, 1, 40) AS head, source FROM documents UNION ALL SELECT 'benchmark', item_id, substr(text, 1, 40), NULL FROM benchmark UNION ALL SELECT 'conversations', conv_id * 1000 + turn, substr(text, 1, 40), role FROM conversations)""")
def union_scan(spark: SparkSession, d: str) -> DataFrame:
    """Sources of different columns as one; what one lacks is null."""
    head = F.substring("text", 1, 40).alias("head")
    docs = table(spark, d, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), head, "source")
    items = table(spark, d, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), head)
    talk = table(spark, d, "conversations").select(F.lit("conversations").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), head, F.col("role").alias("source"))
    return docs.unionByName(items, allowMissingColumns=True).unionByName(talk)


@query("""WITH u AS (SELECT user_id, 1 AS p, event_id FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, 2, event_id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, 3, event_id FROM events),
f AS (SELECT user_id, p, event_id, row_number() OVER (PARTITION BY user_id ORDER BY p, event_id) AS r FROM u) SELECT user_id, p AS priority, event_id FROM f WHERE r = 1""")
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """Three queues in order of priority; each key is taken from the first that has it."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    kinds = [("event_type = 'purchase'", 1), ("event_type = 'click'", 2), ("true", 3)]
    rows = [e.where(c).select("user_id", F.struct(F.lit(p).alias("priority"), "event_id").alias("k")) for c, p in kinds]
    return rows[0].union(rows[1]).union(rows[2]).groupBy("user_id").agg(F.min("k").alias("k")).select("user_id", "k.*")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders QUALIFY place <= 600""")
def latest_filings(spark: SparkSession, d: str) -> DataFrame:
    """The 600 newest, later keys first among equals: a top-k report."""
    top = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(600).select("o_orderkey", "o_orderdate")
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("place"))  # 600 rows


@query("""SELECT user_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY last DESC, user_id) AS latest, row_number() OVER (PARTITION BY user_id % 5 ORDER BY day DESC, user_id) AS week FROM (SELECT user_id, max(ts) AS last, max(ts)::DATE AS day FROM events GROUP BY 1)""")
def latest_and_week_order(spark: SparkSession, d: str) -> DataFrame:
    """Places of users in the order of their last event, and in the order of its day with ids between equals."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last")).select("user_id", "last", (F.col("user_id") % 5).alias("part"))
    latest = ranks.numbered(rows, ["part"], [F.desc("last"), F.col("user_id")], "latest")
    return ranks.numbered(latest, ["part"], [F.desc(F.to_date("last")), F.col("user_id")], "week").select("user_id", "latest", "week")


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, 0), p_name, p_partkey) AS place FROM part""")
def category_order(spark: SparkSession, d: str) -> DataFrame:
    """Order given (0 if not), then name, then id."""
    given = F.coalesce(F.when(F.col("p_size") % 2 == 0, F.col("p_size")), F.lit(0))
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", given.alias("given"))
    return ranks.numbered(rows, ["p_brand"], [F.col("given"), F.col("p_name"), F.col("p_partkey")]).select("p_partkey", "place")


@query("""WITH k AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') AS key FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS r FROM k) SELECT doc_id, substr(sha1(CASE WHEN r = 1 THEN key ELSE key || '#' || r END), 1, 12) AS id FROM n""")
def collision_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids from a key that repeats: the first is the key's, later ones carry their number. Counted in blocks of ids."""
    rows = table(spark, d, "documents").select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("key")).withColumn("block", F.floor(F.col("doc_id") / 4096))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("key", "block").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("key", "block", "base")
    r = F.row_number().over(Window.partitionBy("key", "block").orderBy("doc_id")) + F.col("base")
    named = rows.join(base, ["key", "block"]).withColumn("r", r)
    return named.select("doc_id", F.substring(F.sha1(F.when(F.col("r") == 1, F.col("key")).otherwise(F.concat_ws("#", "key", "r"))), 1, 12).alias("id"))


@query("""SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'wire' WHEN lang = 'de' THEN 'europe' WHEN lang = 'es' THEN 'latam' ELSE 'none' END AS desk, coalesce(source IN ('src3', 'src5'), false) AS is_primary FROM documents""")
def desk_and_primary(spark: SparkSession, d: str) -> DataFrame:
    """The desk of a row: its source's if that has one, else by sector, else none; and whether its source is primary."""
    desk = F.when(F.col("source").isin("src1", "src2"), "wire").when(F.col("lang") == "de", "europe").when(F.col("lang") == "es", "latam").otherwise("none")
    return table(spark, d, "documents").select("doc_id", desk.alias("desk"), F.coalesce(F.col("source").isin("src3", "src5"), F.lit(False)).alias("is_primary"))


@query(r"""WITH c AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN '' WHEN 2 THEN '  ' || n_chars || '  ' WHEN 3 THEN n_chars || '.5e1' WHEN 4 THEN n_chars || 'px' ELSE NULL END AS v FROM documents)
SELECT doc_id, CASE WHEN v IS NULL THEN 0.0 WHEN trim(v) = 'true' THEN 1.0 WHEN trim(v) = 'false' OR trim(v) = '' THEN 0.0 WHEN regexp_full_match(trim(v), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN trim(v)::DOUBLE END AS number FROM c""")
def js_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as a script reads them: true is 1, false, blank and null are 0, other text is none."""
    n = F.col("n_chars").cast("string")
    kind = F.col("doc_id") % 6
    v = F.when(kind == 0, "true").when(kind == 1, "").when(kind == 2, F.concat(F.lit("  "), n, F.lit("  "))).when(kind == 3, F.concat(n, F.lit(".5e1"))).when(kind == 4, F.concat(n, F.lit("px")))
    t = F.trim("v")
    number = F.when(F.col("v").isNull(), 0.0).when(t == "true", 1.0).when(t.isin("false", ""), 0.0).when(t.rlike(r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"), F.expr("try_cast(trim(v) AS double)"))
    return table(spark, d, "documents").select("doc_id", v.alias("v")).select("doc_id", number.alias("number"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE NULL END AS v FROM orders) SELECT o_orderkey, try_cast(substr(v, 1, 10) AS DATE) AS day FROM t""")
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    """The date at the start of a stamp; what is no date is null."""
    k, at = F.col("o_orderkey") % 4, F.col("o_orderdate")
    v = F.when(k == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(at, "yyyy-MM-dd")).when(k == 2, F.date_format(at, "dd/MM/yyyy"))
    return table(spark, d, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", F.expr("try_cast(substr(v, 1, 10) AS date)").alias("day"))


@query("""SELECT user_id, array_to_string(list((event_id || ':' || round(value, 2)::DECIMAL(18, 2)) ORDER BY event_id) FILTER (value IS NOT NULL AND event_type <> 'error' AND isfinite(value)), ',') AS points FROM events GROUP BY user_id""")
def clean_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of a series that are two finite numbers; others (here those of errors) go."""
    v = F.when(F.col("event_type") != "error", F.col("value"))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", v.alias("v")))).alias("all"))
    good = F.filter("all", lambda p: p.v.isNotNull() & ~F.isnan(p.v) & (F.abs(p.v) < float("inf")))
    return rows.select("user_id", F.when(F.size(good) > 0, F.array_join(F.transform(good, lambda p: F.concat_ws(":", p.event_id, F.round(p.v, 2).cast("decimal(18,2)"))), ",")).alias("points"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events, m WHERE date_trunc('hour', ts) >= now - INTERVAL 12 HOUR OR (event_type = 'purchase' AND ts >= now - INTERVAL 48 HOUR)""")
def lag_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose bucket lies in the window, or that were found within 48 hours of now (the newest stamp)."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    inside = F.date_trunc("hour", "ts") >= F.col("now") - F.expr("INTERVAL 12 HOURS")
    return e.crossJoin(now).where(inside | ((F.col("event_type") == "purchase") & (F.col("ts") >= F.col("now") - F.expr("INTERVAL 48 HOURS")))).select("event_id")


@query("""WITH a AS (SELECT user_id, max(ts) AS last, max(value) AS best FROM events WHERE event_type = 'click' GROUP BY 1), m AS (SELECT max(ts) AS now FROM events) SELECT DISTINCT e.user_id FROM events e LEFT JOIN a USING (user_id), m WHERE NOT coalesce(best > 95 OR last > now - INTERVAL 4 HOUR, false)""")
def cooldown_skip(spark: SparkSession, d: str) -> DataFrame:
    """Users to try: not those with a good result already, nor those tried in the last four hours."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    tried = e.where("event_type = 'click'").groupBy("user_id").agg(F.max("ts").alias("last"), F.max("value").alias("best")).crossJoin(now)
    skip = tried.where((F.col("best") > 95) | (F.col("last") > F.col("now") - F.expr("INTERVAL 4 HOURS"))).select("user_id")
    return e.select("user_id").distinct().join(skip, "user_id", "left_anti")


@query("""WITH m AS (SELECT max(o_orderdate) AS now FROM orders) SELECT o_orderkey FROM orders, m WHERE CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END >= now - INTERVAL 450 DAY OR o_orderkey % 11 = 0""")
def retention_prune(spark: SparkSession, d: str) -> DataFrame:
    """What stays after a prune: rows of the last days, and those whose stamp cannot be read."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("at")).alias("stamp"), "at")
    now = F.broadcast(rows.agg(F.max("at").alias("now")))
    return rows.crossJoin(now).where((F.col("stamp") >= F.col("now") - F.expr("INTERVAL 450 DAYS")) | F.col("stamp").isNull()).select("o_orderkey")


@query("""SELECT coalesce(source, '-') AS file, sum(octet_length(encode(text)))::BIGINT AS bytes, greatest(2048, count(*) * 7 + 800) AS estimate, coalesce(sum(octet_length(encode(text))) > 150000, false) AS over FROM documents GROUP BY 1""")
def size_budget(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of each file against its budget (a warning only), and the estimate by points."""
    total = F.sum(F.octet_length("text"))
    return table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("-")).alias("file")).agg(total.alias("bytes"), F.greatest(F.lit(2048), F.count("*") * 7 + 800).alias("estimate"), F.coalesce(total > 150000, F.lit(False)).alias("over"))


@query("""SELECT c_custkey, '{"balance":' || round(c_acctbal)::BIGINT || ',"key":' || c_custkey || ',"name":"' || c_name || '"' || CASE WHEN c_nationkey % 2 = 0 THEN ',"nation":' || c_nationkey ELSE '' END || '}' AS doc FROM customer""")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    """One line of JSON with sorted keys and without nulls, the same bytes for the same row."""
    nation = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey"))
    doc = F.to_json(F.struct(F.round("c_acctbal").cast("long").alias("balance"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), nation.alias("nation")))
    return table(spark, d, "customer").select("c_custkey", doc.alias("doc"))


@query("""WITH w AS (SELECT user_id, date_trunc('hour', ts) AS h, max(ts) AS last FROM events GROUP BY ALL), m AS (SELECT max(ts) AS now FROM events)
SELECT user_id, count(*) FILTER (now >= h + INTERVAL 3 HOUR) AS settled, count(*) FILTER (date_diff('second', last, now) >= 3600 - 60) AS due, count(*) FILTER (hour(h) IN (8, 12, 18) AND minute(last) BETWEEN 5 AND 40) AS open FROM w, m GROUP BY user_id""")
def clock_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Of each user's hours: settled (two hours past their end), due (an hour old, a minute's slack), and in the digest window."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    rows = e.groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.max("ts").alias("last")).crossJoin(now)
    count = lambda c: F.count(F.when(c, 1))
    age = F.unix_timestamp("now") - F.unix_timestamp("last")
    return rows.groupBy("user_id").agg(count(F.col("now") >= F.col("h") + F.expr("INTERVAL 3 HOURS")).alias("settled"), count(age >= 3540).alias("due"), count(F.hour("h").isin(8, 12, 18) & F.minute("last").between(5, 40)).alias("open"))


@query(r"""WITH t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS ws FROM documents)),
n(w, ticker) AS (VALUES ('The', 'THE3'), ('Der', 'DER4'), ('Les', 'LES3'), ('Que', 'QUE3'), ('En', 'ENDE'), ('De', 'ENDE')), f AS (SELECT doc_id, ticker, min(i) AS i FROM t JOIN n USING (w) GROUP BY ALL)
SELECT doc_id, coalesce(string_agg(ticker, ',' ORDER BY i), '') AS tickers FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id""")
def ticker_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Names in their own case mapped to tickers, each once, in order of first mention."""
    names = F.create_map(*map(F.lit, ["The", "THE3", "Der", "DER4", "Les", "LES3", "Que", "QUE3", "En", "ENDE", "De", "ENDE"]))
    words = F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.isin("The", "Der", "Les", "Que", "En", "De"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.transform(words, lambda w: F.try_element_at(names, w))), ",").alias("tickers"))


@query(r"""WITH p AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x FROM documents), c AS (SELECT x FROM p WHERE x <> '' GROUP BY x HAVING count(DISTINCT doc_id) >= 8)
SELECT doc_id, count(*) FILTER (c.x IS NULL) AS kept FROM p LEFT JOIN c USING (x) GROUP BY doc_id""")
def boilerplate_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """How many paragraphs of a text stay when those that eight documents or more have, word for word, are dropped."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x")).select("doc_id", F.trim("x").alias("x"))
    counted = rows.groupBy("doc_id", "x").agg(F.count("*").alias("n"))
    common = counted.where("x <> ''").groupBy("x").agg(F.count("*").alias("docs")).where("docs >= 8").select("x", F.lit(True).alias("common"))
    kept = counted.join(common, "x", "left").groupBy("doc_id").agg(F.sum(F.when(F.col("common").isNull(), F.col("n")).otherwise(0)).alias("kept"))
    return kept


@query("""WITH f AS (SELECT event_type, max(value) > 99.5 AS shown, bool_and(value >= 0) AS sane FROM events GROUP BY 1) SELECT event_id FROM events JOIN f USING (event_type) WHERE shown IS TRUE AND event_type <> 'error'""")
def flag_gate(spark: SparkSession, d: str) -> DataFrame:
    """Rows of kinds whose flag is exactly true; a missing or unknown flag shuts them out."""
    e = table(spark, d, "events")
    flags = e.groupBy("event_type").agg((F.max("value") > 99.5).alias("shown")).where("shown <=> true AND event_type <> 'error'")
    return e.join(F.broadcast(flags), "event_type", "left_semi").select("event_id")


@query(r"""SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN regexp_matches(lower(text), '\b(the|und|eau)\b') ELSE regexp_matches(lower(text), '\b(the|und)\b') END AS kept FROM documents""".replace("\\b(", "(^|[^\\pL\\pN_])(").replace(")\\b", ")([^\\pL\\pN_]|$)"))
def source_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of all sources, and of some sources one more."""
    word = lambda ws: F.lower("text").rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(ws)})(?![\p{{L}}\p{{N}}_])")
    return table(spark, d, "documents").select("doc_id", F.when(F.col("source").isin("src1", "src2"), word(["the", "und", "eau"])).otherwise(word(["the", "und"])).alias("kept"))


@query(r"""WITH u AS (SELECT page_id, regexp_extract(lower(url), '^https?://([^/:?#]*)', 1) AS h FROM pages) SELECT page_id, len(list_filter(['example.org', 'ththth.example.net'], lambda b: h = b OR ends_with(h, '.' || b))) > 0 AS blocked FROM u""")
def blocked_domains(spark: SparkSession, d: str) -> DataFrame:
    """A domain is blocked with all its sub-domains, and no other that ends like it."""
    host = F.regexp_extract(F.lower("url"), r"^https?://([^/:?#]*)", 1)
    bad = F.lit(False)
    for b in ("example.org", "ththth.example.net"):
        bad = bad | (host == b) | host.endswith("." + b)
    return table(spark, d, "pages").select("page_id", bad.alias("blocked"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'), '^ | $', '', 'g') AS folded FROM documents""")
def folded_text(spark: SparkSession, d: str) -> DataFrame:
    """Lower case without accents: letters are taken apart from their marks, whatever the letter, and the marks go."""
    from loomline.functions.text import unmarked

    c = F.regexp_replace(F.regexp_replace(unmarked(F.col("text")), "[^a-z0-9]+", " "), "^ | $", "")
    return table(spark, d, "documents").select("doc_id", c.alias("folded"))


@query()
def contacts_masked(spark: SparkSession, d: str) -> DataFrame:
    """Texts without contacts, each run of figures judged by itself; SQL has no such patterns, so it is tested on cases."""
    text = contacts.masked(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.alias("masked"), (text != F.col("text")).alias("changed"))
