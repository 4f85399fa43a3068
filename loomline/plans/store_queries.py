"""Queries on keyed stores: merges, change detection, reconciliation, publishing and watermarks, over halves of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import times
from loomline.operators import joins, stores
from loomline.plans.registry import registry
from loomline.sources import table

QUERIES, SQL, query = registry()


OLD = "old AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 3 <> 0)"
NEW = "new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate + INTERVAL 1 DAY END AS o_orderdate FROM orders WHERE o_orderkey % 2 = 0)"


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A stored table and a batch that overlaps with it, with some changes and missing stamps."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    status = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))
    stamp = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))
    return rows.where("o_orderkey % 3 <> 0"), rows.where("o_orderkey % 2 = 0").withColumns({"o_orderstatus": status, "o_orderdate": stamp})


@query(f"WITH {OLD}, {NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    old, new = halves(spark, d)
    return stores.insert_ignore(old, new, "o_orderkey", [F.col("o_totalprice")])


@query(f"WITH {OLD}, {NEW}, b AS (SELECT *, 0 AS n FROM old UNION ALL SELECT *, 1 FROM new) SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate IS NOT NULL DESC, o_orderdate DESC, n DESC) AS r FROM b) WHERE r = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    old, new = halves(spark, d)
    return stores.upsert(old, new, "o_orderkey", "o_orderdate")


@query(f"WITH {OLD}, {NEW} SELECT coalesce(new.o_orderkey, old.o_orderkey) AS o_orderkey, coalesce(new.o_orderstatus, old.o_orderstatus) AS o_orderstatus, coalesce(new.o_orderdate, old.o_orderdate) AS o_orderdate FROM old FULL JOIN new ON old.o_orderkey = new.o_orderkey")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    """Columns that a batch lacks keep their stored values."""
    old, new = halves(spark, d)
    return stores.patched(old, new, "o_orderkey", ["o_orderstatus", "o_orderdate"])


_HASH = "sha256('=' || o_orderstatus || '|=' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR))"


@query(f"WITH {OLD}, {NEW} SELECT n.o_orderkey, {_HASH.replace('o_', 'n.o_')} AS hash FROM new n LEFT JOIN old o ON n.o_orderkey = o.o_orderkey WHERE {_HASH.replace('o_', 'n.o_')} IS DISTINCT FROM {_HASH.replace('o_', 'o.o_')}")
def change_hash(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a batch whose digest is not the stored one."""
    old, new = (h.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")) for h in halves(spark, d))
    columns = ["o_totalprice", "o_orderstatus"]
    return stores.changed(new, old.select("o_orderkey", stores.change_hash(columns).alias("hash")), "o_orderkey", columns)


@query(f"""WITH {OLD}, {NEW} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS op
FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus <> n.o_orderstatus""")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """What a full sweep finds against the stored rows."""
    old, new = halves(spark, d)
    return joins.reconcile(old, new, "o_orderkey", ["o_orderstatus"])


@query(f"WITH {OLD}, {NEW} SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT * FROM new WHERE NOT (o_orderkey % 4 = 0)")
def patch_overlay(spark: SparkSession, d: str) -> DataFrame:
    old, new = halves(spark, d)
    return joins.overlay(old, new.withColumn("gone", F.col("o_orderkey") % 4 == 0), "o_orderkey", "gone")


@query("""WITH a AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'error'), b AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-20'), f AS (SELECT user_id, min(ts) AS f FROM b GROUP BY 1)
SELECT a.* FROM a LEFT JOIN f USING (user_id) WHERE f IS NULL OR ts < f UNION ALL SELECT * FROM b""")
def window_splice(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each user before those read anew, then these."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    new = rows.where("event_type = 'error' AND ts >= '2024-01-20'").drop("event_type")
    return joins.splice(rows.where("event_type <> 'error'").drop("event_type"), new, "user_id", "ts")


@query("""WITH h AS (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'forced' WHEN s_suppkey % 5 = 0 AND s_suppkey % 2 = 0 THEN 'seed' WHEN s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 THEN 'changed' WHEN s_acctbal >= 5000 THEN 'heartbeat' ELSE 'skip' END AS decision, s_nationkey FROM supplier)
SELECT s_suppkey, decision, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 4 AS sent FROM h WHERE decision <> 'skip'""")
def publish_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Which views are sent, and why; at most four of a group in a run."""
    k = F.col("s_suppkey")
    now = F.lit("h")
    last = F.when(k % 5 == 0, None).when(k % 3 == 0, "old").otherwise("h")
    published = F.when(k % 2 == 0, "h").otherwise("other")
    rows = table(spark, d, "supplier").withColumn("decision", stores.decision(k % 11 == 0, now, last, published, F.col("s_acctbal"), 5000)).where("decision <> 'skip'")
    return stores.capped(rows, "s_nationkey", [k], 4).select("s_suppkey", "decision", "sent")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25 12:00:00' - INTERVAL 30 MINUTE OR ts + INTERVAL 1 DAY >= TIMESTAMP '2024-01-26 06:00:00' - INTERVAL 2 MINUTE")
def dual_watermark(spark: SparkSession, d: str) -> DataFrame:
    """Rows that either of two watermarks lets through, each with its margin."""
    rows = table(spark, d, "events").withColumn("taken", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    mark = lambda s: F.lit(s).cast("timestamp_ntz")
    return stores.due(rows, "ts", "taken", mark("2024-01-25 12:00:00"), mark("2024-01-26 06:00:00")).select("event_id")


@query("SELECT least(max(ts), TIMESTAMP '2024-01-28') AS watermark FROM events")
def capped_watermark(spark: SparkSession, d: str) -> DataFrame:
    return stores.advanced(table(spark, d, "events"), "ts", F.lit("2024-01-28 00:00:00").cast("timestamp_ntz"))


@query("""WITH a AS (SELECT strftime(ts, '%G-w%V') AS bucket, count(*) AS s, count(*) FILTER (event_id % 997 <> 0) AS v FROM events GROUP BY 1) SELECT bucket, s AS source_rows, v AS view_rows FROM a WHERE s <> v""")
def weekly_audit(spark: SparkSession, d: str) -> DataFrame:
    """Weeks whose published rows are not as many as the source's."""
    rows = table(spark, d, "events")
    return stores.audit_counts(rows, rows.where("event_id % 997 <> 0"), times.iso_week(F.col("ts")))


@query("""SELECT event_id, CASE WHEN p > f + INTERVAL 1 HOUR OR p < f - INTERVAL 8 DAY THEN f ELSE coalesce(p, f) END AS effective FROM (SELECT event_id, ts AS f, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + (event_id % 300 - 280) * INTERVAL 1 HOUR END AS p FROM events)""")
def effective_dates(spark: SparkSession, d: str) -> DataFrame:
    """Published stamps, or the time found where these are missing or odd."""
    published = F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 300 - 280).cast("int")))
    return table(spark, d, "events").select("event_id", times.effective(published, F.col("ts")).alias("effective"))
