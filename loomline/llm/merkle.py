"""Fixity audit of replicas by Merkle trees over ordered offset ranges (operator 2).

Each record has a digest of its length and bytes. The records of an archive whose offsets fall into one range of SPAN
bytes make a leaf; FANOUT neighbouring ranges make the range above, up to one root. A node's digest covers its
children's numbers and digests in order. Ranges are of offsets, not counts, so a lost record changes the nodes above
it only. Replicas are compared from the roots; a level is looked at only below nodes that differ.

Payloads are hashed where they are read; only manifests (no payloads) are shuffled. Manifests and the levels of trees
are tables in the shared folder, each level made of the one below; a level's comparison reads just its nodes. Records of
a leaf are hashed in groups by their own digests first, so that any number of them at one offset is no one task's list.

Defined results: a null payload is an empty one; repeated records count once; a record with a null archive, offset or
record_id is compared like any other value; an empty replica lacks everything; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

SPAN, FANOUT = 65_536, 16
KEY = ("archive", "rec_offset", "record_id")


def digest_of(payload: Column) -> Column:
    body = F.coalesce(payload, F.lit(""))
    return F.sha2(F.concat_ws(":", F.octet_length(body).cast("string"), body), 256)


def manifest(records: DataFrame) -> DataFrame:
    """archive, rec_offset, record_id and digest of records (archive, rec_offset, record_id, and payload or its digest)."""
    digest = F.col("digest") if "payload" not in records.columns else digest_of(F.col("payload"))
    return records.select(*KEY, digest.alias("digest")).groupBy(*KEY, "digest").agg(F.count("*").alias("n")).drop("n")


def tree(found: DataFrame, top: int, spark: SparkSession) -> list[DataFrame]:
    """archive, node, digest of each level. A leaf holds the records of SPAN bytes, a node FANOUT nodes."""
    row = F.to_json(F.struct("rec_offset", "record_id", "digest"), {"ignoreNullFields": "false"})  # a null has a place of its own
    digest = lambda c: F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(c))), 256).alias("digest")
    rows = found.select("archive", F.coalesce(F.floor(F.col("rec_offset") / SPAN), F.lit(0)).alias("node"), row.alias("row")).withColumn("part", F.substring(F.md5("row"), 1, 4))
    level, _ = stash(rows.groupBy("archive", "node", "part").agg(digest("row")).groupBy("archive", "node").agg(digest(F.concat_ws(":", "part", "digest"))), spark)
    out = [level]
    for _ in range(top):
        child = F.concat_ws(":", F.lpad(F.col("node").cast("string"), 20, "0"), "digest")
        level, _ = stash(level.groupBy("archive", F.floor(F.col("node") / FANOUT).alias("node")).agg(digest(child)), spark)
        out.append(level)
    return out


def differing(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Key, digest_a and digest_b of rows that are not the same on both sides."""
    left, right = a.select(*key, F.col("digest").alias("digest_a")), b.select(*[F.col(c).alias(f"{c}_b") for c in key], F.col("digest").alias("digest_b"))
    on = [left[c].eqNullSafe(right[f"{c}_b"]) for c in key]
    both = left.join(right, on, "full").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    return both.select(*[F.coalesce(c, f"{c}_b").alias(c) for c in key], "digest_a", "digest_b")


def audit(a: DataFrame, b: DataFrame, spark: SparkSession) -> DataFrame:
    """Records that replicas a and b do not hold alike: archive, rec_offset, record_id, status, digest_a, digest_b."""
    sides = [stash(manifest(r), spark)[0] for r in (a, b)]
    last = max((m.agg(F.max("rec_offset")).first()[0] or 0) for m in sides) // SPAN
    top = 0
    while last:
        last, top = last // FANOUT, top + 1
    trees = [tree(m, top, spark) for m in sides]
    bad = differing(*(t[top] for t in trees), ["archive", "node"]).select("archive", "node")
    for k in range(top - 1, -1, -1):
        above = bad.select(F.col("archive").alias("up"), F.col("node").alias("over"))
        bad, _ = stash(
            differing(*(t[k].join(above, F.col("archive").eqNullSafe(F.col("up")) & (F.floor(F.col("node") / FANOUT) == F.col("over")), "left_semi") for t in trees), ["archive", "node"]).select("archive", "node"),
            spark,
        )
    below = bad.select(F.col("archive").alias("up"), F.col("node").alias("over"))
    rows = (m.join(below, F.col("archive").eqNullSafe(F.col("up")) & (F.coalesce(F.floor(F.col("rec_offset") / SPAN), F.lit(0)) == F.col("over")), "left_semi") for m in sides)
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    return differing(*rows, list(KEY)).select(*KEY, status.alias("status"), "digest_a", "digest_b")


def page_records(pages: DataFrame, spark: SparkSession, per_archive: int = 512) -> DataFrame:
    """Pages as records of archives, hashed: page_id divided by per_archive, offsets by running length in page_id order.

    Pages without an id are dealt out by url. Lengths are added up in ranges of pages first, one task each, then over the
    ranges of an archive; an id on most rows, or equal rows, fill as many ranges as they need. worn: the digest in a
    replica with damage that follows from record ids (a byte turned, an end cut off); lost: a record it lacks.
    """
    archive = F.coalesce(F.floor(F.col("page_id") / per_archive), -1 - F.pmod(F.xxhash64("url"), F.lit(1 << 20)))
    size = F.octet_length(F.coalesce("html", F.lit(""))) + F.octet_length(F.coalesce("url", F.lit(""))) + 200
    i = F.col("page_id")
    damaged = F.when(i % 97 == 13, F.concat(F.lit("#"), F.substring("html", 2, 1 << 30))).when(i % 211 == 5, F.expr("substring(html, 1, length(html) - 10)")).otherwise(F.col("html"))
    rows = pages.select(archive.alias("archive"), "page_id", "url", size.cast("long").alias("size"), digest_of(F.col("html")).alias("digest"), digest_of(damaged).alias("worn"), F.coalesce(i % 193 == 7, F.lit(False)).alias("lost"))
    # The number splits equal rows; a file's rows have the same numbers whenever they are read.
    dealt = rows.withColumn("number", F.monotonically_increasing_id()).repartitionByRange("archive", "page_id", "url", "digest", "number")
    ranged, _ = stash(dealt.withColumn("part", F.spark_partition_id()), spark)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("archive", "part").agg(F.sum("size").alias("held"))
    start = sums.select("archive", "part", F.coalesce(F.sum("held").over(upto(Window.partitionBy("archive").orderBy("part"))), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("size").over(upto(Window.partitionBy("part", "archive").orderBy("page_id", "url", "digest", "number"))), F.lit(0))
    placed = ranged.withColumn("within", within).join(start, ["archive", "part"])
    return placed.select("archive", (F.col("start") + F.col("within")).alias("rec_offset"), F.col("page_id").alias("record_id"), "digest", "worn", "lost")


def audit_pages(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """The audit of pages as records against their damaged replica."""
    records, _ = stash(page_records(pages, spark), spark)
    return audit(records.select(*KEY, "digest"), records.where("NOT lost").select(*KEY, F.col("worn").alias("digest")), spark)


SQL = """
WITH r AS (
  SELECT page_id // 512 AS archive, page_id AS record_id, html AS payload,
    CAST(coalesce(sum(octet_length(encode(coalesce(html, ''))) + octet_length(encode(coalesce(url, ''))) + 200) OVER (PARTITION BY page_id // 512 ORDER BY page_id, url, sha256(octet_length(encode(coalesce(html, ''))) || ':' || coalesce(html, '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rec_offset
  FROM pages),
a AS (SELECT archive, rec_offset, record_id, sha256(octet_length(encode(payload)) || ':' || payload) AS digest_a FROM r),
b AS (SELECT archive, rec_offset, record_id, sha256(octet_length(encode(payload)) || ':' || payload) AS digest_b FROM (
  SELECT archive, rec_offset, record_id, CASE WHEN record_id % 97 = 13 THEN '#' || substr(payload, 2) WHEN record_id % 211 = 5 THEN substr(payload, 1, length(payload) - 10) ELSE payload END AS payload
  FROM r WHERE record_id % 193 <> 7))
SELECT archive, rec_offset, record_id, CASE WHEN digest_b IS NULL THEN 'missing' WHEN digest_a IS NULL THEN 'extra' ELSE 'changed' END AS status, digest_a, digest_b
FROM a FULL JOIN b USING (archive, rec_offset, record_id) WHERE digest_a IS DISTINCT FROM digest_b"""
