"""Formats that feeds come in: sitemaps and their indexes, chart payloads and listing pages."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import slug_title, snippet, without_tags

SITEMAP = "loc STRING, title STRING, publication_date STRING, lastmod STRING"
CHART = "timestamp ARRAY<BIGINT>, close ARRAY<DOUBLE>, volume ARRAY<BIGINT>"


def parsed_date(*texts: Column) -> Column:
    """The first text that is a timestamp or date; others give null."""
    return F.coalesce(*[F.coalesce(t.try_cast("timestamp"), F.try_to_timestamp(t, F.lit("d/M/yyyy"))) for t in texts])


def sitemap(df: DataFrame, xml: str) -> DataFrame:
    """url, title and published of <url> elements, one a row; a missing title comes from the url's last part."""
    row = df.select(F.from_xml(F.col(xml), SITEMAP).alias("u"))
    slug = F.initcap(F.regexp_replace(F.regexp_extract("u.loc", r"([^/?#]*)/?(?:[?#].*)?$", 1), r"[-_]+|\.[a-z]+$", " "))
    return row.where("u.loc IS NOT NULL").select(F.col("u.loc").alias("url"), F.coalesce(F.nullif(F.trim("u.title"), F.lit("")), F.trim(slug)).alias("title"), parsed_date(F.col("u.publication_date"), F.col("u.lastmod")).alias("published"))


def sitemap_index(files: DataFrame, roots: DataFrame, most: int = 6, deepest: int = 5) -> DataFrame:
    """root, file and xml of the <url> elements that indexes lead to. files has url and xml; roots has root, the urls of indexes.

    An index leads to its first `most` sitemaps, which may be indexes again, down to `deepest`. One way of a root to a file
    counts, so indexes that lead to one another end the search; a file that is not there is nothing.
    """
    spark = files.sparkSession
    read = lambda tag: F.transform(F.regexp_extract_all("xml", F.lit(rf"(?s)<{tag}\b[^>]*>.*?<loc>\s*(.*?)\s*</loc>.*?</{tag}>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    links = files.select("url", F.explode(F.slice(read("sitemap"), 1, most)).alias("child")).distinct()
    reached = spark.sql(
        """WITH RECURSIVE reached (root, file, depth, way) AS (
          SELECT DISTINCT root, root, 0, array(root) FROM {roots}
          UNION ALL
          SELECT root, child, depth + 1, array_append(way, child) FROM reached JOIN {links} ON file = url WHERE depth < {deepest} AND NOT array_contains(way, child))
        SELECT DISTINCT root, file FROM reached""",
        roots=roots, links=links, deepest=deepest,
    )
    entries = files.select(F.col("url").alias("file"), F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<url\b[^>]*>.*?</url>"), F.lit(0))).alias("xml"))
    return reached.join(entries, "file").select("root", "file", "xml")


def news_of(entries: DataFrame, wanted: Column, unwanted: str, cut: Column, shortest: int = 12) -> DataFrame:
    """root, url, title and published of sitemap entries: pages (no pictures) that the predicate on url takes, outside
    unwanted sections, not older than the cut, with a title from the slug that is long enough. A url counts once a root."""
    row = entries.select("root", F.from_xml(F.col("xml"), SITEMAP).alias("u")).select("root", F.col("u.loc").alias("url"), parsed_date(F.col("u.lastmod")).alias("published"))
    title = slug_title(F.col("url"))
    kept = row.where(F.col("url").isNotNull() & ~F.lower("url").rlike(r"\.(?:jpe?g|png|gif|webp)") & wanted & ~F.col("url").rlike(unwanted) & (F.col("published").isNull() | (F.col("published") >= cut)))
    rows = kept.withColumn("title", title).where(F.length("title") >= shortest)
    return rows.groupBy("root", "url").agg(F.min("title").alias("title"), F.max("published").alias("published"))


def chart(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key, ts, close and volume of chart payloads; points without a close are left out."""
    got = df.select(key, F.from_json(payload, CHART).alias("c"))
    return got.select(key, F.inline(F.arrays_zip("c.timestamp", "c.close", "c.volume"))).where("close IS NOT NULL").select(key, F.col("timestamp").alias("ts"), "close", "volume")


RSS = "title STRING, link STRING, description STRING, pubDate STRING"


def rss(df: DataFrame, source: str, xml: str, cut: Column, most: int = 50) -> DataFrame:
    """source, title, url, snippet and published of <item> elements, one a row. Items published before the cut go, those
    without a date stay; then each source keeps its first `most`, the newest first, undated ones last."""
    got = df.select(source, F.from_xml(F.col(xml), RSS).alias("i")).where("i.link IS NOT NULL")
    published = F.coalesce(F.col("i.pubDate").try_cast("timestamp"), F.try_to_timestamp(F.regexp_replace("i.pubDate", r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")))
    rows = got.select(source, F.trim(without_tags(F.col("i.title"))).alias("title"), F.col("i.link").alias("url"), snippet(F.col("i.description"), 400).alias("snippet"), published.alias("published"))
    w = Window.partitionBy(source).orderBy(F.desc_nulls_last("published"), "url")
    return rows.where(F.col("published").isNull() | (F.col("published") >= cut)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def delimited(df: DataFrame, key: str, line: str, layout: dict[str, int], separator: str = ",", slack: float = 0.02) -> DataFrame:
    """key and the numbers named in layout (name: field, from 0) of delimited lines. With price, low and high among them,
    a price outside the day's range by more than the slack tells of fields that moved: its row goes."""
    fields = F.split(line, re.escape(separator))
    rows = df.select(key, *[F.get(fields, at).try_cast("double").alias(name) for name, at in layout.items()]).where("price IS NOT NULL")
    return rows.where((F.col("price") >= F.col("low") * (1 - slack)) & (F.col("price") <= F.col("high") * (1 + slack)))


def unpacked(c: Column, secret: bytes) -> Column:
    """The text in base64 of a deflated payload whose bytes a repeated secret masks; null if it cannot be read."""

    @F.pandas_udf("string")
    def read(column: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str | None:
            if not data:
                return None
            masked = np.frombuffer(data, np.uint8)
            try:
                return zlib.decompress((masked ^ np.resize(np.frombuffer(secret, np.uint8), len(masked))).tobytes()).decode()
            except (zlib.error, UnicodeDecodeError):
                return None

        return column.map(one)

    return read(F.try_to_binary(c, F.lit("base64")))


def packed(c: Column, secret: bytes) -> Column:
    """What `unpacked` reads. Equal texts give equal payloads."""

    @F.pandas_udf("binary")
    def write(column: pd.Series) -> pd.Series:
        def one(text: str | None) -> bytes | None:
            if text is None:
                return None
            data = np.frombuffer(zlib.compress(text.encode(), 6), np.uint8)
            return (data ^ np.resize(np.frombuffer(secret, np.uint8), len(data))).tobytes()

        return column.map(one)

    return F.base64(write(c))


def listing(df: DataFrame, key: str, html: str, most: int = 150, shortest: int = 3) -> DataFrame:
    """key, place, href and title of links. The first `most` anchors are taken before any is left out; then titles
    shorter than `shortest` go, and of equal addresses the first stays."""
    found = F.slice(F.regexp_extract_all(html, F.lit(r'(?s)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0)), 1, most)
    rows = df.select(key, F.posexplode(found).alias("place", "a"))
    rows = rows.select(key, "place", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_replace("a", r"<[^>]+>", " ")).alias("title"))
    w = Window.partitionBy(key, "href").orderBy("place")
    return rows.where(F.length("title") >= shortest).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
