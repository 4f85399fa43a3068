"""Queries on copies kept true to their source, documents in files, nested answers, rich text, articles and names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import folds, unicode
from loomline.operators import aggregates, aliases, articles, sync
from loomline.plans.registry import registry
from loomline.plans.text_queries import TOPICS, _TAGS
from loomline.sources import copies, feeds, table
from loomline.streaming import folder

QUERIES, SQL, query = registry()

# A text with braces, quotation marks and a backslash, as answers of models have them.
_NOTE = """text || ' {"}" \\ ]'"""


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN {_NOTE} END AS note, CASE WHEN turn % 4 <> 3 THEN role END AS name, CASE WHEN turn % 4 <> 3 THEN turn::BIGINT END AS n FROM conversations WHERE text IS NOT NULL""")
def nested_answers(spark: SparkSession, d: str) -> DataFrame:
    """Nested objects out of answers with drafts, thoughts, fences and braces in texts; every fourth has none with the key."""
    rows = table(spark, d, "conversations").where("text IS NOT NULL")
    part = F.struct(F.col("role").alias("name"), F.struct(F.col("turn").alias("n")).alias("w"))
    body = F.to_json(F.struct(F.concat("text", F.lit(' {"}" \\ ]')).alias("note"), F.array(part).alias("parts")))
    k = F.col("turn") % 4
    answer = F.when(k == 0, body).when(k == 1, F.concat(F.lit('<think>{"parts": [{"name": "draft"}]}</think> So: '), body, F.lit(' and {"more": {}}')))
    answer = answer.when(k == 2, F.concat(F.lit('First {"parts": []}\n```json\n'), body, F.lit("\n```\nDone {"))).otherwise(F.concat(F.lit('{"note": '), F.to_json(F.struct(part.alias("inner"))), F.lit("}")))
    got = rows.select("conv_id", "turn", folds.answer(answer, "note STRING, parts ARRAY<STRUCT<name: STRING, w: STRUCT<n: BIGINT>>>", "parts").alias("a"))
    first = F.get("a.parts", F.lit(0))
    return got.select("conv_id", "turn", F.col("a.note").alias("note"), first["name"].alias("name"), first["w"]["n"].alias("n"))


_LINE = "regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')"


@query(f"""WITH t AS (SELECT doc_id, lang, source, {_LINE} AS title FROM documents)
SELECT doc_id, 0 AS line, title AS text, 'b' AS marks, NULL AS color, NULL AS url FROM t WHERE trim(title, ' ') <> ''
UNION ALL SELECT doc_id, CASE WHEN trim(title, ' ') <> '' THEN 1 ELSE 0 END, lang, 'i', '#aa00cc', NULL FROM t
UNION ALL SELECT doc_id, CASE WHEN trim(title, ' ') <> '' THEN 1 ELSE 0 END, ' & ', 'iu', '#aa00cc', NULL FROM t
UNION ALL SELECT doc_id, CASE WHEN trim(title, ' ') <> '' THEN 1 ELSE 0 END, source, 'u', NULL, 'https://x.org/?d=' || doc_id || '&s=1' FROM t""")
def rich_segments(spark: SparkSession, d: str) -> DataFrame:
    """Titles with crossed marks, colours and links as segments."""
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    title = F.coalesce(F.substring_index("text", "\n", 1), F.lit(""))
    link = F.concat(F.lit('</i><a href="https://x.org/?d='), F.col("doc_id").cast("string"), F.lit('&amp;s=1">'))
    html = F.concat(F.lit("<p><b>"), safe(title), F.lit('</b></p><div><i style="color: #A0C; top: 0">'), safe(F.col("lang")), F.lit("<u> &amp; "), link, safe(F.col("source")), F.lit("</u></a></div>"))
    s = table(spark, d, "documents").select("doc_id", F.explode(folds.segments(html)).alias("s"))
    marks = F.concat(*[F.when(F.col(f"s.{n}"), n[0]).otherwise("") for n in ("bold", "italic", "underline")])
    return s.select("doc_id", "s.line", "s.text", marks.alias("marks"), "s.color", "s.url")


_APART = [(chr(i), d) for i in range(0xA0, 0x180) if (d := unicodedata.normalize("NFKD", chr(i))) != chr(i)]


def _replaced(c: str) -> str:
    for a, b in _APART:
        c = f"replace({c}, '{a}', '{b}')"
    return c


@query(f"SELECT doc_id, lower({_replaced('text')}) AS plain FROM documents")
def compatible_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts with some letters in full width, in compatibility decomposition and small letters."""
    letters = "kqxyzKQXYZ0123456789"
    wide = F.translate("text", letters, "".join(chr(ord(x) + 0xFEE0) for x in letters))
    return table(spark, d, "documents").select("doc_id", unicode.nfkd_lower(wide).alias("plain"))


@query("SELECT doc_id, text FROM documents")
def references_read(spark: SparkSession, d: str) -> DataFrame:
    """Texts written with named, decimal and hexadecimal references, read back."""
    c = F.col("text")
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt"), ("é", "&eacute;"), ("ñ", "&#241;"), ("ü", "&#xFC;"), ("ß", "&szlig;"), (" the ", "&#32;the&#x20;")):
        c = F.replace(c, F.lit(char), F.lit(ref))
    return table(spark, d, "documents").select("doc_id", unicode.read_references(c).alias("text"))


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    month = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("price"), month.alias("month"))


@query("SELECT o_orderkey, o_custkey, o_totalprice::DOUBLE AS price, (year(o_orderdate) * 100 + month(o_orderdate))::INT AS month FROM orders WHERE o_orderdate IS NOT NULL")
def swept_copy(spark: SparkSession, d: str) -> DataFrame:
    """A damaged copy of orders by month after sweeps, thirty months a run, until all have been looked at."""
    at = folder(spark)
    _monthly(spark, d).where("month IS NOT NULL").write.partitionBy("month").parquet(f"{at}/source")
    source = spark.read.parquet(f"{at}/source").select("o_orderkey", "o_custkey", "price", "month")
    worn = source.where("o_orderkey % 97 <> 5 AND month % 100 <> 7").withColumn("price", F.when(F.col("o_orderkey") % 89 == 3, F.col("price") + 1).otherwise(F.col("price")))
    worn.unionByName(source.where("o_orderkey % 101 = 1")).write.partitionBy("month").parquet(f"{at}/copy")
    months = source.select("month").distinct().count()
    for _ in range(-(-months // 30)):
        sync.sweep(spark, source, f"{at}/copy", "month", 30, f"{at}/cursor")
    return sync.read(spark, f"{at}/copy", source.schema)


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice::DOUBLE AS price, (year(o_orderdate) * 100 + month(o_orderdate))::INT AS month FROM orders WHERE o_orderdate IS NOT NULL)
SELECT o_orderkey, o_custkey, CASE WHEN month IN (SELECT DISTINCT month FROM o ORDER BY month DESC LIMIT 3) THEN price ELSE price + 1 END AS price, month FROM o""")
def verified_window(spark: SparkSession, d: str) -> DataFrame:
    """An old copy whose last three months are read again: a short read is refused, a whole one is swapped in."""
    at = folder(spark)
    source = _monthly(spark, d).where("month IS NOT NULL")
    source.withColumn("price", F.col("price") + 1).write.partitionBy("month").parquet(f"{at}/copy")
    last = [r.month for r in source.select("month").distinct().orderBy(F.desc("month")).limit(3).collect()]
    window = source.where(F.col("month").isin(last))
    probe = tuple(window.agg(F.count("*"), F.max("o_orderkey")).first())
    said = [sync.swap_window(spark, rows, f"{at}/copy", "month", last, "o_orderkey", probe) for rows in (window.where("o_orderkey % 7 <> 0"), window)]
    if said != ["short", "swapped"]:
        raise ValueError(f"the window was not verified: {said}")
    return sync.read(spark, f"{at}/copy", source.schema)


@query("""WITH s AS (SELECT c_nationkey AS nation, epoch(o_orderdate::TIMESTAMP)::BIGINT // 86400 AS day FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
top AS (SELECT nation, max(day) AS last FROM s GROUP BY nation)
SELECT nation, min(day) AS first, max(day) AS last, count(*) AS points, CASE WHEN nation % 5 = 2 THEN 2 ELSE 1 END AS run FROM s GROUP BY nation""")
def history_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of daily turnovers by nation after a second run, for which a fifth of the nations had a new day."""
    at = folder(spark)
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    daily = joined.groupBy(F.col("c_nationkey").alias("nation"), day.alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("turnover"))
    daily.write.parquet(f"{at}/daily")
    daily = spark.read.parquet(f"{at}/daily")
    ends = daily.groupBy("nation").agg(F.max("day").alias("end"))
    early = daily.join(ends, "nation").where((F.col("nation") % 5 != 2) | (F.col("day") < F.col("end"))).drop("end")
    sync.publish_family(spark, early, f"{at}/family", "nation", "day", 1)
    return sync.publish_family(spark, daily, f"{at}/family", "nation", "day", 2).select("nation", "first", "last", "points", "run")


@query("""WITH p AS (SELECT page_id, page_id // 7 AS part, page_id // 70 AS whole, url, row_number() OVER (PARTITION BY page_id // 7 ORDER BY page_id) AS n FROM pages WHERE url IS NOT NULL),
s AS (SELECT whole, part, row_number() OVER (PARTITION BY whole ORDER BY part) AS k FROM (SELECT DISTINCT whole, part FROM p))
SELECT 'https://x.org/index-' || whole AS root, 'https://y.org/' || page_id || '/a-long-title-of-page-' || page_id AS url, 'A long title of page ' || page_id AS title
FROM p JOIN s USING (whole, part) WHERE k <= 5 AND page_id % 3 <> 0 AND page_id % 10 <> 9""")
def sitemap_index_scan(spark: SparkSession, d: str) -> DataFrame:
    """Indexes over maps of pages, which lead back to their index: entries of the first maps of each, by predicate."""
    pages = table(spark, d, "pages").where("url IS NOT NULL").select("page_id", F.floor(F.col("page_id") / 7).alias("part"), F.floor(F.col("page_id") / 70).alias("whole"))
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    kind = F.when(F.col("page_id") % 10 == 9, "/photo.JPG").when(F.col("page_id") % 3 == 0, "/video").otherwise("")
    loc = text("https://y.org/", F.col("page_id").cast("string"), kind, "/a-long-title-of-page-", F.col("page_id").cast("string"))
    entry = text("<url><loc>", loc, "</loc><lastmod>2024-01-05</lastmod></url>")
    index = F.concat(F.lit("https://x.org/index-"), F.col("whole").cast("string"))
    # Seven pages make a map and ten maps an index, so no row gathers more.
    maps = pages.groupBy("whole", "part").agg(F.array_join(F.sort_array(F.collect_list(entry)), "").alias("e"))
    maps = maps.select("whole", "part", text("https://x.org/map-", F.col("part").cast("string")).alias("url"), text("<sitemapindex><sitemap><loc>", index, "</loc></sitemap></sitemapindex>", F.col("e")).alias("xml"))
    listed = F.transform(F.sort_array(F.collect_list("part")), lambda p: text("<sitemap>\n<loc>https://x.org/map-", p.cast("string"), "</loc></sitemap>"))
    indexes = maps.groupBy("whole").agg(F.array_join(F.flatten(F.array(listed, F.array(F.lit("<sitemap><loc>https://x.org/gone</loc></sitemap>")))), "").alias("xml"))
    files = maps.select("url", "xml").union(indexes.select(index.alias("url"), "xml"))
    entries = feeds.sitemap_index(files, indexes.select(index.alias("root")), most=5)
    return feeds.news_of(entries, F.col("url").contains("title"), "/video/", F.lit("2024-01-01").cast("timestamp")).select("root", "url", "title")


_DOMAIN = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '')"
RULES = [("example.com", "<article>", "</article>", r"^\P{L}*$", 40, 0.5, False), ("m.example.com", None, None, None, 60, 0.2, False), ("example.org", "<article>", None, None, 20, 1.0, False), ("win.example.com", None, None, None, 25, 0.33, True), ("org", None, None, "zz", 30, 0.3, False)]
_RULES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in RULES)


def _gone(c: str) -> str:
    out = f"regexp_replace({c}, '<!--.*?-->', ' ', 'gs')"
    for tag in articles.GONE:
        out = f"regexp_replace({out}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'gis')"
    return out


def _plain(c: str) -> str:
    """A block's text; the tables have no other references than these."""
    read = f"replace(replace(replace(replace(replace(regexp_replace({c}, '<[^>]*>', '', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&')"
    return f"trim(regexp_replace({read}, '[ \\t\\r\\n\\f\\x0B\\x{{a0}}]+', ' ', 'g'), ' ')"


def _parts(c: str) -> str:
    return f"string_split(regexp_replace(regexp_replace({_gone(c)}, '<({articles.BLOCKS})\\b[^>]*>', chr(1) || '\\1' || chr(2), 'gi'), '</({articles.BLOCKS})\\s*>', chr(1) || chr(2), 'gi'), chr(1))"


_TAG, _RAW = "lower(string_split(x, chr(2))[1])", "CASE WHEN contains(x, chr(2)) THEN substr(x, instr(x, chr(2)) + 1) ELSE x END"


@query(f"""WITH b AS (SELECT page_id, list_transform({_parts("coalesce(html, '')")}, lambda x: {{'kind': CASE WHEN regexp_full_match({_TAG}, 'h[1-6]') THEN 'heading' WHEN {_TAG} = 'li' THEN 'item' WHEN {_TAG} = 'blockquote' THEN 'quote' WHEN {_TAG} IN ('td', 'th') THEN 'cell' ELSE 'text' END, 'raw': {_RAW}}}) AS raws FROM pages),
t AS (SELECT page_id, list_filter(list_transform(raws, lambda x: {{'kind': x.kind, 'text': {_plain('x.raw')}}}), lambda x: x.text <> '') AS l FROM b)
SELECT page_id, (place - 1)::INT AS place, l[place].kind AS kind, l[place].text AS text FROM (SELECT page_id, l, unnest(generate_series(1, len(l))) AS place FROM t)""")
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Typed blocks of each page in order: headings, items, quotes, cells and other text."""
    rows = table(spark, d, "pages").select("page_id", F.posexplode(articles.blocks(F.coalesce("html", F.lit("")))).alias("place", "b"))
    return rows.select("page_id", "place", "b.kind", "b.text")


def _article_sql() -> str:
    return f"""WITH rules(suffix, start, stop, pattern, least, most_links, locked) AS (VALUES {_RULES}),
p AS (SELECT page_id, url, coalesce(html, '') AS html, coalesce({_DOMAIN}, '') AS domain FROM pages),
ranked AS (SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(suffix) DESC NULLS LAST) AS k FROM p LEFT JOIN rules r ON domain = suffix OR ends_with(domain, '.' || suffix)),
r AS (SELECT page_id, url, domain, html, coalesce(suffix, '') AS suffix, start, stop, pattern, coalesce(least, 25) AS least, coalesce(most_links, 0.33) AS most_links, coalesce(locked, false) AS locked FROM ranked WHERE k = 1),
a AS (SELECT *, CASE WHEN start IS NULL OR NOT contains(html, start) THEN html ELSE string_split(html, start)[-1] END AS begun FROM r),
i AS (SELECT *, CASE WHEN stop IS NULL OR NOT contains(begun, stop) THEN begun ELSE string_split(begun, stop)[1] END AS body FROM a),
c AS (SELECT *, {_parts("body")} AS parts FROM i),
b AS (SELECT *, list_transform(parts, lambda x: {{'heading': regexp_full_match(lower(string_split(x, chr(2))[1]), 'h[1-6]'), 'raw': CASE WHEN contains(x, chr(2)) THEN substr(x, instr(x, chr(2)) + 1) ELSE x END}}) AS raws FROM c),
t AS (SELECT *, list_transform(raws, lambda x: {{'heading': x.heading, 'text': {_plain('x.raw')}, 'links': coalesce(list_sum(list_transform(regexp_extract_all(x.raw, '(?is)<a\\b[^>]*>(.*?)</a\\s*>', 1), lambda y: length({_plain('y')}))), 0)}}) AS texts FROM b),
j AS (SELECT page_id, domain, suffix, url, locked, array_to_string(list_transform(list_filter(texts, lambda x: x.text <> '' AND (length(x.text) >= least OR x.heading) AND x.links <= most_links * length(x.text) AND coalesce(NOT regexp_matches(x.text, pattern), true)), lambda x: x.text), chr(10) || chr(10)) AS body FROM t),
v AS (SELECT *, CASE WHEN coalesce(url, '') = '' THEN 'no url' WHEN locked THEN 'locked' WHEN length(body) < 200 THEN 'short' WHEN regexp_matches(body, '(?i)log in to') THEN 'teaser' WHEN regexp_matches(body, '^Es ') THEN 'boilerplate' ELSE 'ok' END AS reason FROM j)
SELECT page_id, domain, suffix, CASE WHEN reason = 'ok' THEN substr(body, 1, 3500) END AS body, reason FROM v"""


@query(_article_sql())
def article_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of pages by their domains' rules, or why there is none."""
    rules = spark.createDataFrame(RULES, articles.RULES)
    return articles.articles(table(spark, d, "pages"), "page_id", "url", "html", rules, teaser="(?i)log in to", boilerplate="^Es ")


_WORDS = "regexp_extract_all(lower({}), '[\\pL\\pM\\pN_]+')"


@query(f"""WITH RECURSIVE names AS (SELECT array_to_string(w, ' ') AS run, len(w)::INT AS size, min(item_id) AS entity FROM (SELECT item_id, {_WORDS.format('text')} AS a, unnest([a[3:5], a[4:5], a[4:4], a[5:8]]) AS w FROM benchmark) WHERE len(w) > 0 GROUP BY 1, 2),
t AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
f AS (SELECT doc_id, pos - 1 AS place, size, run, entity, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, pos) AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS pos FROM t) JOIN (SELECT DISTINCT size AS size FROM names) s ON pos + size - 1 <= len(w) JOIN names USING (size) WHERE names.run = array_to_string(w[pos:pos + size - 1], ' ')),
g AS (SELECT doc_id, 0::BIGINT AS k, []::BIGINT[] AS taken, false AS kept FROM (SELECT DISTINCT doc_id FROM f)
  UNION ALL SELECT doc_id, k, CASE WHEN free THEN list_concat(taken, own) ELSE taken END, free FROM (SELECT f.doc_id, f.k, taken, generate_series(f.place, f.place + f.size - 1) AS own, NOT list_has_any(taken, generate_series(f.place, f.place + f.size - 1)) AS free FROM g JOIN f ON f.doc_id = g.doc_id AND f.k = g.k + 1))
SELECT f.doc_id, f.place::INT AS place, size, run, entity FROM f JOIN g USING (doc_id, k) WHERE kept""")
def alias_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one to four words out of benchmark items, found in documents: the longest first, without overlaps."""
    w = aliases.words(F.col("text"))
    runs = F.array(F.slice(w, 3, 3), F.slice(w, 4, 2), F.slice(w, 4, 1), F.slice(w, 5, 4))
    names = table(spark, d, "benchmark").select("item_id", F.explode(runs).alias("r")).select("item_id", F.array_join("r", " ").alias("alias"))
    return aliases.mentions(table(spark, d, "documents"), "doc_id", "text", names, "alias", "item_id")


@query(f"""WITH e AS (SELECT lang, upper(trim(unnest(string_split(source || ';' || ' ' || array_to_string({_TAGS}, '; ') || ';', ';')))) AS token, CASE doc_id % 4 WHEN 0 THEN 'pos' WHEN 1 THEN 'neg' WHEN 2 THEN 'neu' END AS v FROM documents),
c AS (SELECT lang, token, v, count(*) AS n FROM e WHERE token <> '' GROUP BY ALL),
m AS (SELECT lang, token, '{{"n":' || sum(n) || coalesce(string_agg(',"' || v || '":' || n, '' ORDER BY v) FILTER (v IS NOT NULL), '') || '}}' AS m FROM c GROUP BY ALL)
SELECT lang, '{{' || string_agg('"' || token || '":' || m, ',' ORDER BY token) || '}}' AS counts FROM m GROUP BY lang""")
def nested_counters(spark: SparkSession, d: str) -> DataFrame:
    """Of each language how many documents each source and tag has, and of which take, as a map of maps."""
    from loomline.functions.text import tagged

    rows = table(spark, d, "documents")
    joined = F.concat_ws(";", "source", F.concat(F.lit(" "), F.array_join(tagged(F.col("text"), TOPICS), "; ")), F.lit(""))
    k = F.col("doc_id") % 4
    got = aggregates.nested_counters(rows, ["lang"], F.split(joined, ";"), F.when(k == 0, "pos").when(k == 1, "neg").when(k == 2, "neu"))
    return got.select("lang", F.to_json("counts").alias("counts"))


@query("""SELECT s_suppkey, CASE s_suppkey % 6 WHEN 1 THEN 'unreadable' WHEN 2 THEN 'absent' WHEN 3 THEN 'other version' WHEN 5 THEN 'unreadable' ELSE 'ok' END AS status,
CASE WHEN s_suppkey % 6 IN (0, 4) THEN s_name END AS name, CASE WHEN s_suppkey % 6 = 0 THEN s_acctbal::DOUBLE END AS balance FROM supplier""")
def copy_states(spark: SparkSession, d: str) -> DataFrame:
    """States of suppliers kept as files: plain, packed, cut off, absent, of another version and broken."""
    rows, k = table(spark, d, "supplier"), F.col("s_suppkey") % 6
    body = F.to_json(F.struct(F.when(k == 3, 1).otherwise(2).alias("version"), F.col("s_name").alias("name"), F.when(k == 0, F.col("s_acctbal").cast("double")).alias("balance"))).cast("binary")
    whole = copies.packed(body)
    content = F.when(k.isin(0, 3), body).when(k == 4, whole).when(k == 1, F.substring(whole, F.lit(1), F.length(whole) - 9)).when(k == 5, F.lit("{broken").cast("binary"))
    got = copies.state(rows.select("s_suppkey", content.alias("content")), "content", "name STRING, balance DOUBLE", 2)
    return got.select("s_suppkey", "status", "state.name", "state.balance")
