"""Queries on text repair, rule classification, summaries, model answers and filters given as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import conditions, folds, text
from loomline.operators import classify
from loomline.plans.registry import registry
from loomline.plans.text_queries import BLOCKED, SECTORS, TOPICS, _count, _words, title
from loomline.sources import table

QUERIES, SQL, query = registry()


@query("SELECT doc_id, text AS repaired FROM documents")
def mojibake_repair(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose UTF-8 was read as Latin-1, repaired: the texts as they were."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", text.repaired(broken).alias("repaired"))


@query(r"""WITH c AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), ' (?:not|die|que) |[.;!?]+\s*'), lambda p: trim(regexp_replace(p, '(?s)(^| )(con|for|par)( .*)?$', ''))), lambda p: p <> '') AS k FROM documents)
SELECT doc_id, array_to_string(k, '|') AS clauses, len(k) AS n FROM c""")
def clause_filter(spark: SparkSession, d: str) -> DataFrame:
    """Clauses without what follows a causal word."""
    k = text.kept_clauses(F.col("text"), ["con", "for", "par"], ["not", "die", "que"])
    return table(spark, d, "documents").select("doc_id", F.array_join(k, "|").alias("clauses"), F.size(k).cast("long").alias("n"))


@query(f"""WITH f AS (SELECT doc_id, lower(text) AS low, length(text) < 200 AS short, regexp_matches(text, '{_words(BLOCKED)}') AS abuse, regexp_matches(text, '(?i)licensed') AS licence, regexp_matches(text, '[A-Z]{{6,}}!!') AS shout, regexp_matches(text, '[0-9]{{3}}') AS number, regexp_matches(text, ' \\| ') AS tab,
array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in TOPICS)}], lambda x: x IS NOT NULL), ',') AS topics FROM documents),
s AS (SELECT *, {", ".join(f"{_count(w)} AS {n}" for n, w in SECTORS)} FROM f),
t AS (SELECT doc_id, topics, CASE WHEN short THEN 'short' WHEN abuse THEN 'abuse' END AS reason, tab, CASE WHEN greatest(en, de, es) = 0 THEN NULL WHEN en = greatest(en, de, es) THEN 'en' WHEN de = greatest(en, de, es) THEN 'de' ELSE 'es' END AS sector,
CASE WHEN licence THEN 2 ELSE 0 END - CASE WHEN shout THEN 1 ELSE 0 END - CASE WHEN number THEN 1 ELSE 0 END AS score, concat_ws(',', CASE WHEN licence THEN 'licence' END, CASE WHEN shout THEN 'shout' END, CASE WHEN number THEN 'number' END) AS rules,
round(coalesce((CASE WHEN licence THEN 0.9 ELSE 0 END + CASE WHEN shout THEN 0.6 ELSE 0 END + CASE WHEN number THEN 0.5 ELSE 0 END)::DOUBLE / nullif(licence::INT + shout::INT + number::INT, 0), 0), 4) AS confidence FROM s)
SELECT * EXCLUDE (tab), topics <> '' AND sector IS NOT NULL AS relevant, CASE WHEN reason IS NULL AND topics <> '' AND sector IS NOT NULL THEN CASE WHEN tab THEN '=' WHEN score > 0 THEN '+' WHEN score < 0 THEN '-' ELSE '=' END END AS take FROM t""")
def take_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Exclusion, topics, sector, relevance, scored rules and override in one pass over the texts."""
    t = F.col("text")
    rules = [("licence", 2, 0.9, t.rlike("(?i)licensed")), ("shout", -1, 0.6, t.rlike("[A-Z]{6,}!!")), ("number", -1, 0.5, t.rlike("[0-9]{3}"))]
    excluded = [("short", F.length(t) < 200), ("abuse", t.rlike(text.whole_words(BLOCKED)))]
    out = classify.takes(table(spark, d, "documents"), "text", excluded, TOPICS, SECTORS, rules, t.rlike(r" \| "))
    return out.select("doc_id", "reason", F.array_join("topics", ",").alias("topics"), "sector", "score", "rules", "confidence", "relevant", "take")


_NUMBERS = "regexp_extract_all(regexp_replace({}, '[A-Za-z_]+[0-9]+\\w*|[0-9]+[A-Za-z_]\\w*', ' ', 'g'), '[0-9]+(?:\\.[0-9]+)?')"


@query(f"""WITH m AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN length(text) < 80 THEN 'short' WHEN len(regexp_split_to_array(trim(text), '\\s+')) > 60 THEN 'long'
WHEN len(list_filter(list_transform({_NUMBERS.format('text')}, lambda x: x::DOUBLE), lambda x: NOT list_contains(list_transform({_NUMBERS.format("coalesce(before, '')")}, lambda y: y::DOUBLE), x))) > 0 THEN 'numbers' END AS reason FROM m""")
def summary_check(spark: SparkSession, d: str) -> DataFrame:
    """Each message held against the one before it, as a summary against its source."""
    rows = table(spark, d, "conversations").withColumn("before", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    return rows.select("conv_id", "turn", classify.summary_reject(F.col("text"), F.col("before"), 80, 60).alias("reason"))


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN '+' WHEN 'error' THEN '-' WHEN 'view' THEN '=' END AS take, greatest(0.0, least(1.0, value / 100)) AS confidence FROM events WHERE event_id % 4 <> 3
UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 4 = 3""")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model read back: bare, after thoughts, fenced, or without an object; takes by name, confidence cut to 0..1."""
    body = F.to_json(F.struct(F.col("event_type").alias("take"), (F.col("value") / 100).alias("confidence")))
    k = F.col("event_id") % 4
    answer = F.when(k == 0, body).when(k == 1, F.concat(F.lit('<think>{"take": "none"}</think> So: '), body)).when(k == 2, F.concat(F.lit('First {"take": "x"}\n```json\n'), body, F.lit("\n```"))).otherwise("no object")
    got = table(spark, d, "events").select("event_id", folds.answer(answer, "take STRING, confidence DOUBLE", "take").alias("a"))
    take = F.when(F.col("a.take") == "purchase", "+").when(F.col("a.take") == "error", "-").when(F.col("a.take") == "view", "=")
    cut = F.when(F.col("a.confidence").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "a.confidence")))
    return got.select("event_id", take.alias("take"), cut.alias("confidence"))


_LABEL = "(?i)^(contact|licensed|see|more).{0,60}$"


@query(f"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(trim(x), '{_LABEL}')), true) AS place FROM l),
h AS (SELECT doc_id, text, place, array_to_string(l[1:greatest(coalesce(place, 0) - 1, 0)], chr(10)) AS head FROM p)
SELECT doc_id, CASE WHEN coalesce(place, 0) > 0 AND length(head) * 2 >= length(text) THEN head ELSE text END AS body FROM h""")
def related_cut(spark: SparkSession, d: str) -> DataFrame:
    """Texts up to the first line that is only a label, unless over half would go."""
    return table(spark, d, "documents").select("doc_id", text.without_related(F.col("text"), _LABEL).alias("body"))


_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT page_id, {_PLAIN.format("html")} AS raw, {_PLAIN.format("array_to_string(regexp_extract_all(html, '(?s)<p(?: [^>]*)?>.*?</p>'), ' ')")} AS kept FROM pages)
SELECT page_id, length(raw) AS raw_chars, length(kept) AS kept_chars, length(raw) >= 200 AND length(kept) < 0.8 * length(raw) AS lossy FROM p""")
def sanitiser_guard(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose paragraphs alone hold less than four fifths of the text, judged from 200 characters on."""
    paragraphs = F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<p(?: [^>]*)?>.*?</p>"), F.lit(0)), " ")
    raw, kept = F.length(text.without_tags(F.col("html"))), F.length(text.without_tags(paragraphs))
    rows = table(spark, d, "pages").select("page_id", raw.cast("long").alias("raw_chars"), kept.cast("long").alias("kept_chars"))
    return rows.withColumn("lossy", (F.col("raw_chars") >= 200) & (F.col("kept_chars") < F.col("raw_chars") * 0.8))


@query("""WITH c AS (SELECT conv_id, turn, split_part(replace(text, chr(10), ' '), ' ', 1) || ' ' || turn AS head FROM conversations) SELECT conv_id, array_to_string(CASE WHEN count(*) >= 3 THEN list(head ORDER BY turn) ELSE [] END, '|') AS heads FROM c GROUP BY conv_id""")
def section_heads(spark: SparkSession, d: str) -> DataFrame:
    """Messages written as one text of headed blocks, and the heads found in it."""
    head = F.concat_ws(" ", F.split_part(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" "), F.lit(1)), "turn")
    block = F.concat(head, F.lit("\nThis is the body."))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x.b), "\n\n")
    return table(spark, d, "conversations").groupBy("conv_id").agg(joined.alias("t")).select("conv_id", F.array_join(text.sections(F.col("t")), "|").alias("heads"))


@query("""WITH r AS (SELECT doc_id, lang, source, regexp_replace(substr(string_split(text, chr(10))[1], 1, 60), '[^A-Za-z ]', '', 'g') AS h FROM documents), n AS (SELECT *, trim(h) AS headline FROM r WHERE trim(h) <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(headline) ORDER BY doc_id) AS r FROM n) SELECT doc_id, lang AS sector, headline, source, CASE doc_id % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '=' END AS take FROM k WHERE r = 1""")
def labelled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a labelled set read into columns, the first of each headline."""
    head = F.trim(F.regexp_replace(F.substring(title(), 1, 60), "[^A-Za-z ]", ""))
    take = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("=")), (F.col("doc_id") % 3 + 1).cast("int"))
    line = F.concat("lang", F.lit(" – "), head, F.lit(" ["), "source", F.lit("] ("), take, F.lit(")"))
    rows = table(spark, d, "documents").where(head != "").select("doc_id", text.labelled_row(line).alias("r")).where("r IS NOT NULL").select("doc_id", "r.*")
    first = F.row_number().over(Window.partitionBy(F.lower("headline")).orderBy("doc_id"))
    return rows.withColumn("n", first).where("n = 1").drop("n")


@query(f"""WITH t AS (SELECT doc_id, list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in TOPICS)}], lambda x: x IS NOT NULL) AS t FROM documents)
SELECT doc_id FROM t WHERE list_has_any(t, ['shout', 'table']) AND len(list_filter(t, lambda x: x NOT IN ('shout', 'table', 'number'))) = 0""")
def low_value_topics(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose topics are all of low value or generic, at least one of low value."""
    low = classify.subset_of(text.tagged(F.col("text"), TOPICS), ["shout", "table"], ["number"])
    return table(spark, d, "documents").where(low).select("doc_id")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus IN ('O', 'F') AND NOT (o_orderpriority ILIKE '5-%') AND (o_custkey < 50 OR (o_orderpriority LIKE '1-%' AND o_orderstatus <> 'F'))""")
def given_filters(spark: SparkSession, d: str) -> DataFrame:
    """Filters given as data reach the scan as pushed filters."""
    given = [("o_totalprice", "gte", 1000.0), ("o_orderstatus", "in", ["O", "F"]), ("", "not", ("o_orderpriority", "ilike", "5-*")),
             ("", "or", [("o_custkey", "lt", 50), ("", "and", [("o_orderpriority", "like", "1-*"), ("o_orderstatus", "neq", "F")])])]
    return table(spark, d, "orders").where(conditions.condition("", "and", given)).select("o_orderkey", "o_totalprice")


@query(f"""WITH g AS (SELECT md5(lower(trim(text))) AS k, min(doc_id) AS doc_id, count(DISTINCT source) AS sources, max(CASE WHEN regexp_matches(text, '(?i)licensed') THEN 2 WHEN regexp_matches(text, '[0-9]{{3}}') THEN 1 ELSE 0 END) AS best, bool_or(coalesce(source = 'src01', false)) AS tier,
max(CASE WHEN regexp_matches(text, ' \\| ') THEN 1 ELSE 0 END) AS covered, min(lang) AS lang FROM documents GROUP BY 1), s AS (SELECT doc_id, lang, covered * 3 + best + tier::INT + least(2, sources - 1) AS score FROM g)
SELECT doc_id, lang, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id DESC) AS r FROM s) WHERE r <= 5""")
def top_stories(spark: SparkSession, d: str) -> DataFrame:
    """Stories of equal texts scored by names, take, source and breadth: the five best of each language."""
    t = F.col("text")
    best = F.when(t.rlike("(?i)licensed"), 2).when(t.rlike("[0-9]{3}"), 1).otherwise(0)
    groups = table(spark, d, "documents").groupBy(F.md5(F.lower(F.trim("text"))).alias("k")).agg(
        F.min("doc_id").alias("doc_id"), F.count_distinct("source").alias("sources"), F.max(best).alias("best"), F.bool_or(F.coalesce(F.col("source") == "src01", F.lit(False))).alias("tier"),
        F.max(t.rlike(r" \| ").cast("int")).alias("covered"), F.min("lang").alias("lang"))
    rows = groups.select("doc_id", "lang", classify.story_score(F.col("covered"), F.col("best"), F.col("tier"), F.col("sources")).alias("score"))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("doc_id"))
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")


@query(r"""WITH p AS (SELECT page_id, url, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') AS domain, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title FROM pages)
SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN 'empty' WHEN NOT regexp_matches(url, '^https?://') THEN 'scheme' WHEN title = '' THEN 'title' END AS reason, substr(sha1(url), 1, 12) AS id, title,
CASE WHEN coalesce(domain, '') = '' THEN '—' WHEN domain = 'example.com' THEN 'Example' ELSE upper(substr(split_part(domain, '.', 1), 1, 1)) || lower(substr(split_part(domain, '.', 1), 2)) END AS label FROM p""")
def published_items(spark: SparkSession, d: str) -> DataFrame:
    """Pages as published items: id, title and source label, or the first reason not to publish."""
    head = F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    reason = F.coalesce(text.url_reject(F.col("url"), []), F.when(head == "", "title"))
    label = text.source_label(text.domain(F.col("url")), {"example.com": "Example"})
    return table(spark, d, "pages").select("page_id", reason.alias("reason"), text.short_id(F.col("url")).alias("id"), head.alias("title"), label.alias("label"))
