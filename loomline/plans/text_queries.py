"""Queries over documents, pages, benchmark, labels and conversations: filters, tags, similarity, html and urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import numbers, text
from loomline.operators import aggregates, classify, clusters, joins, series
from loomline.plans.registry import registry
from loomline.sources import table

QUERIES, SQL, query = registry()


# Rule tables for the driver's invented texts; any others may be passed to the operators.
KEYWORDS = ["the", "schung", "que", "para", "license", "version", "von"]
BLOCKED = ["trash", "clown", "apache", "idiot"]
TOPICS = [("licence", r"(?i)licensed?"), ("shout", r"[A-Z]{6,}!!"), ("table", r" \| "), ("contact", r"@[a-z]+\."), ("french", r"(?i)eau"), ("number", r"[0-9]{3}")]
SECTORS = [("en", ["th", "ing", "tion"]), ("de", ["sch", "ung", "keit"]), ("es", ["ción", "rr", "ñ"])]
UP, DOWN = ["and", "the", "for", "une", "und"], ["not", "was", "con", "les", "die"]
#: Document numbers of a digest window.
WINDOW = 400
STOP = ["the", "and", "der", "die", "und", "les", "des", "que", "los", "las"]


def title():
    return F.substring_index("text", "\n", 1)


def _words(c: str) -> str:
    """RE2 has no look-behind: a word is bounded by other characters or the ends."""
    return r"(?i)(^|[^\pL\pN_])(" + "|".join(sorted(c, key=lambda w: (-len(w), w))) + r")([^\pL\pN_]|$)"


@query(f"""
SELECT doc_id, CASE WHEN regexp_matches(t, '{_words(BLOCKED)}') THEN 'blocked' WHEN length(t) < 15 OR length(t) - length(replace(t, ' ', '')) < 2 THEN 'index' WHEN regexp_matches(text, '{_words(KEYWORDS)}') THEN 'keep' ELSE 'no keyword' END AS decision
FROM (SELECT *, string_split(text, chr(10))[1] AS t FROM documents)""")
def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    """The article filter's ladder: title blocklist, index pages, then a keyword anywhere."""
    return table(spark, d, "documents").select("doc_id", classify.decision(title(), F.col("text"), KEYWORDS, BLOCKED).alias("decision"))


@query(f"""SELECT doc_id, {", ".join(f"regexp_matches(text, '{_words([k])}') AS has_{k}" for k in KEYWORDS)} FROM documents""")
def keyword_matches(spark: SparkSession, d: str) -> DataFrame:
    """Which keywords a text holds as whole words."""
    found = text.matches(F.col("text"), KEYWORDS)
    return table(spark, d, "documents").select("doc_id", found.alias("m")).select("doc_id", *[F.array_contains("m", k).alias(f"has_{k}") for k in KEYWORDS])


@query("SELECT doc_id FROM (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents) WHERE length(t) < 15 OR length(t) - length(replace(t, ' ', '')) < 2 OR regexp_matches(t, '(?i)^(page \\d+|[a-z] ?- ?[a-z])$')")
def page_index_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(text.page_index(title())).select("doc_id")


@query(f"""SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in TOPICS)}], lambda x: x IS NOT NULL), ',') AS topics FROM documents""")
def topic_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(text.tagged(F.col("text"), TOPICS), ",").alias("topics"))


def _count(words: list[str]) -> str:
    return " + ".join(f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)}" for w in words)


@query(f"""WITH s AS (SELECT doc_id, {", ".join(f"{_count(w)} AS {n}" for n, w in SECTORS)} FROM (SELECT doc_id, lower(text) AS low FROM documents))
SELECT doc_id, CASE WHEN greatest(en, de, es) = 0 THEN NULL WHEN en = greatest(en, de, es) THEN 'en' WHEN de = greatest(en, de, es) THEN 'de' ELSE 'es' END AS sector FROM s""")
def sector_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The sector whose keywords (as substrings) occur most; the first of equals."""
    scores = [(n, classify.substring_hits(F.col("text"), w)) for n, w in SECTORS]
    return table(spark, d, "documents").select("doc_id", aggregates.first_of_greatest(scores).alias("sector"))


@query(f"""WITH c AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ({", ".join(f"'{x}'" for x in UP)}))) AS up, len(list_filter(w, lambda x: x IN ({", ".join(f"'{x}'" for x in DOWN)}))) AS down FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\pL\\pN]+') AS w FROM documents))
SELECT doc_id, up, down, round_even(CASE WHEN up + down = 0 THEN 0 ELSE (up - down) / (up + down) END, 3) AS ratio FROM c""")
def sentiment_ratio(spark: SparkSession, d: str) -> DataFrame:
    """(up - down) / (up + down) of direction words, zero for none."""
    w = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    hits = lambda words: F.size(F.filter(w, lambda x: x.isin(words))).cast("long")
    rows = table(spark, d, "documents").select("doc_id", hits(UP).alias("up"), hits(DOWN).alias("down"))
    return rows.withColumn("ratio", classify.balance(F.col("up"), F.col("down")))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\\pL\\pN_\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS folded FROM documents")
def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.folded(F.col("text")).alias("folded"))


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ({})))".format(", ".join(f"'{w}'" for w in STOP))


@query(f"""WITH a AS (SELECT doc_id, {_TOKENS} AS a FROM documents), b AS (SELECT item_id, {_TOKENS} AS b FROM benchmark),
j AS (SELECT doc_id, item_id, len(list_intersect(a, b)) AS i, len(a) + len(b) AS n FROM a, b)
SELECT doc_id, item_id, round(i / greatest(n - i, 1), 6) AS jaccard FROM j WHERE i / greatest(n - i, 1) >= 0.3""")
def token_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documents and benchmark items whose token sets are alike."""
    sets = lambda name, i: table(spark, d, name).select(i, text.tokens(F.col("text"), STOP).alias("tokens"))
    return joins.token_jaccard(sets("documents", "doc_id"), sets("benchmark", "item_id"), "doc_id", "item_id", "tokens", 0.3).withColumn("jaccard", F.round("jaccard", 6))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(lower(trim(text))) ORDER BY lang IS NULL, length(text) DESC, doc_id) AS r FROM documents) WHERE r = 1")
def near_dup_best_version(spark: SparkSession, d: str) -> DataFrame:
    """Of equal texts (but for case and outer spaces) the best version."""
    order = [F.col("lang").isNull(), F.desc(F.length("text")), F.col("doc_id")]
    return series.newest(table(spark, d, "documents"), [F.md5(F.lower(F.trim("text")))], order).select("doc_id", "source")


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages""")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.without_tags(F.col("html")).alias("plain"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    return rows.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '(#.*)$', 1) AS mark, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref)=')), '&') AS kept FROM p)
SELECT page_id, base || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END || mark AS clean, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS domain FROM k""")
def url_clean(spark: SparkSession, d: str) -> DataFrame:
    """Urls without campaign and referrer parameters, and their domain."""
    return table(spark, d, "pages").select("page_id", text.without_parameters(F.col("url"), "utm_[a-z]+|ref").alias("clean"), text.domain(F.col("url")).alias("domain"))


@query("""SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN 'empty' WHEN length(url) > 2000 THEN 'long' WHEN NOT regexp_matches(url, '^https?://') THEN 'scheme' WHEN regexp_matches(lower(url), '^https?://(www\\.)?cheap-pills\\.example\\.com(/|$)') THEN 'blocked' END AS reason FROM pages""")
def url_reject_reason(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.url_reject(F.col("url"), ["cheap-pills.example.com"]).alias("reason"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+', '[email]', 'g'), '\\+?[0-9]{1,3}[ -]\\(?[0-9]{2,4}\\)?[ -][0-9]{3,5}[ -][0-9]{3,5}', '[phone]', 'g') AS masked FROM documents""")
def contact_mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.masked(F.col("text")).alias("masked"))


@query("""WITH c AS (SELECT conv_id, turn, regexp_split_to_array(text, '[.;!?]+\\s*|, ') AS parts FROM conversations), u AS (SELECT conv_id, turn, unnest(parts) AS clause FROM c) SELECT conv_id, turn, count(*) AS clauses, max(length(clause)) AS longest FROM u WHERE clause <> '' GROUP BY ALL""")
def thread_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Clauses of each message."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", r"[.;!?]+\s*|, ")).alias("clause")).where("clause <> ''")
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("clauses"), F.max(F.length("clause")).cast("long").alias("longest"))


@query()
def direction_by_topic(spark: SparkSession, d: str) -> DataFrame:
    """For each topic of a text, the direction word nearest to it in a clause, turned by a negator just before."""
    return classify.directions(table(spark, d, "documents"), "doc_id", "text", [("the", r"\bthe\b"), ("que", r"\bque\b")], UP[1:], DOWN, ["not", "no", "nicht", "pas"])


@query("""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1), '\\.[a-z]+$', ''), '[-_]+', ' ', 'g') AS w FROM pages) SELECT page_id, upper(substr(trim(w), 1, 1)) || substr(trim(w), 2) AS title FROM s""")
def slug_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.slug_title(F.col("url")).alias("title"))


@query("""SELECT doc_id, nullif(rtrim(substr(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 200)), '') AS snippet, substr(sha1(text), 1, 12) AS short_id FROM documents""")
def snippet_and_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"), text.short_id(F.col("text")).alias("short_id"))


@query("""SELECT doc_id, round(list_sum(list_transform(n, lambda x: x::DOUBLE)), 3) AS total, len(n) AS n FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[A-Za-z_]+[0-9]+\\w*|[0-9]+[A-Za-z_]\\w*', ' ', 'g'), '[0-9]+(?:\\.[0-9]+)?') AS n FROM documents) WHERE len(n) > 0""")
def number_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of each text: their sum and count."""
    rows = table(spark, d, "documents").select("doc_id", text.numbers(F.col("text")).alias("n")).where(F.size("n") > 0)
    return rows.select("doc_id", F.round(F.aggregate("n", F.lit(0.0), lambda s, x: s + x), 3).alias("total"), F.size("n").cast("long").alias("n"))


@query("""SELECT p_partkey, p_retailprice AS price, p_retailprice AS again FROM part""")
def price_text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Prices written with dots for thousands and a decimal comma, and with commas and a dot, read back."""
    plain = F.format_number("p_retailprice", 2)
    swapped = F.translate(F.translate(F.translate(plain, ",", "_"), ".", ","), "_", ".")
    return table(spark, d, "part").select("p_partkey", numbers.price_text(F.concat(F.lit("$ "), plain)).alias("price"), numbers.price_text(F.concat(F.lit("R$ "), swapped)).alias("again"))


@query("""SELECT quality AS gold, CASE WHEN regexp_matches(text, '!!|\\*\\*\\*|\\$\\$\\$|%%%| \\| ') THEN 0 ELSE 1 END AS pred, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Gold labels against a plain rule."""
    pred = F.when(F.col("text").rlike(r"!!|\*\*\*|\$\$\$|%%%| \| "), 0).otherwise(1)
    ruled = table(spark, d, "documents").select("doc_id", pred.alias("pred"))  # below the join, so that no text is shuffled
    return table(spark, d, "labels").join(ruled, "doc_id").groupBy(F.col("quality").alias("gold"), "pred").agg(F.count("*").alias("n"))


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def topk_per_source(spark: SparkSession, d: str) -> DataFrame:
    """The three longest texts of each source."""
    w = Window.partitionBy("source").orderBy(F.desc(F.length("text")), "doc_id")
    return table(spark, d, "documents").withColumn("r", F.row_number().over(w)).where("r <= 3").select("source", "doc_id")


@query(f"""WITH f AS (SELECT doc_id, regexp_matches(text, '(?i)licensed') AS a, regexp_matches(text, '[A-Z]{{6,}}!!') AS b, regexp_matches(text, '{_words(BLOCKED)}') AS c, length(text) < 300 AS e FROM documents)
SELECT doc_id, CASE WHEN a THEN 'licence' WHEN c THEN 'abuse' WHEN b THEN 'shout' WHEN e THEN 'short' END AS reason FROM f""")
def exclusion_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The first of ordered reasons to leave a document out."""
    t = F.col("text")
    rules = [("licence", t.rlike("(?i)licensed")), ("abuse", t.rlike(text.whole_words(BLOCKED))), ("shout", t.rlike("[A-Z]{6,}!!")), ("short", F.length(t) < 300)]
    return table(spark, d, "documents").select("doc_id", classify.first_reason(rules).alias("reason"))


@query(f"""WITH f AS (SELECT doc_id, regexp_matches(text, '(?i)licensed') AS a, regexp_matches(text, '[A-Z]{{6,}}!!') AS b, regexp_matches(text, '{_words(BLOCKED)}') AS c FROM documents),
s AS (SELECT doc_id, CASE WHEN a THEN 1 ELSE 0 END - CASE WHEN b THEN 1 ELSE 0 END - CASE WHEN c THEN 2 ELSE 0 END AS score, concat_ws(',', CASE WHEN a THEN 'licence' END, CASE WHEN b THEN 'shout' END, CASE WHEN c THEN 'abuse' END) AS rules FROM f)
SELECT doc_id, score, rules, CASE WHEN score > 0 THEN '+' WHEN score < 0 THEN '-' WHEN rules <> '' THEN '=' END AS take FROM s""")
def rule_scores(spark: SparkSession, d: str) -> DataFrame:
    """A take from scored rules: sum of their deltas, the rules that fired, the sign."""
    t = F.col("text")
    rules = [("licence", 1, t.rlike("(?i)licensed")), ("shout", -1, t.rlike("[A-Z]{6,}!!")), ("abuse", -2, t.rlike(text.whole_words(BLOCKED)))]
    return classify.scored(table(spark, d, "documents"), rules).select("doc_id", "score", "rules", "take")


_TITLE_WORDS = f"list_filter(list_distinct(regexp_split_to_array(trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\\pL\\pN]+', ' ', 'g')), ' ')), lambda w: length(w) > 2 AND w NOT IN ({', '.join(f"'{w}'" for w in STOP)}))"
_TAGS = f"list_filter([{', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in TOPICS)}], lambda x: x IS NOT NULL)"


@query(f"""WITH RECURSIVE r AS (SELECT lang, doc_id // {WINDOW} AS part, doc_id, row_number() OVER (PARTITION BY lang, doc_id // {WINDOW} ORDER BY doc_id) AS n, {_TITLE_WORDS} AS w, {_TAGS} AS c FROM documents),
g AS (
  SELECT lang, part, 0::BIGINT AS n, NULL::BIGINT AS doc_id, NULL::BIGINT AS story, []::STRUCT(story BIGINT, w VARCHAR[], c VARCHAR[])[] AS held FROM r WHERE n = 1
  UNION ALL
  SELECT lang, part, n, doc_id, CASE WHEN hit IS NULL THEN doc_id ELSE held[hit].story END,
    CASE WHEN hit IS NULL THEN list_append(held, {{'story': doc_id, 'w': w, 'c': c}}) ELSE list_transform(held, lambda x, i: CASE WHEN i = hit THEN {{'story': x.story, 'w': list_distinct(list_concat(x.w, w)), 'c': list_distinct(list_concat(x.c, c))}} ELSE x END) END
  FROM (SELECT r.*, held, nullif(list_position(list_transform(held, lambda x: (len(list_intersect(x.w, r.w)) > 0 AND len(list_intersect(x.w, r.w)) >= 0.45 * len(list_distinct(list_concat(x.w, r.w)))) OR (len(list_intersect(x.w, r.w)) >= 2 AND len(list_intersect(x.c, r.c)) > 0)), true), 0) AS hit
    FROM g JOIN r ON r.lang = g.lang AND r.part = g.part AND r.n = g.n + 1))
SELECT lang, part, doc_id, story FROM g WHERE n > 0""")
def story_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Stories of each language's window of documents: titles that are alike, or share a tag and two words, as groups grow."""
    rows = table(spark, d, "documents").select("lang", F.floor(F.col("doc_id") / WINDOW).alias("part"), "doc_id", text.tokens(title(), STOP).alias("words"), text.tagged(F.col("text"), TOPICS).alias("tags"))
    return clusters.grown(rows, ["lang", "part"], "doc_id", "words", "tags")
