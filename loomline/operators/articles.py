"""Articles out of pages by column expressions: typed blocks, each with its share of link text, judged by the rules of the
page's domain.

Rules are a table (RULES): the suffix of domains that they are for, marks between which the article stands, patterns of
blocks to leave out, the least length and greatest link share of a block, and whether the domain's bodies are locked. A
domain takes the rules of its longest suffix. Domains are matched once each, not once a page, and no text is shuffled for
it unless domains with rules are too many to send out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import domain
from loomline.functions.unicode import bound, unescaped

RULES = "suffix string, start string, stop string, drop string, least int, most_links double, locked boolean"
#: Rules of domains without any: no marks, blocks from 25 characters with links for less than a third of the text.
DEFAULT = ("", None, None, None, 25, 0.33, False)

# Elements whose contents are no text, and elements that begin a block.
GONE = ("script", "style", "head", "nav", "footer", "form", "aside", "noscript", "template", "iframe", "svg", "button", "select")
BLOCKS = "p|h[1-6]|li|blockquote|td|th|pre|div|section|article|main|ul|ol|dl|dd|dt|table|tbody|tr|br|hr|header|figure|figcaption|body|html"
KINDS = {"h": "heading", "li": "item", "blockquote": "quote", "td": "cell", "th": "cell"}
OPEN, KIND = "\x01", "\x02"


def stripped(html: Column) -> Column:
    """Without comments and elements that hold no text of the page."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in GONE:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return out


def blocks(html: Column) -> Column:
    """array<struct<kind, text, links>>: texts of blocks in order, and how many of their characters are links' text."""
    cut = F.regexp_replace(F.regexp_replace(stripped(html), rf"(?i)<({BLOCKS})\b[^>]*>", f"{OPEN}$1{KIND}"), rf"(?i)</({BLOCKS})\s*>", OPEN + KIND)
    plain = lambda c: F.trim(F.regexp_replace(unescaped(F.regexp_replace(c, r"<[^>]*>", "")), r"[ \t\r\n\f\x0B\x{a0}]+", " "))

    def block(part: Column) -> Column:
        tag, body = F.lower(F.substring_index(part, KIND, 1)), F.regexp_replace(part, f"^[^{KIND}]*{KIND}", "")
        kind = F.when(tag.rlike("^h[1-6]$"), KINDS["h"]).when(tag == "li", KINDS["li"]).when(tag == "blockquote", KINDS["blockquote"]).when(tag.isin("td", "th"), KINDS["td"]).otherwise("text")
        linked = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1)), plain)
        return F.struct(kind.alias("kind"), plain(body).alias("text"), F.aggregate(linked, F.lit(0), lambda n, x: n + F.length(x)).alias("links"))

    return F.filter(F.transform(F.split(cut, OPEN, -1), block), lambda b: b["text"] != "")


def article_text(html: Column, start: Column, stop: Column, drop: Column, least: Column, most_links: Column) -> Column:
    """The blocks that stand between the marks, are long enough (headings in any length) and not mostly links, by blank lines."""
    begun = F.when(start.isNull() | ~F.contains(html, start), html).otherwise(F.call_function("substring_index", html, start, F.lit(-1)))
    inside = F.when(stop.isNull() | ~F.contains(begun, stop), begun).otherwise(F.call_function("substring_index", begun, stop, F.lit(1)))

    def kept(b: Column) -> Column:
        n = F.length(b["text"])
        return ((n >= least) | (b["kind"] == "heading")) & (b["links"] <= most_links * n) & (drop.isNull() | ~F.rlike(b["text"], F.coalesce(drop, F.lit("^$"))))

    return F.array_join(F.transform(F.filter(blocks(inside), kept), lambda b: b["text"]), "\n\n")


def rules_of(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """domain and the rules of its longest suffix, for domains that have one."""
    labels = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = domains.select("domain").distinct().select("domain", F.explode(suffixes).alias("suffix"))
    columns = [f.split()[0] for f in RULES.split(", ")]
    best = each.join(rules.select(*columns).where("suffix <> ''"), "suffix").groupBy("domain").agg(F.max_by(F.struct(*columns), F.length("suffix")).alias("r"))
    return best.select("domain", "r.*")


def articles(pages: DataFrame, key: str, url: str, html: str, rules: DataFrame, least: int = 200, most: int = 3500, teaser: str = "", boilerplate: str = "") -> DataFrame:
    """key, domain, suffix (of the rules taken), body and reason of each page.

    The body is null and reason tells why where there is none: "no url", "locked", "short", "teaser" or "boilerplate";
    else reason is "ok" and the body is cut at `most` characters. A null html is an empty one.
    """
    rows = pages.select(key, F.col(url).alias("url_"), F.coalesce(domain(F.col(url)), F.lit("")).alias("domain"), F.coalesce(html, F.lit("")).alias("html_"))
    found = rows.join(rules_of(rows.select("domain"), rules), "domain", "left")
    # A domain's own rules count as they are, nulls too. They get names of their own: an alias like a column's name would be
    # taken for the column inside the functions of blocks.
    own = [F.when(F.col("suffix").isNotNull(), F.col(n)).otherwise(F.lit(v)).cast(kind).alias(f"{n}_") for (n, kind), v in zip((f.split() for f in RULES.split(", ")), DEFAULT, strict=True)]
    found = found.select(key, "domain", "url_", "html_", *own)
    text = article_text(*(F.col(c) for c in ("html_", "start_", "stop_", "drop_", "least_", "most_links_")))
    # What is refused without its text is not taken apart.
    early = F.when(F.coalesce("url_", F.lit("")) == "", "no url").when(F.col("locked_"), "locked")
    read = found.select(key, "domain", F.col("suffix_").alias("suffix"), early.alias("early"), F.when(early.isNull(), text).alias("text"))
    never = F.lit(False)
    late = F.when(F.length("text") < least, "short").when(F.col("text").rlike(teaser) if teaser else never, "teaser").when(F.col("text").rlike(boilerplate) if boilerplate else never, "boilerplate").otherwise("ok")
    judged = read.withColumn("reason", F.coalesce("early", late))
    return judged.select(key, "domain", "suffix", F.when(F.col("reason") == "ok", F.substring("text", 1, most)).alias("body"), "reason")


def headline(c: Column, repair) -> Column:
    """A title with its character references read, where it has some, and misread letters repaired."""
    return bound(F.when(c.rlike(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"), unescaped(c)).otherwise(c), repair)
