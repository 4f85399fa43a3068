"""Copies in files, sitemap indexes, articles, names and counters on small hostile cases."""

import gzip
import json
import random
import re

from pyspark.sql import functions as F

from loomline.functions import text
from loomline.operators import aggregates, aliases, articles
from loomline.sources import copies, feeds


def test_copies_in_files(spark, tmp_path):
    body = json.dumps({"version": 3, "name": "é", "list": [1]}).encode()
    packed = copies.gzipped(body)
    files = {"plain.json": body, "packed.json": packed, "two.json": gzip.compress(body[:9]) + gzip.compress(body[9:]), "cut.json": packed[:-9], "broken.json": b"{", "array.json": b"[1]", "latin.json": b'{"version": 3, "n": "\xe9"}', "old.json": b'{"version": 2}', "none.json": b'{"a": 1}', "empty.json": b"", "tail.json": packed + b"junk"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    names = spark.createDataFrame([(n,) for n in [*files, "absent.json", "plain.json"]], "name string")
    got = {r.name: r.status for r in copies.published(spark, str(tmp_path), names, "name", "version", 3).collect()}
    ok, other, absent = {"plain.json", "packed.json", "two.json"}, {"old.json", "none.json"}, {"absent.json", "empty.json"}  # Spark reads no row of an empty file
    assert got == {n: "ok" if n in ok else "other version" if n in other else "absent" if n in absent else "unreadable" for n in [*files, "absent.json"]}
    gone = copies.published(spark, f"{tmp_path}/nowhere", names, "name", "version", 3)
    assert {r.status for r in gone.collect()} == {"absent"}
    assert copies.gzipped(body) == copies.gzipped(body) and gzip.decompress(packed) == body and copies.gunzipped(packed, len(body) - 1) is None and copies.gunzipped(packed, len(body)) == body


def test_states(spark):
    rows = [(1, b'{"version": 3, "n": "x", "more": {"a": 1}}'), (2, None), (3, b'{"version": 3, "n": {"is": 1}, "k": "text"}'), (4, b'{"version": 3')]
    got = copies.state(spark.createDataFrame(rows, "i int, c binary"), "c", "n STRING, k BIGINT, more STRUCT<a: INT>", 3).orderBy("i").collect()
    assert [r.status for r in got] == ["ok", "absent", "ok", "unreadable"]
    assert got[0].state.n == "x" and got[0].state.more.a == 1 and got[2].state.k is None and all(v is None for v in got[1].state) and all(v is None for v in got[3].state)


def test_sitemap_index_with_cycles(spark):
    link = lambda *urls: "<sitemapindex>" + "".join(f"<sitemap><loc> {u} </loc><lastmod>2024-01-01</lastmod></sitemap>" for u in urls) + "</sitemapindex>"
    entry = lambda *urls: "<urlset>" + "".join(f"<url><loc>{u}</loc><lastmod>2024-01-02</lastmod></url>" for u in urls) + "</urlset>"
    files = [("r", link("a", "b", "missing", "r")), ("a", link("r", "b", "c")), ("b", entry("https://x.org/a-story-of-iron&amp;ore", "https://x.org/b.JPG", "https://x.org/short")), ("c", entry("https://x.org/video/a-story-of-video", "https://x.org/another-story-here") + link("d")), ("d", link("e")), ("e", link("f")), ("f", link("g")), ("g", entry("https://x.org/too-deep-a-story")), ("lone", entry("https://x.org/nobody-leads-here")), ("null", None)]
    entries = feeds.sitemap_index(spark.createDataFrame(files, "url string, xml string"), spark.createDataFrame([("r",), ("none",)], "root string"))
    assert sorted((r.root, r.file) for r in entries.collect()) == [("r", "b")] * 3 + [("r", "c")] * 2
    got = feeds.news_of(entries, F.col("url").contains("story"), "/video/", F.lit("2024-01-01").cast("timestamp")).collect()
    assert sorted(r.url for r in got) == ["https://x.org/a-story-of-iron&ore", "https://x.org/another-story-here"]
    first = feeds.sitemap_index(spark.createDataFrame(files, "url string, xml string"), spark.createDataFrame([("r",)], "root string"), most=1)
    assert first.collect() == []  # the first map leads back to its root


def test_articles(spark):
    body = "".join(f"<p>Paragraph {i} of a story with enough letters to count.</p>" for i in range(6))
    page = f"<html><head><title>t</title></head><body><nav><p>Menu of many letters and more letters</p></nav><h2>Head &amp; title</h2>{body}<p><a href=x>Only a link with a long text of its own</a></p><ul><li>Item with <a href=x>link</a> and enough text of its own</li></ul><p>tiny</p></body></html>"
    rows = [(1, "https://www.a.example.com/x", page), (2, "https://locked.org/x", page), (3, None, page), (4, "https://b.org", "<p>short</p>"), (5, "https://b.org", None), (6, "https://sub.teaser.net/", page + "<p>Please log in to read all of this story</p>"), (7, "https://b.org", "<div class=x>" + page + "</div><!-- end --><p>After the article, with enough letters too</p>")]
    rules = spark.createDataFrame([("org", None, None, None, 25, 0.33, False), ("locked.org", None, None, None, 25, 0.33, True), ("example.com", None, None, "Paragraph [0-4] ", 10, 1.0, False), ("b.org", "<div class=x>", "<!-- end -->", None, 25, 0.33, False)], articles.RULES)
    got = {r.page_id: r for r in articles.articles(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html", rules, least=100, teaser="log in to").collect()}
    assert {i: r.reason for i, r in got.items()} == {1: "ok", 2: "locked", 3: "no url", 4: "short", 5: "short", 6: "teaser", 7: "ok"}
    assert got[1].suffix == "example.com" and got[1].body == "Head & title\n\nParagraph 5 of a story with enough letters to count.\n\nOnly a link with a long text of its own\n\nItem with link and enough text of its own"
    assert got[7].body.startswith("Head & title\n\nParagraph 0") and "Only a link" not in got[7].body and "After" not in got[7].body and got[7].body.endswith("enough text of its own")
    assert len(articles.articles(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html", rules, most=50).where("page_id = 7").first().body) == 50
    titles = spark.createDataFrame([("Arauco&rsquo;s",), ("AT&T & co",), ("SÃ¶dra &amp; x",), (None,)], "t string")
    assert [r.x for r in titles.select(articles.headline(F.col("t"), text.repaired).alias("x")).collect()] == ["Arauco’s", "AT&T & co", "Södra & x", None]


def brute_mentions(docs, names):
    runs = {}
    for alias, entity in names:
        w = re.findall(r"\w+", alias.lower())
        if w:
            runs[tuple(w)] = min(entity, runs.get(tuple(w), entity))
    out = []
    for k, t in docs:
        w, taken = re.findall(r"\w+", (t or "").lower()), set()
        found = [(n, i) for n in {len(r) for r in runs} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in runs]
        for n, i in sorted(found, key=lambda x: (-x[0], x[1])):
            if taken.isdisjoint(range(i, i + n)):
                taken.update(range(i, i + n))
                out.append((k, i, n, " ".join(w[i : i + n]), runs[tuple(w[i : i + n])]))
    return sorted(out)


def test_ten_thousand_aliases(spark):
    rng = random.Random(51)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "são"]
    names = [(rng.choice(["", " "]) + rng.choice([" ", "-", ", "]).join(rng.choices(vocabulary, k=rng.randint(1, 5))), f"e{i}") for i in range(10_000)] + [("...", "none"), ("", "none")]
    docs = [(i, " ".join(rng.choice([w, w.upper(), w + "."]) for w in rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(60)] + [(100, None), (101, "")]
    got = aliases.mentions(spark.createDataFrame(docs, "k long, t string"), "k", "t", spark.createDataFrame(names, "a string, e string"), "a", "e")
    assert sorted(tuple(r) for r in got.select("k", "place", "size", "run", "entity").collect()) == brute_mentions(docs, names)
    assert aliases.mentions(spark.createDataFrame(docs, "k long, t string"), "k", "t", spark.createDataFrame([], "a string, e string"), "a", "e").collect() == []


def test_nested_counters(spark):
    rows = spark.createDataFrame([("d", " vale3; VALE3 ;x", "+"), ("d", "x;;", None), ("d", None, "+"), ("e", "", "-"), ("f", "Vale3", "-")], "day string, tokens string, take string")
    got = {r.day: r.counts for r in aggregates.nested_counters(rows, ["day"], F.split("tokens", ";"), F.col("take")).collect()}
    assert got == {"d": {"VALE3": {"n": 2, "+": 2}, "X": {"n": 2, "+": 1}}, "f": {"VALE3": {"n": 1, "-": 1}}}


def test_aliases_of_a_long_text_are_marked_not_compared(spark):
    """Each span was once compared with all that were taken before it, and runs were made in interpreted lambdas."""
    texts = spark.createDataFrame([(1, "a b " * 20000), (2, None), (3, "b a"), (4, "")], "k long, t string")
    got = aliases.mentions(texts, "k", "t", spark.createDataFrame([("a b", "x"), ("b", "y"), ("b a", "z")], "a string, e string"), "a", "e")
    assert "lambda x_1" not in (plan := got._jdf.queryExecution().toString()) and "MapInArrow" in plan
    assert sorted(map(tuple, got.collect())) == [(1, 2 * i, 2, "a b", "x") for i in range(20000)] + [(3, 0, 2, "b a", "z")]
