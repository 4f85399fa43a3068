"""Every query of the catalogue against its SQL on the smallest tables, and small cases of operators."""

import datetime
import decimal
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomline.functions import conditions, numbers, text, times
from loomline.operators import aggregates, budgets, classify, joins, series, stores, views
from loomline.plans import catalogue
from loomline.sources import feeds

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return v.date()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in catalogue.SQL:
        r = duck.execute(catalogue.SQL[name])
        columns = [c[0] for c in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, r.fetchall())


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("given, want", [("1.234,56", 1234.56), ("$1,234.56", 1234.56), ("1,234", 1234.0), ("12,5", 12.5), ("n/a", None), (None, None)])
def test_price_text(spark, given, want):
    assert one(spark, numbers.price_text(F.lit(given).cast("string"))) == want


def test_numbers(spark):
    assert one(spark, numbers.finite(F.lit(float("nan")))) is None and one(spark, numbers.finite(F.lit(float("-inf")))) is None
    assert one(spark, numbers.numeric_text(F.lit("1e5"))) is None and one(spark, numbers.numeric_text(F.lit(" -2.5 "))) == -2.5
    assert one(spark, numbers.half_up(F.lit(-2.5))) == -2


def test_times(spark):
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, times.minus_months(d("2023-03-31"), 1)) == datetime.date(2023, 3, 3)
    assert one(spark, times.previous_business_day(d("2024-01-01"))) == datetime.date(2023, 12, 29)
    assert one(spark, times.iso_week(d("2024-12-30"))) == "2025-w01"


def test_gauge_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(21, 20, 40), (1, 0, 3), (23, 20, 40)], "u int, d int, s int")
    assert [r.g for r in rows.select(aggregates.gauge(F.col("u"), F.col("d"), F.col("s"), 20).alias("g")).collect()] == [51, None, 54]


def test_directions():
    got = classify.nearest("Prices did not rise. ore fell; ore rise", [("price", "price"), ("ore", "ore")], ["rise"], ["fell"], ["not"])
    assert got == {"price": -1, "ore": -1}


def test_asof_ties_and_gaps(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 5, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 5, 50.0), ("a", 3, 30.0)], "k string, t int, v double")
    strict = {r.id: r.v for r in joins.asof(left, right, ["k"], "t", ["v"]).collect()}
    loose = {r.id: r.v for r in joins.asof(left, right, ["k"], "t", ["v"], strict=False).collect()}
    assert strict == {1: 30.0, 2: None, 3: None} and loose == {1: 50.0, 2: None, 3: None}


def test_unique_and_banned(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeated key"):
        stores.assert_unique(rows, ["k"]).collect()
    nested = rows.select(F.array(F.struct(F.col("v").alias("secret"))).alias("list"))
    assert stores.banned(nested, {"secret"}) == ["$.list[].secret"]


def test_token_bucket_steps(spark):
    rng = random.Random(7)
    times_ = sorted(rng.randrange(10_000) for _ in range(200))
    given = [("a", n, t, float(rng.randrange(60))) for n, t in enumerate(times_)]
    rows = spark.createDataFrame(given, "k string, n int, s long, cost double").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {r.n: round(r.available, 6) for r in budgets.token_bucket(rows, "k", ["n"], "ts", "cost", 100.0, 0.5).collect()}
    left, before, want = 100.0, times_[0], {}
    for _, n, t, cost in given:
        left = min(100.0, left + (t - before) * 0.5)
        want[n], before = round(left, 6), t
        left -= cost
    assert got == want


def test_repaired_text(spark):
    for whole in ("Ação ñandú – 10 € 🙂 fim", "plain", "", "Ã sozinho"):
        assert one(spark, text.repaired(F.decode(F.encode(F.lit(whole), "UTF-8"), "ISO-8859-1"))) == whole
    assert one(spark, text.repaired(F.lit("já certo"))) == "já certo" and one(spark, text.repaired(F.lit(None).cast("string"))) is None


def test_unknown_condition():
    with pytest.raises(ValueError, match="unknown condition"):
        conditions.condition("x", "near", 1)


def test_conditions_and_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, 5)], "k int, v int")
    assert [r.k for r in rows.where(conditions.condition("", "not", ("v", "gt", 9))).collect()] == [2]
    assert [r.k for r in rows.orderBy(conditions.order("v", descending=True)).collect()] == [2, 1]


def test_run_length_gaps(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0), ("a", 9, 9.0)], "k string, m int, v double")
    got = sorted((r.start, r["values"]) for r in series.run_length(rows, "k", "m", "v", 3).collect())
    assert got == [(1, [1.0, None, 3.0]), (9, [9.0])]


def test_entry_without_llm(monkeypatch, spark):
    import importlib
    import sys

    import __spark_entry__

    with monkeypatch.context() as m:
        for gone in ("corpus_pipeline", "loomline.llm", "loomline.llm.queries"):
            m.setitem(sys.modules, gone, None)
        entry = importlib.reload(__spark_entry__)
        assert set(entry.queries()) == set(catalogue.QUERIES)
        assert entry.entry(spark).count() > 0
    importlib.reload(__spark_entry__)


def test_masks(spark):
    assert one(spark, text.masked(F.lit("mail a.b@c.example.org or +55 11 98765-4321 now"))) == "mail [email] or [phone] now"
    assert one(spark, text.url_reject(F.lit("https://u:p@x.org/"), [])) == "credential"


def test_rss_dates_caps_and_junk(spark):
    item = lambda n, date: f"<item><title>T{n} &lt;b&gt;x&lt;/b&gt;</title><link>u{n}</link><description>{'word ' * 200}</description>{date}</item>"
    dates = ["<pubDate>Mon, 8 Jan 2024 10:00:00 +0300</pubDate>", "<pubDate>2024-01-09T00:00:00Z</pubDate>", "<pubDate>soon</pubDate>", "", "<pubDate>2020-01-01</pubDate>"]
    rows = spark.createDataFrame([("a", item(n, d)) for n, d in enumerate(dates)] + [("a", "<item></item>"), ("a", None)], "s string, x string")
    got = feeds.rss(rows, "s", "x", F.lit("2024-01-01").cast("timestamp"), 3).orderBy(F.desc_nulls_last("published"), "url").collect()
    assert [r.url for r in got] == ["u1", "u0", "u2"] and got[0].title == "T1 x" and len(got[0].snippet) <= 400
    assert got[1].published == datetime.datetime(2024, 1, 8, 7)


def test_payloads(spark):
    rows = spark.createDataFrame([("täxt",), ("",), (None,)], "t string")
    back = [r.b for r in rows.select(feeds.unpacked(feeds.packed(F.col("t"), b"key"), b"key").alias("b")).collect()]
    assert back == ["täxt", "", None]
    assert one(spark, feeds.unpacked(F.lit("AAAA"), b"key")) is None and one(spark, feeds.unpacked(F.lit("not base64!"), b"key")) is None


def test_view_operators(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, 7, "c"), (4, None, "d")], "k int, at int, v string")
    new = spark.createDataFrame([(1, 5, "A"), (2, 1, "B"), (3, None, "C"), (5, None, None)], "k int, at int, v string")
    got = {r.k: (r.at, r.v, r.src) for r in views.newest_stamp(old, new, ["k"], "at").collect()}
    assert got == {1: (5, "A", 1), 2: (1, "B", 1), 3: (7, "c", 0), 4: (None, "d", 0), 5: (None, None, 1)}
    probes = views.refreshed(views.probe(old.where("k < 4"), ["k"], "at"), views.probe(old.union(new.where("k = 2")), ["k"], "at"), ["k"])
    assert {r.k: r.decision for r in probes.collect()} == {1: "keep", 2: "reread", 3: "keep", 4: "new"}
    rows = spark.createDataFrame([(1, 10, 3), (1, 11, 1), (1, 12, 3), (2, 1, 0)], "k int, n int, b int")
    assert [r.late for r in views.routed(rows, "k", "n", F.col("b")).orderBy("k", "n").collect()] == [False, True, False, False]
    assert views.newest_stamp(old.limit(0), new.limit(0), ["k"], "at").collect() == []


def test_content_hash(spark):
    a = spark.range(1).select(F.struct(F.lit(1).alias("x"), F.lit("t").alias("stamp")).alias("s"), F.array(F.struct(F.lit(2).alias("y"), F.lit("u").alias("stamp"))).alias("l"), F.lit("w").alias("stamp"))
    b = spark.range(1).select(F.array(F.struct(F.lit("zz").alias("stamp"), F.lit(2).alias("y"))).alias("l"), F.struct(F.lit(1).alias("x")).alias("s"))
    digest = lambda df: df.select(views.content_hash(df, {"stamp"}).alias("h")).first().h
    assert digest(a) == digest(b) != digest(b.select("l"))


def test_free_text(spark):
    given = "mail a.b@x.org https://ok.org/a@b?x=1 and http://u:p@h.org/ or http://10.1.2.3/ https://end.org"
    assert one(spark, text.free_text(F.lit(given), [])) == "mail [email] https://ok.org/a@b?x=1 and [link] or [link] https://end.org"
    assert one(spark, text.free_text(F.lit(""), [])) == "" and one(spark, text.free_text(F.lit(None).cast("string"), [])) is None


def test_charsets(spark):
    raw = F.lit("né".encode("latin-1"))
    assert one(spark, text.resolved(raw, F.lit(None).cast("string"))) == "né"
    assert one(spark, text.resolved(F.lit("né".encode()), F.lit("utf-8"))) == "né"
    assert one(spark, text.resolved(F.lit("né".encode()), F.lit("ISO-8859-1"))) == "nÃ©"
