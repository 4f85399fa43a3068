"""Decompositions and character references against Python's own."""

import html
import random
import unicodedata

from pyspark.sql import functions as F

from loomline.functions import unicode


def changed(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r.x for r in rows.orderBy("i").select(f(F.col("t")).alias("x")).collect()]


def test_nfkd_of_the_basic_plane(spark):
    chars = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(chars[i : i + 200]) for i in range(0, len(chars), 200)]
    assert changed(spark, texts, unicode.nfkd) == [unicodedata.normalize("NFKD", t) for t in texts]
    few = ["ǄǆﬁＡ①Ⅳｶﾞ한글ά῾ŉ", "", None, "plain ASCII", "🙂 stays"]
    assert changed(spark, few, unicode.nfkd_lower) == [t if t is None else unicodedata.normalize("NFKD", t).lower() for t in few]


def test_nfkd_orders_marks(spark):
    rng = random.Random(31)
    marks = [chr(i) for i in range(0x300, 0x370)] + ["֑", "ְ", "ཱ", "〪", "︠", "ﬞ", "᷺"]
    texts = ["".join(rng.choice(["a", "é", "ế", "ø", "각", "ﷺ"]) + "".join(rng.choices(marks, k=rng.randint(0, 5))) for _ in range(6)) for _ in range(400)]
    assert changed(spark, texts, unicode.nfkd) == [unicodedata.normalize("NFKD", t) for t in texts]


def test_references(spark):
    rng = random.Random(32)
    parts = ["&amp;", "&amp", "&lt;b&gt;", "&eacute;", "&eacute", "&notit;", "&notin;", "&nosuch;", "&#233;", "&#xE9", "&#XE9;", "&#0;", "&#128;", "&#150", "&#55296;", "&#1114112;", "&#99999999999999999999;", "&#xffffffffffff;", "&#13;", "&#11;", "&#x1F642;", "&", "&;", "&#;", "& ", "é", "text", "&NotEqualTilde;", "&copyright", "&ampamp;", "&AMP", "&Aacute;", ";", "&#0000065;", "&#x000041;", "&#129;", "&#xfdd0;", "&#x1ffff;"]
    texts = parts + ["".join(rng.choices(parts, k=5)) for _ in range(600)]
    assert changed(spark, texts, unicode.unescaped) == [html.unescape(t) for t in texts]
    assert changed(spark, ["", None, "Arauco&rsquo;s Sucuri&uacute;"], unicode.unescaped) == ["", None, "Arauco’s Sucuriú"]


def test_nfkd_of_many_letters_takes_no_expression_for_each(spark):
    """A letter that has a decomposition once took 15 microseconds and more, in interpreted lambdas."""
    plan = spark.range(1).select(unicode.nfkd_lower(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan
    texts = ["𝐀𝟘 \U0001d15e ｋ１é", "ａ" * 5000 + "ẹ́"]
    assert changed(spark, texts, unicode.nfkd) == [unicodedata.normalize("NFKD", t) for t in texts]


def test_references_of_whole_texts(spark):
    texts = ["", None, "plain", "Arauco&rsquo;s Sucuri&uacute", "&notit; &#150; &#0; &#x1F642; &amp;lt;", "&#32;the&#x20;" * 5000]
    assert changed(spark, texts, unicode.read_references) == [t if t is None else html.unescape(t) for t in texts]
    plan = spark.range(1).select(unicode.read_references(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan
