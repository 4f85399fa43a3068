"""JSON objects of model answers, and rich text as segments."""

import json
import random

from pyspark.sql import functions as F

from loomline.functions import folds


THOUGHTS = '<think>They want {"items": ["...", "..."]}.</think>'
ANSWERS = [
    ('{"items": ["a"]}', ["a"]),
    (THOUGHTS + ' {"items": ["Ore {62%} rises", "b \\"quoted\\" }"]}', ["Ore {62%} rises", 'b "quoted" }']),
    ('Here:\n```json\n{"items": ["a", "b"], "more": {"deep": {"x": [1, {"y": "}"}]}}}\n```\nDone.', ["a", "b"]),
    ('Answer:\n```\n{"items": ["y"]}\n```', ["y"]),
    ('Draft {"items": ["one"]} and then {"items": ["two", "three"]}', ["two", "three"]),
    ('{"items": ["a"]} and {"note": "nothing"}', ["a"]),
    ('{"note": {"items": ["inner"]}}', None),
    ('5" of {see "this} then {"items": ["a"]}', ["a"]),
    (THOUGHTS + " {broken", None),
    ('<think>{"items": ["a"]}</think>', None),
    ('{"items": "one\\ntwo\\n\\nthree"}', ["one", "two", "three"]),
    ('{"items": ["a", 5, " ", {"b": 1}, null, "c"]}', ["a", "c"]),
    ('{"items": ["a",}', None),
    ('{{{{', None), ("</think>", None), ("", None), ("   ", None), ("no object", None), (None, None),
]


def folded(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    return [r.x for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_answers(spark):
    got = folded(spark, [t for t, _ in ANSWERS], lambda t: folds.answer_texts(t, "items"))
    assert [(t, g) for (t, _), g in zip(ANSWERS, got, strict=True)] == ANSWERS


def test_nested_answers_survive(spark):
    """Any object comes back whole from prose with braces and quotation marks around it."""
    rng = random.Random(8)

    def value(depth):
        kind = rng.randint(0, 5 if depth else 2)
        if kind < 3:
            return ["".join(rng.choice('a{}[]",:\\ é\n') for _ in range(rng.randint(0, 8))), rng.randint(-5, 5), None][kind]
        return [value(depth - 1) for _ in range(rng.randint(0, 3))] if kind == 3 else {f"k{i}": value(depth - 1) for i in range(rng.randint(0, 3))}

    wanted = [{"key": value(3), "other": value(3)} for _ in range(150)]
    texts = [rng.choice(["", "So: ", '<think>{"key": 1}</think> ', 'First {"a": {"b": "}"}} ', "``` not"]) + json.dumps(w, ensure_ascii=rng.random() < 0.5) + rng.choice(["", " done.", ' {"x": {}}', "\n```"]) for w in wanted]
    got = folded(spark, texts, lambda t: folds.answer_object(t, "key"))
    assert [json.loads(g) for g in got] == wanted


def test_answer_by_schema(spark):
    text = 'x {"take": "+", "parts": [{"name": "a", "w": {"lo": 0.5}}], "confidence": 0.9} y'
    got = folded(spark, [text], lambda t: folds.answer(t, "take STRING, confidence DOUBLE, parts ARRAY<STRUCT<name: STRING, w: STRUCT<lo: DOUBLE>>>", "take"))[0]
    assert (got.take, got.confidence, got.parts[0].name, got.parts[0].w.lo) == ("+", 0.9, "a", 0.5)


def shown(segs):
    """line, text, marks (b, i, u), colour, link."""
    return [(s.line, s.text, "".join(m for m, on in (("b", s.bold), ("i", s.italic), ("u", s.underline)) if on), s.color, s.url) for s in segs]


RICH = [
    ("plain", [(0, "plain", "", None, None)]),
    ("<b>a<i>b</i></b>c", [(0, "a", "b", None, None), (0, "b", "bi", None, None), (0, "c", "", None, None)]),
    ("<b>a<i>b</b>c</i>d", [(0, "a", "b", None, None), (0, "b", "bi", None, None), (0, "c", "i", None, None), (0, "d", "", None, None)]),
    ("<b>never closed <u>here", [(0, "never closed ", "b", None, None), (0, "here", "bu", None, None)]),
    ("a</b></i>c", [(0, "a", "", None, None), (0, "c", "", None, None)]),
    ("<b><b>x</b>y</b>z", [(0, "x", "b", None, None), (0, "y", "b", None, None), (0, "z", "", None, None)]),
    ("&lt;b&gt; is &amp;lt; &eacute;", [(0, "<b> is &lt; é", "", None, None)]),
    ('<a href="https://x.org/?a=1&amp;b=2" style="background-color:#fff;color: #ABC">go</a>', [(0, "go", "", "#aabbcc", "https://x.org/?a=1&b=2")]),
    ("<a href=\"javascript:alert(1)\">no</a> <font color='rgb(255, 0, 10)'>red</font>", [(0, "no", "", None, None), (0, " ", "", None, None), (0, "red", "", "#ff000a", None)]),
    ("<p>one</p><p>two<br><br>three</p> <div><div>four</div></div>", [(0, "one", "", None, None), (1, "two", "", None, None), (3, "three", "", None, None), (4, "four", "", None, None)]),
    ("<style>p {}</style>a<!-- <b> -->b < c", [(0, "a", "", None, None), (0, "b ", "", None, None), (0, "<", "", None, None), (0, " c", "", None, None)]),
    ('<i title="a > b">x</i>', [(0, "x", "i", None, None)]),
    ("", []),
]


def test_segments(spark):
    got = folded(spark, [t for t, _ in RICH] + [None, "<b>x</b>y" * 300], folds.segments)
    assert [(t, shown(g)) for (t, _), g in zip(RICH, got, strict=False)] == RICH
    assert got[-2] is None and len(got[-1]) == 600


def test_marked_segments(spark):
    text = "a **b [c](x)** d\n[site](https://x.org) and \\*\\*kept\\*\\* [bad](javascript:x) **open"
    got = shown(folded(spark, [text], folds.marked_segments)[0])
    assert got[:3] == [(0, "a ", "", None, None), (0, "b [c](x)", "b", None, None), (0, " d", "", None, None)]
    assert got[3] == (1, "site", "", None, "https://x.org") and "".join(s[1] for s in got[4:]) == " and **kept** bad **open" and not any(s[2] for s in got[4:])
