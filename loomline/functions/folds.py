"""Small machines as folds over a text's tokens: JSON objects inside free text, and rich text as segments.

A fold is one `aggregate` over the tokens of a row; its state is a struct. Nothing leaves the row, so no shuffle is made and
no Python is run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.unicode import bound, unescaped


def objects(c: Column, strings: bool = True) -> Column:
    """The outermost {...} of a text in order. Braces inside a string of an object count only if strings is off."""
    tokens = F.regexp_extract_all(c, F.lit(r'(?s)\\.|[{}"]|[^\\{}"]++|\\'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit("").alias("now"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        depth, quoted, now = s["depth"], s["quoted"], F.concat(s["now"], t)
        closes = (t == "}") & ~quoted & (depth == 1)
        inside = depth + F.when(quoted, 0).when(t == "{", 1).when(t == "}", -1).otherwise(0)
        flips = F.lit(strings) & (t == '"')
        opened = F.struct(inside.alias("depth"), (quoted != flips).alias("quoted"), F.when(closes, "").otherwise(now).alias("now"), F.when(closes, F.array_append(s["found"], now)).otherwise(s["found"]).alias("found"))
        outside = F.struct(F.when(t == "{", 1).otherwise(0).alias("depth"), F.lit(False).alias("quoted"), F.when(t == "{", t).otherwise("").alias("now"), s["found"].alias("found"))
        return F.when(depth > 0, opened).otherwise(outside)

    return F.when(c.contains("{"), F.aggregate(tokens, start, step, lambda s: s["found"])).otherwise(F.array().cast("array<string>"))


def answer_object(c: Column, key: str) -> Column:
    """The JSON object with a key that a model's answer gives, as text; null if there is none.

    Of an answer with thoughts only what follows the last </think> counts. A fenced object comes first, then the last
    object outside of others that is valid and has the key; nested objects are part of it. If quotation marks of the text
    around hide all objects, braces alone are matched.
    """

    def valid(o: Column) -> Column:
        return F.coalesce(F.array_contains(F.json_object_keys(o), key) & F.try_parse_json(o).isNotNull(), F.lit(False))

    def chosen(t: Column) -> Column:
        fenced = F.trim(F.regexp_extract(t, r"(?s)```(?i:json)?(.*?)(?:```|\z)", 1))
        found = bound(F.filter(objects(t), valid), lambda o: F.when(F.array_contains(o, fenced), fenced).otherwise(F.element_at(F.nullif(o, F.array().cast("array<string>")), -1)))
        return F.coalesce(found, F.element_at(F.nullif(F.filter(objects(t, strings=False), valid), F.array().cast("array<string>")), -1))

    return bound(F.substring_index(c, "</think>", -1), chosen)


def answer(c: Column, schema: str, key: str) -> Column:
    """A model's answer by schema, nested parts too."""
    return F.from_json(answer_object(c, key), schema)


def answer_texts(c: Column, key: str) -> Column:
    """The texts that an answer lists under a key: items that are texts and not blank; a text in place of a list, by line."""
    value = F.get_json_object(answer_object(c, key), f"$.{key}")
    item = r'(?s)"((?:[^"\\]|\\.)*)"'

    def listed(v: Column) -> Column:
        return F.filter(F.from_json(v, "array<string>"), lambda x: F.trim(x) != "")

    only_texts = value.rlike(rf'^\s*\[\s*(?:{item}\s*(?:,\s*{item}\s*)*)?\]\s*$')
    mixed = F.transform(F.variant_get(F.try_parse_json(value), "$", "array<variant>"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")))
    return F.when(only_texts, listed(value)).when(value.rlike(r"^\s*\["), F.filter(mixed, lambda x: F.trim(x) != "")).otherwise(F.filter(F.split(value, r"\r\n|[\n\r]"), lambda x: F.trim(x) != ""))


# Elements that begin a line, elements whose contents go, and elements that are never closed.
LINES = "address article blockquote center dd div dl dt figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split()
DROPPED = "script style head title template".split()
VOID = "area base br col embed hr img input link meta source track wbr".split()
MARK = "tag string, bold boolean, italic boolean, underline boolean, color string, url string"
SEGMENT = "line int, text string, bold boolean, italic boolean, underline boolean, color string, url string"


def safe_url(url: Column) -> Column:
    """A link that may be followed: http, https or mailto, else null."""
    trimmed = F.trim(url)
    return F.when(trimmed.rlike(r"(?i)^(?:https?://|mailto:)[^\s\"'<>]+$"), trimmed)


def color(value: Column) -> Column:
    """#rrggbb in small letters of a colour given by three or six hexadecimal figures or by rgb(); else null."""
    v = F.lower(F.trim(value))
    short, long_ = r"^#([0-9a-f])([0-9a-f])([0-9a-f])$", r"^#[0-9a-f]{6}$"
    rgb = r"^rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)$"
    parts = [F.regexp_extract(v, rgb, i).cast("int") for i in (1, 2, 3)]
    mixed = F.when(parts[0].between(0, 255) & parts[1].between(0, 255) & parts[2].between(0, 255), F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(p), 2, "0")) for p in parts]))
    return F.when(v.rlike(long_), v).when(v.rlike(short), F.regexp_replace(v, short, "#$1$1$2$2$3$3")).when(v.rlike(rgb), mixed)


def _attribute(token: Column, name: str) -> Column:
    form = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return unescaped(F.concat(*(F.regexp_extract(token, form, i) for i in (1, 2, 3))))


def segments(c: Column) -> Column:
    """Rich text as segments (SEGMENT), one for each stretch of text with the marks that hold there.

    Open elements are a stack, the latest first. An end tag closes the latest element of its kind, wherever it stands in the
    stack, so crossed marks end where they say; what is never closed holds to the end; an end tag without a start is
    nothing. The latest colour and link count. Lines begin at blocks, once they have text, and at <br>.
    """
    tokens = F.regexp_extract_all(c, F.lit(r"(?s)<!--.*?(?:-->|\z)|<[/a-zA-Z!?](?:\"[^\"]*\"|'[^']*'|[^'\">])*>|[^<]+|<"), F.lit(0))
    empty = F.array().cast(f"array<struct<{MARK.replace(' ', ':').replace(',:', ',')}>>")
    none = F.array().cast(f"array<struct<{SEGMENT.replace(' ', ':').replace(',:', ',')}>>")
    start = F.struct(empty.alias("open"), F.lit(0).alias("dropped"), F.lit(0).alias("breaks"), F.lit(0).alias("line"), F.lit(False).alias("filled"), none.alias("out"))

    def state(s: Column, **changes: Column) -> Column:
        return F.struct(*[changes.get(n, s[n]).alias(n) for n in ("open", "dropped", "breaks", "line", "filled", "out")])

    def begun(s: Column, t: Column, tag: Column) -> Column:
        style = F.regexp_extract(_attribute(t, "style"), r"(?i)(?:^|[;\s])color\s*:\s*([^;]+)", 1)
        link = F.when(tag == "a", safe_url(_attribute(t, "href")))
        mark = F.struct(tag.alias("tag"), tag.isin("b", "strong").alias("bold"), tag.isin("i", "em").alias("italic"), tag.isin("u", "ins").alias("underline"), F.coalesce(color(style), color(_attribute(t, "color"))).alias("color"), link.alias("url"))
        broken = F.when(tag == "br", s["breaks"] + 1).when(tag.isin(LINES) & s["filled"], F.greatest(s["breaks"], F.lit(1))).otherwise(s["breaks"])
        kept = F.when(tag.isin(VOID), s["open"]).otherwise(F.array_prepend(s["open"], mark))
        return F.when(tag.isin(DROPPED), state(s, dropped=s["dropped"] + 1)).otherwise(state(s, open=kept, breaks=broken))

    def ended(s: Column, tag: Column) -> Column:
        at = F.array_position(F.transform(s["open"], lambda m: m["tag"]), tag).cast("int")
        without = F.filter(s["open"], lambda m, i: i != at - 1)
        broken = F.when(tag.isin(LINES) & s["filled"], F.greatest(s["breaks"], F.lit(1))).otherwise(s["breaks"])
        return F.when(tag.isin(DROPPED), state(s, dropped=F.greatest(s["dropped"] - 1, F.lit(0)))).otherwise(state(s, open=without, breaks=broken))

    def written(s: Column, t: Column) -> Column:
        first = lambda name: F.get(F.filter(F.transform(s["open"], lambda m: m[name]), lambda x: x.isNotNull()), F.lit(0))
        holds = lambda name: F.exists(s["open"], lambda m: m[name])

        def add(text: Column) -> Column:
            line = s["line"] + s["breaks"]
            segment = F.struct(line.alias("line"), text.alias("text"), holds("bold").alias("bold"), holds("italic").alias("italic"), holds("underline").alias("underline"), first("color").alias("color"), first("url").alias("url"))
            loose = (F.trim(text) == "") & ~s["filled"]
            return F.when((text == "") | loose, s).otherwise(state(s, breaks=F.lit(0), line=line, filled=F.lit(True), out=F.array_append(s["out"], segment)))

        return F.when(s["dropped"] > 0, s).otherwise(bound(F.regexp_replace(unescaped(t), r"[ \t\r\n\f\x0B]+", " "), add))

    def step(s: Column, t: Column) -> Column:
        tag = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
        # After a break the line is new, and without text yet.
        fresh = state(s, filled=s["filled"] & (s["breaks"] == 0))
        return bound(fresh, lambda f: F.when(t.rlike("^</[a-zA-Z]"), ended(f, tag)).when(t.rlike("^<[a-zA-Z]"), begun(f, t, tag)).when(t.rlike("^<[!?/]"), f).otherwise(written(f, t)))

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def marked_segments(c: Column) -> Column:
    """Segments of the older notation: **bold** and [text](link), one line each; a backslash keeps a mark as it is."""
    token = r"(?s)\\([*\[\]\\])|\*\*((?:\\.|[^*\\]|\*(?!\*))+)\*\*|\[((?:\\.|[^\]\\])+)\]\(([^)\s]+)\)|[^\\*\[]+|[\\*\[]"
    plain = lambda x: F.regexp_replace(x, r"\\([*\[\]\\])", "$1")
    flag = F.lit(False)

    def segment(line: Column):
        def one(t: Column) -> Column:
            bold, link = t.rlike(r"(?s)^\*\*.+\*\*$"), t.rlike(r"(?s)^\[.+\]\([^)\s]+\)$")
            text = F.when(bold, F.regexp_replace(t, r"(?s)^\*\*(.*)\*\*$", "$1")).when(link, F.regexp_extract(t, token, 3)).otherwise(t)
            return F.struct(line.cast("int").alias("line"), plain(text).alias("text"), bold.alias("bold"), flag.alias("italic"), flag.alias("underline"), F.lit(None).cast("string").alias("color"), F.when(link, safe_url(F.regexp_extract(t, token, 4))).alias("url"))

        return one

    lines = F.split(c, r"\r\n|[\n\r]")
    return F.flatten(F.transform(lines, lambda line, i: F.transform(F.regexp_extract_all(line, F.lit(token), F.lit(0)), segment(i))))
