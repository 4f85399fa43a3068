"""Main text of pages by their host's template of nested equivalence classes (operator 10).

A page is a sequence of tokens: an element's start and end at its path (tags with class and id), and a text block at
its path. Tokens of a host that occur equally often on every page have equal occurrence vectors and make an equivalence
class. A class is kept if it occurs on at least PAGES pages and SHARE of the host's pages, holds two tokens or more, an
element's among them, and is ordered: on every page its tokens come in one order, one round after another. Two classes
must nest: no round of one begins and ends in different slots of a round of the other, and all lie in the same slot (the gap between
two neighbouring tokens of the class). Of classes that do not, the one on more pages, then the larger, is kept. The
kept classes, one within another, are the template.

Reading a page along its template, what is matched in order is the template's; every other text block is the content of
a slot. Of the slots the article is taken: those in an <article> or <main> element if the page has text in one, else
those outside menus, headers, footers, sidebars, notices, adverts, forms and comments, which are known by their tags
and by the words of their class, id and role.

Pages of the same text outside menus, notices and the like are copies, and one of each host stands for them when the
template is deduced. A host with fewer than PAGES different pages has none. Where no heading of a host's pages differs and
the classes hold more than ALIKE of their different texts, block by block, the pages are near copies of one article, and
the template keeps its elements only: what copies share is no template. How long a shared text is, or how often a page
repeats it, does not count; where headings differ, all shared texts go, however many.

Templates go to every task while their size, counted first, is at most CONSTANTS; else they are joined by host, with the
same result. A template has no more tokens than two average pages.

Defined results: a null or empty html has an empty text; malformed markup is read as far as it goes; a null url has
the empty host; repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import discard, stash

#: Least pages of a class, and its least share of the host's pages.
PAGES, SHARE = 3, 0.5
#: Share of the different texts of pages with the same headings from which these are near copies.
ALIKE = 0.8
#: Template tokens of all hosts that may be sent to every task (24 bytes each).
CONSTANTS = 2_000_000

# A tag ends at ">" outside quotes; one that meets "<" first is text. Nothing is scanned twice.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\"<>]++)*+)>|([^<]++|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
CAMEL, NAMES = re.compile(r"([a-z])([A-Z])"), re.compile(r"[^a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
# Kinds of HTML elements, and words that mark parts outside the main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style head title noscript template iframe object embed svg math canvas nav footer aside form button select textarea menu dialog noembed noframes xmp audio video map datalist".split())
OUTSIDE = frozenset(
    "nav navbar navigation menu topbar header masthead footer sidebar aside ad ads adv advert advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice popup modal overlay "
    "subscribe subscription newsletter signup login share sharing social related recommended breadcrumb breadcrumbs pagination pager comment comments disqus replies reply respond form search widget toolbar skip hidden complementary contentinfo alert dialog".split()
)
#: Of these, the words that may name a part of the article itself while inside it.
INSIDE = frozenset("header banner notice alert overlay promo hidden".split())
ARTICLE = frozenset(["article", "main"])
#: Elements that end with the next of their kind.
ITEMS = frozenset(["li", "td", "th", "tr", "dt", "dd", "option"])
SPACE = re.compile(r"\s+")

#: token, whether it stands in none of the parts outside the main text, number of the article or main element around it
#: (from 1, or 0), the text of a text block, and whether it is a heading's.
Event = tuple[int, bool, int, str | None, bool]


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _hash(kind: str, path: int, text: str) -> int:
    """A token. The last bit is set for an element's start or end."""
    h = xxh64_intdigest(f"{kind}{path}\x00{text}".encode("utf-8", "surrogatepass"))
    return signed(h & ~1 | (kind != "t"))


def events(html: str | None) -> list[Event]:
    """The tokens of a page in order. Paths are running hashes, so that depth costs nothing."""
    out: list[Event] = []
    stack: list[tuple[str, int, bool, int]] = []  # tag, path, kept, article
    open_: Counter = Counter()
    text: list[str] = []
    articles, at, size = 0, 0, len(html or "")
    path, kept, article, heads = 0, True, 0, 0

    def flush() -> None:
        if text:
            whole = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if whole:
                out.append((_hash("t", path, whole), kept, article, whole, heads > 0))

    def close(i: int) -> None:
        """Ends the elements from place i of the stack on."""
        nonlocal path, kept, article, heads
        for tag, p, k, a in reversed(stack[i:]):
            open_[tag] -= 1
            heads -= tag in HEADINGS
            if tag in BLOCKS:
                out.append((_hash("c", p, ""), k, a, None, False))
        del stack[i:]
        path, kept, article = stack[-1][1:] if stack else (0, True, 0)

    while at < size:
        m = MARKUP.match(html, at)
        if not m:  # a "<" that opens nothing
            text.append(html[at])
            at += 1
            continue
        at = m.end()
        if m[4] is not None:
            text.append(m[4])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if open_[tag]:
                if tag not in BLOCKS:
                    flush()
                close(max(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag) if stack[-1][0] != tag else len(stack) - 1)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS or tag in RAW:
            flush()
        if tag in VOID:
            continue
        if tag in BLOCKS and (open_["p"] or tag in ITEMS and open_[tag]):  # it ends an open paragraph, and an item the one before it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] == tag and tag in ITEMS:
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        named: set[str] = set()
        off = False
        for a in ATTRIBUTE.finditer(m[3]) if m[3] else ():
            key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if key in ("class", "id", "role"):
                named.update(NAMES.split(CAMEL.sub(r"\1-\2", value).lower()))
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value.lower()):
                off = True
        named.discard("")
        inside = article > 0 or tag in ARTICLE
        bad = tag in SKIPPED or off or bool((OUTSIDE - INSIDE if inside else OUTSIDE) & named) or tag == "header" and not article
        if tag in ("html", "body"):
            bad = False
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        starts = tag in BLOCKS
        if not starts and (not bad and not (tag in ARTICLE) or m[3].endswith("/")):
            continue  # an inline element that changes nothing
        if not starts:
            flush()
        own = (tag in ARTICLE or starts and tag in ("div", "section") and bool({"main", "article"} & named)) and not bad and kept and not article
        articles += own
        article = articles if own else article
        kept = kept and not bad
        path = xxh64_intdigest(f"{path}/{tag}.{'.'.join(sorted(named))}")
        stack.append((tag, path, kept, article))
        open_[tag] += 1
        heads += tag in HEADINGS
        if starts:
            out.append((_hash("o", path, ""), kept, article, None, False))
    flush()
    close(0)
    return out


def content(found: list[Event], headings: bool = False) -> int:
    """A digest of a page's text outside menus, notices and the like, or of its headings there: equal for copies."""
    texts = [t for _, kept, _, t, head in found if head and kept] if headings else [t for _, kept, _, t, _ in found if kept and t is not None]
    return signed(xxh64_intdigest("\x00".join(texts).encode("utf-8", "surrogatepass")))


def firsts(found: list[Event]) -> list[int]:
    """1 for the first of each text outside menus and the like, else 0."""
    out = [0] * len(found)
    first: dict[int, int] = {}
    for i, (token, kept, _, t, _) in enumerate(found):
        if kept and t is not None:
            first.setdefault(token, i)
    for i in first.values():
        out[i] = 1
    return out


def host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def sequences(pages: DataFrame) -> DataFrame:
    """host, page, tokens (in order), sizes (see firsts) and head (a digest of headings) of a host's pages.

    Of copies the page of the least tokens.
    """

    @F.pandas_udf("page long, tokens array<long>, sizes array<int>, head long")
    def run(htmls: pd.Series) -> pd.DataFrame:
        found = [events(h) for h in htmls]
        return pd.DataFrame({"page": [content(f) for f in found], "tokens": [[e[0] for e in f] for f in found], "sizes": [firsts(f) for f in found], "head": [content(f, True) for f in found]})

    rows = pages.select(host("url").alias("host"), run("html").alias("r")).select("host", "r.*").where(F.size("tokens") > 0)
    return rows.groupBy("host", "page").agg(F.min(F.struct("tokens", "sizes", "head")).alias("r")).select("host", "page", "r.*")


def classes(pages: DataFrame) -> DataFrame:
    """The equivalence classes of sequences(): host, class (its occurrence vector's digest), support (pages), tokens,
    weight (its different texts, page by page) and whole (those of the host's pages, or 0 if headings differ)."""
    flat = pages.select("host", "page", F.explode(F.arrays_zip("tokens", "sizes")).alias("x")).select("host", "page", F.col("x.tokens").alias("token"), "x.sizes")
    times = flat.groupBy("host", "page", "token").agg(F.count("*").alias("n"), F.sum("sizes").alias("size"))
    vectors = times.groupBy("host", "token").agg(F.bit_xor(F.xxhash64("page", "n")).alias("class"), F.count("*").alias("support"), F.sum("size").alias("size"))
    total = pages.groupBy("host").agg(F.count("*").alias("total"), F.when(F.min("head") == F.max("head"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).otherwise(0).alias("whole"))
    frequent = vectors.where(F.col("support") >= PAGES).join(total, "host").where(F.col("support") >= SHARE * F.col("total"))
    found = frequent.groupBy("host", "class", "support", "whole").agg(F.collect_list("token").alias("tokens"), F.sum("size").alias("weight"), F.max(F.col("token").bitwiseAND(F.lit(1))).alias("markup"))
    return found.where((F.size("tokens") > 1) & (F.col("markup") == 1)).drop("markup")


def rounds(tokens: list[int], of: dict[int, int], sizes: dict[int, int]) -> tuple[dict[int, list[int] | None], set[tuple[int, int, int]]]:
    """Of a page: each class's order (none if it is not ordered here), and (inner, outer, slot) of its ordered classes.

    A slot of -1: the classes cross.
    """
    seen: dict[int, list[int]] = defaultdict(list)
    for t in tokens:
        if t in of:
            seen[of[t]].append(t)
    order: dict[int, list[int] | None] = {}
    for c, found in seen.items():
        base = found[: sizes[c]]
        order[c] = base if len(set(base)) == sizes[c] and found == base * (len(found) // len(base)) else None
    place = {t: i for base in order.values() if base for i, t in enumerate(base)}
    nested: set[tuple[int, int, int]] = set()
    open_: list[list[int]] = []  # class and slot of the rounds that are open
    for t in tokens:
        c, i = of.get(t), place.get(t)
        if i is None:
            continue
        if i == 0:
            nested.update((c, d, slot) for d, slot in open_)
            open_.append([c, 0])
            continue
        at = max(k for k in range(len(open_)) if open_[k][0] == c)
        nested.update((d, c, -1) for d, _ in open_[at + 1 :])
        open_[at][1] = i
        if i == sizes[c] - 1:
            del open_[at]
    return order, nested


ROUNDS = "orders array<struct<class:long,tokens:array<long>>>, nested array<struct<inner:long,outer:long,slot:int>>"
TEMPLATE = "tokens array<long>, class array<int>, place array<int>, size array<int>"


def _rounds(tokens: pd.Series, names: pd.Series, members: pd.Series) -> pd.DataFrame:
    rows = []
    for seq, cs, ms in zip(tokens, names, members, strict=True):
        of = {int(t): int(c) for c, m in zip(cs, ms, strict=True) for t in m}
        order, nested = rounds([int(t) for t in seq], of, {int(c): len(m) for c, m in zip(cs, ms, strict=True)})
        rows.append(([{"class": c, "tokens": b} for c, b in order.items()], [{"inner": a, "outer": b, "slot": s} for a, b, s in sorted(nested)]))
    return pd.DataFrame(rows, columns=["orders", "nested"])


def agreed(candidates: list[tuple[int, int, list[int], int]], apart: set[tuple[int, int]], whole: int) -> list[list[int]]:
    """The orders of classes (class, support, order, weight) that nest with all before them: more pages first, then the larger."""
    kept: list[tuple[int, list[int], int]] = []
    for c, _, order, weight in sorted(candidates, key=lambda x: (-x[1], -len(x[2]), x[0])):
        if not any((c, d) in apart or (d, c) in apart for d, *_ in kept):
            kept.append((c, order, weight))
    if whole and sum(w for *_, w in kept) > ALIKE * whole:
        return [[t for t in order if t & 1] for _, order, _ in kept]
    return [order for _, order, _ in kept]


def _agreed(ordered: pd.Series, apart: pd.Series, whole: pd.Series) -> pd.DataFrame:
    rows = []
    for cs, pairs, all_ in zip(ordered, apart, whole, strict=True):
        candidates = [(int(c["class"]), int(c["support"]), [int(t) for t in c["tokens"]], int(c["weight"])) for c in cs]
        found = agreed(candidates, {(int(p["inner"]), int(p["outer"])) for p in (pairs if pairs is not None else [])}, int(all_))
        flat = [(t, k, i, len(order)) for k, order in enumerate(found) for i, t in enumerate(order)]
        rows.append([list(x) for x in zip(*flat, strict=True)] if flat else [[], [], [], []])
    return pd.DataFrame(rows, columns=["tokens", "class", "place", "size"])


def templates(pages: DataFrame) -> DataFrame:
    """host and its template: of each token its class, its place in it and the class's size."""
    spark = pages.sparkSession
    check, agree = F.pandas_udf(_rounds, ROUNDS), F.pandas_udf(_agreed, TEMPLATE)
    reps, path = stash(sequences(pages), spark)
    found, other = stash(classes(reps), spark)
    hosts = found.groupBy("host").agg(F.collect_list(F.struct("class", "tokens")).alias("cs"))
    checked, third = stash(reps.join(hosts, "host").select("host", check("tokens", F.col("cs.class"), F.col("cs.tokens")).alias("r")).select("host", "r.*"), spark)
    orders = checked.select("host", F.explode("orders").alias("o")).select("host", "o.*").groupBy("host", "class")
    orders = orders.agg(F.min("tokens").alias("tokens"), F.max("tokens").alias("other"), F.count("*").alias("n"), F.count("tokens").alias("ordered")).where("n = ordered AND tokens = other")
    ordered = orders.select("host", "class", "tokens").join(found.drop("tokens"), ["host", "class"])
    ordered = ordered.groupBy("host", "whole").agg(F.collect_list(F.struct("class", "support", "tokens", "weight")).alias("ordered"))
    nested = checked.select("host", F.explode("nested").alias("x")).select("host", "x.*").groupBy("host", "inner", "outer").agg(F.min("slot").alias("a"), F.max("slot").alias("b")).where("a < 0 OR a <> b")
    apart = nested.groupBy("host").agg(F.collect_list(F.struct("inner", "outer")).alias("apart"))
    out, _ = stash(ordered.join(apart, "host", "left").select("host", agree("ordered", "apart", "whole").alias("t")).select("host", "t.*"), spark)
    for p in (path, other, third):
        discard(spark, p)
    return out


Template = dict[int, tuple[int, int, int]]


def slots(found: list[Event], template: Template) -> list[tuple[tuple[int, int], Event]]:
    """The text blocks that are not the template's, each with its slot: class and place, (-1, 0) outside all rounds."""
    out: list[tuple[tuple[int, int], Event]] = []
    open_: list[list[int]] = []
    for e in found:
        got = template.get(e[0])
        if got:
            c, i, size = got
            at = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == c), -1)
            if i == 0:
                if at >= 0:  # a round that was left off
                    del open_[at:]
                open_.append([c, 0])
                continue
            if at >= 0 and open_[at][1] == i - 1:
                del open_[at + 1 :]
                open_[at][1] = i
                if i == size - 1:
                    del open_[at]
                continue
        if e[3] is not None:
            out.append(((open_[-1][0], open_[-1][1]) if open_ else (-1, 0), e))
    return out


def main_text(html: str | None, template: Template | None = None) -> str:
    """The article of a page: the contents of its slots, joined by two line feeds."""
    found = [e for _, e in slots(events(html), template or {}) if e[1]]
    return "\n\n".join(e[3] for e in found if e[2]) or "\n\n".join(e[3] for e in found)


SLOTS = "text string, n_chars long"


def _texts(rows: Iterator[tuple[str | None, Template]]) -> pd.DataFrame:
    out = [main_text(h, t) for h, t in rows]
    return pd.DataFrame({"text": out, "n_chars": [len(t) for t in out]})


def as_template(tokens, class_, place, size) -> Template:
    if not isinstance(tokens, (list, np.ndarray)):
        return {}
    return {int(t): (int(c), int(i), int(n)) for t, c, i, n in zip(tokens, class_, place, size, strict=True)}


def extract(pages: DataFrame, most: int = CONSTANTS) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    rows = pages.select("page_id", "url", "html")
    spark = pages.sparkSession
    found = templates(rows)
    if (found.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= most:
        sent = spark.sparkContext.broadcast({r.host: as_template(r.tokens, r["class"], r.place, r.size) for r in found.collect()})

        @F.pandas_udf(SLOTS)
        def run(htmls: pd.Series, hosts: pd.Series) -> pd.DataFrame:
            return _texts((h, sent.value.get(k, {})) for h, k in zip(htmls, hosts, strict=True))

        return rows.select("page_id", "url", run("html", host("url")).alias("r")).select("page_id", "url", "r.*")

    @F.pandas_udf(SLOTS)
    def joined(htmls: pd.Series, *template: pd.Series) -> pd.DataFrame:
        return _texts((h, as_template(*t)) for h, *t in zip(htmls, *template, strict=True))

    placed = rows.withColumn("host_", host("url"))
    both = placed.join(found, placed.host_ == found.host, "left")
    return both.select("page_id", "url", joined("html", "tokens", "class", "place", "size").alias("r")).select("page_id", "url", "r.*")
