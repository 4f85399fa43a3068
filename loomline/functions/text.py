"""Column functions on text. Patterns are Unicode-aware; rule tables are parameters."""

from __future__ import annotations

import unicodedata

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(c: Column) -> Column:
    """Lower case without accents; what is neither a letter, digit nor hyphen becomes one space."""
    s = unmarked(c)
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}_\s-]", " "), r"\s+", " "))


def alternation(words: list[str]) -> str:
    """Longest first, so that the longest keyword is the one reported."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def whole_words(words: list[str]) -> str:
    return rf"(?iU)(?<![\p{{L}}\p{{N}}_])(?:{alternation(words)})(?![\p{{L}}\p{{N}}_])"


def matches(c: Column, words: list[str]) -> Column:
    """The words that the text holds as whole words, lower case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(whole_words(words)), F.lit(0)), F.lower)))


def tokens(c: Column, stop: list[str], longer_than: int = 2) -> Column:
    """Distinct lower-case words of more letters than given, stop words left out."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > longer_than) & ~w.isin(stop)))


def tagged(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of the patterns (label, pattern) that the text matches, in rule order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(label)) for label, p in rules])))


def page_index(title: Column) -> Column:
    """Titles of index pages: under 15 characters, fewer than two spaces, or of the form "Page n" or "A-Z"."""
    spaces = F.length(title) - F.length(F.replace(title, F.lit(" "), F.lit("")))
    return (F.length(title) < 15) | (spaces < 2) | title.rlike(r"(?i)^(page \d+|[a-z] ?- ?[a-z])$")


def without_tags(html: Column) -> Column:
    """Text of html: scripts and styles go with their contents, tags become spaces, spaces are drawn together."""
    s = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def snippet(c: Column, most: int = 200) -> Column:
    """Tags to spaces, spaces drawn together, cut, trailing space off, empty to null."""
    s = F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))
    return F.nullif(F.rtrim(F.substring(s, 1, most)), F.lit(""))


def slug_title(url: Column) -> Column:
    """A title from the last part of a url's path: no ending, dashes to spaces, first letter upper case."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    last = F.regexp_replace(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[a-z]+$", ""), r"-?\d{4}-\d{2}-\d{2}$", "")
    words = F.trim(F.regexp_replace(last, r"[-_]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)), r"^www\.", "")


def without_parameters(url: Column, drop: str) -> Column:
    """The url without query parameters whose name matches; all else is kept as it is."""
    base, mark, rest = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(rest, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{drop})=")), "&")
    return F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), mark)


def url_reject(url: Column, blocked: list[str]) -> Column:
    """The first reason against a url, or null: empty, long, character, scheme, host, credential, internal, parameter, blocked."""
    host = domain(url)
    return (
        F.when(url.isNull() | (url == ""), "empty")
        .when(F.length(url) > 2000, "long")
        .when(url.rlike(r"[\s<>\"\\]"), "character")
        .when(~url.rlike(r"^https?://"), "scheme")
        .when(host == "", "host")
        .when(url.rlike(r"^https?://[^/]*@"), "credential")
        .when(host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.)"), "internal")
        .when(url.rlike(r"(?i)[?&](token|sig|signature|key|apikey|password|secret)="), "parameter")
        .when(F.array_contains(F.array(*[F.lit(b) for b in blocked]), host), "blocked")
    )


def masked(c: Column) -> Column:
    """E-mail addresses, then telephone numbers in groups of digits, replaced by fixed marks."""
    s = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[email]")
    return F.regexp_replace(s, r"\+?[0-9]{1,3}[ -]\(?[0-9]{2,4}\)?[ -][0-9]{3,5}[ -][0-9]{3,5}", "[phone]")


def short_id(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 12)


def numbers(c: Column) -> Column:
    """Numbers of a text in order, without those inside words."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(c, r"[A-Za-z_]+[0-9]+\w*|[0-9]+[A-Za-z_]\w*", " "), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))


# Well-formed UTF-8 of more than one byte, each byte read as a Latin-1 character.
MISREAD = "[Â-ß][\u0080-¿]|à[ -¿][\u0080-¿]|[á-ìîï][\u0080-¿]{2}|í[\u0080-\u009f][\u0080-¿]|ð[\u0090-¿][\u0080-¿]{2}|[ñ-ó][\u0080-¿]{3}|ô[\u0080-\u008f][\u0080-¿]{2}"


def repaired(c: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; all other characters stay."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(MISREAD), F.lit(0)), lambda r: F.decode(F.encode(r, "ISO-8859-1"), "UTF-8"))
    return F.array_join(F.zip_with(F.split(c, MISREAD), runs, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")


def kept_clauses(c: Column, causal: list[str], contrast: list[str]) -> Column:
    """Lower-case clauses between sentence ends and words of contrast, each up to a causal word; empty ones go."""
    parts = F.split(F.lower(c), rf" (?:{'|'.join(contrast)}) |[.;!?]+\s*")
    cut = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, rf"(?s)(^| )({'|'.join(causal)})( .*)?$", "")))
    return F.filter(cut, lambda p: p != "")


def without_related(c: Column, label: str) -> Column:
    """Lines before the first one that is a label of related links; the text as it is if over half of it would go."""
    lines = F.split(c, "\n")
    at = F.array_position(F.transform(lines, lambda x: F.trim(x).rlike(label)), True)
    head = F.array_join(F.slice(lines, 1, F.greatest(at - 1, F.lit(0)).cast("int")), "\n")
    return F.when((at > 0) & (F.length(head) * 2 >= F.length(c)), head).otherwise(c)


def sections(c: Column, least: int = 3, longest_head: int = 60) -> Column:
    """Heads of the blocks (between blank lines) of two lines or more whose first is short and no sentence; fewer than `least`: none."""
    blocks = F.transform(F.split(c, r"\n[ \t]*\n"), lambda b: F.split(F.trim(b), "\n"))
    heads = F.transform(F.filter(blocks, lambda b: (F.size(b) >= 2) & (F.length(F.get(b, 0)) <= longest_head) & ~F.get(b, 0).endswith(".")), lambda b: F.get(b, 0))
    return F.when(F.size(heads) >= least, heads).otherwise(F.array().cast("array<string>"))


def labelled_row(line: Column) -> Column:
    """sector, headline, source and take of "SECTOR - headline [source] (take)"; any dash will do. Null for other lines."""
    form = r"^\s*([^-–—]+?)\s*[-–—]\s*(.+?)\s*\[([^\]]*)\]\s*\(([+=-])\)\s*$"
    parts = [F.regexp_extract(line, form, i).alias(n) for i, n in enumerate(("sector", "headline", "source", "take"), 1)]
    return F.when(line.rlike(form), F.struct(*parts))


def source_label(domain_: Column, aliases: dict[str, str]) -> Column:
    """The alias of a domain, else its first label with a capital; a dash for none."""
    named = F.coalesce(*[F.when(domain_ == k, F.lit(v)) for k, v in aliases.items()], F.initcap(F.substring_index(domain_, ".", 1)))
    return F.when(F.coalesce(domain_, F.lit("")) == "", "—").otherwise(named)


def free_text(c: Column, blocked: list[str]) -> Column:
    """Contacts masked outside urls; urls that url_reject lets pass stay as they are, others become [link]."""
    url = r"https?://[^\s<>\"]+"
    urls = F.regexp_extract_all(c, F.lit(url), F.lit(0))
    checked = lambda u: F.when(u.isNull(), "").when(url_reject(u, blocked).isNull(), u).otherwise("[link]")
    return F.array_join(F.transform(F.split(c, url), lambda part, i: F.concat(masked(part), checked(F.get(urls, i)))), "")


def resolved(raw: Column, declared: Column) -> Column:
    """Bytes as text: by the declared charset if it is Latin-1, else as UTF-8 where they are valid, else as Latin-1."""
    latin = F.decode(raw, "ISO-8859-1")
    return F.when(F.lower(declared).isin("iso-8859-1", "latin-1"), latin).otherwise(F.coalesce(F.try_validate_utf8(raw.cast("string")), latin))


# Letters that stand for a plain letter and a mark, by rule: every code point below 0x250 or in 0x1E00 to 0x1EFF whose
# decomposition begins with an ASCII letter.
_MARKED = [(chr(i), d[0]) for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if (d := unicodedata.normalize("NFD", chr(i))) != chr(i) and d[0].isascii()]


def unmarked(c: Column) -> Column:
    """Lower case, letters without their marks, and no marks that stand alone."""
    plain = F.translate(c, "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))
    return F.lower(F.regexp_replace(plain, r"\p{M}+", ""))
