"""Compatibility decomposition in Arrow batches, and character references as column expressions.

Tables are made from Python's own Unicode data when an expression is built; in a plan they are literal arrays.
"""

from __future__ import annotations

import html
import html.entities
import json
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BETWEEN = "\x01"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _listed(values: list[str]) -> Column:
    """A literal array."""
    return F.split(F.lit(_BETWEEN.join(values)), _BETWEEN, -1)


def replaced(c: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with each match of a pattern changed."""
    found = bound(c, lambda t: F.struct(F.split(t, pattern, -1).alias("text"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("match")))
    return bound(found, lambda s: F.array_join(F.zip_with(s["text"], s["match"], lambda t, m: F.concat(t, F.coalesce(change(m), F.lit("")))), ""))


def nfkd(c: Column) -> Column:
    """NFKD: compatibility decomposition, marks in canonical order. Texts go through Arrow, so not for use inside lambdas."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else unicodedata.normalize("NFKD", t) for t in texts], dtype="object")

    return run(c)


def nfkd_lower(c: Column) -> Column:
    return F.lower(nfkd(c))


# What numeric references to the control characters of Windows-1252 stand for.
_WINDOWS = {i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)}


def _character(code: Column) -> Column:
    """The character of a numeric reference."""
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    windows = F.get(_listed(list(_WINDOWS.values())), (code - 0x80).cast("int"))
    nothing = code.between(1, 8) | code.between(0xE, 0x1F) | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF) | (code == 0xB) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when(code.between(0x80, 0x9F), windows).when(code == 0xD, "\r").when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "�").when(nothing, "").otherwise(char)
    )


def read_references(c: Column) -> Column:
    """`unescaped` of whole columns, in Arrow batches; not for use inside lambdas."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else html.unescape(t) for t in texts], dtype="object")

    return run(c)


def unescaped(c: Column) -> Column:
    """Character references as what they stand for: named with or without a semicolon, decimal and hexadecimal.

    A name that is none is read as the longest one that it begins with, if that may stand without a semicolon. Texts without
    references stay as they are; a reference is read once, so what it makes is not read again.
    """
    names = F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")
    bare = [n for n in html.entities.html5 if not n.endswith(";")]
    longest = max(map(len, bare))
    pattern = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"

    def read(m: Column) -> Column:
        body = F.substring(m, 2, 40)
        digits = F.regexp_replace(F.substring(m, 3, 1 << 20), ";$", "")
        # More figures than any code point has stand for a number that is too large.
        long_ = F.lit(0x110000).cast("long")
        decimal = F.regexp_replace(digits, "^0+(?=.)", "")
        hexa = F.regexp_replace(F.substring(digits, 2, 1 << 20), "^0+(?=.)", "")
        number = F.when(body.rlike("^#[xX]"), F.when(F.length(hexa) > 8, long_).otherwise(F.conv(hexa, 16, 10).cast("long"))).otherwise(F.when(F.length(decimal) > 9, long_).otherwise(decimal.cast("long")))
        prefixes = F.filter(F.transform(F.sequence(F.lit(longest), F.lit(2), F.lit(-1)), lambda n: F.substr(body, F.lit(1), n)), lambda p: (F.length(p) < F.length(body)) & F.element_at(names, p).isNotNull())
        prefix = F.get(prefixes, F.lit(0))
        named = F.coalesce(F.element_at(names, body), F.concat(F.element_at(names, prefix), F.substr(body, F.length(prefix) + 1)), m)
        return F.when(body.startswith("#"), _character(number)).otherwise(named)

    return F.when(c.contains("&"), replaced(c, pattern, read)).otherwise(c)
