"""Contacts in free text replaced by marks.

A text is taken apart once, into runs of figures and what stands between them. Each run is then judged by itself: how many
figures it has and in groups of which lengths, its country and area code, the word before it, and whether the text ends
with it (a contact cut off). Mail addresses go first, by a pass of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL, PHONE = "[e-mail]", "[phone]"
# Area codes in use, words that announce a number, and words for an extension.
AREA = "(?:1[1-9]|2[12478]|3[1-578]|4[1-9]|5[1345]|6[1-9]|7[134579]|8[1-9]|9[1-9])"
WORDS = r"\b(?:tel(?:efones?|ephone|s)?|fones?|fax|cel(?:ular)?|phone|mobile|whats ?app)\b"
EXTENSION = r"(?:ramal|ramais|extens[ãa]o|ext\b\.?)"

#: Groups of figures with one mark between two of them.
GROUPS = r"[0-9]++(?:(?: ?[-/] ?|[ .])[0-9]++){0,12}+"
RUN = rf"(?:\+ ?[0-9]{{1,3}}[ .-]?|55[ .-]?)?\( ?[0-9xX]{{2,5}} ?\)(?:[ .-]?{GROUPS})?|(?:\+ ?)?{GROUPS}|[+(] ?[0-9]{{0,3}}\z"
_USER, _HOST = r"[\p{L}\p{N}_.%+-]++", r"[\p{L}\p{N}_-]++(?:\.[\p{L}\p{N}_-]++)*+"
MAIL = rf"(?i)(?<![\p{{L}}\p{{N}}_.%+-]){_USER}(?:@(?:{_HOST})?+(?:(?<=@)\z|(?<!@))| @ {_HOST}| ?[\[(](?:at|arroba)[\])] ?{_HOST})"
#: After a word for mail, what the end of the text leaves of an address.
MAIL_END = r"(?i)(\be-?mail ?: {0,3})[\p{L}\p{N}_.%+-]+\z"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _figures(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]+", "")


def _subscriber(c: Column) -> Column:
    """Eight figures from two up, or nine from a nine; no span of years."""
    return c.rlike("^(?:[2-9][0-9]{7}|9[0-9]{8})$") & ~c.rlike("^(?:(?:19|20)[0-9]{2}){2}$")


def _run(run: Column, before: Column, after: Column, then: Column) -> Column:
    """The run, or the mark in its place."""
    head = F.rtrim(F.substring_index(run, "/", 1))
    rest = F.substr(run, F.length(head) + 1)
    return bound(F.struct(head.alias("head"), rest.alias("rest"), _figures(head).alias("figures"), _figures(F.substring_index(head, ")", -1)).alias("own")), lambda x: _judged(run, x, before, after, then))


def _judged(run: Column, x: Column, before: Column, after: Column, then: Column) -> Column:
    head, figures = x["head"], x["figures"]
    # Without the country's code and the zero for long distance.
    national = F.regexp_replace(F.regexp_replace(figures, "^55(?=[0-9]{10,12}$)", ""), "^0(?=[0-9]{10,11}$)", "")
    sizes = F.array_join(F.transform(F.split(F.trim(F.regexp_replace(head, "[^0-9]+", " ")), " "), lambda g: F.length(g).cast("string")), ",")
    placed = F.substring(national, 1, 2).rlike(f"^{AREA}$") & _subscriber(F.substring(national, 3, 20))
    plus = head.startswith("+")
    bracket = head.rlike(r"\( ?(?:0(?:xx)?)?[1-9][0-9] ?\)")
    alone = ~before.rlike(r"[\p{L}\p{N}_.,/+]$") & ~after.rlike(r"^\p{L}") & (then.isNull() | ~after.isin("", ",", "."))
    named = before.rlike(rf"(?iU){WORDS}[.:]{{0,2}}\s{{0,3}}[:-]?\s{{0,2}}$")
    last = (after == "") & then.isNull()
    abroad = plus & ~head.rlike(r"^\+ ?[0-9]{1,3}(?:\.[0-9]{3})+$")  # an amount with marks of thousands is none
    country = figures.startswith("55") & sizes.rlike("^2,[23],[0-9]")
    phone = (
        (bracket & _subscriber(x["own"]))
        | (abroad & F.length(figures).between(10, 15))
        | (alone & figures.rlike("^0[3589]00[0-9]{7}$"))
        | (alone & country & sizes.rlike(",[45],4$|,[89]$") & placed)
        | (alone & sizes.rlike("^[23],[45],4$") & head.rlike(r"^[0-9]+[ -].*[.-][0-9]{4}$") & placed)
        | (named & (_subscriber(figures) | placed))
        | (last & (named | (bracket & (x["own"] != "")) | (abroad & (F.length(figures) >= 6)) | (alone & country & F.substring(figures, 3, 3).rlike(f"^0?{AREA}"))))
    )
    more = x["rest"].rlike(r"^(?: ?/ ?[0-9]{4,5}(?:[ .-]?[0-9]{4})?)*$")
    return F.when(phone, F.concat(F.lit(PHONE), F.when(more, "").otherwise(x["rest"]))).otherwise(run)


def masked(c: Column) -> Column:
    """A text without its contacts. What has neither an at sign nor a figure nor a word for mail is left alone."""
    mailed = F.regexp_replace(F.regexp_replace(c, MAIL, EMAIL), MAIL_END, f"$1{EMAIL}")
    split = bound(mailed, lambda t: F.struct(F.split(t, RUN, -1).alias("text"), F.regexp_extract_all(t, F.lit(RUN), F.lit(0)).alias("run")))
    later = lambda c: F.slice(c, 2, 1 << 30)
    parts = bound(split, lambda s: F.arrays_zip(s["text"].alias("before"), s["run"].alias("run"), later(s["text"]).alias("after"), later(s["run"]).alias("then")))
    done = F.transform(parts, lambda p: F.when(p["run"].isNull(), p["before"]).otherwise(F.concat(p["before"], _run(p["run"], p["before"], p["after"], p["then"]))))
    joined = F.array_join(done, "")
    mark = PHONE.replace("[", r"\[").replace("]", r"\]")
    joined = F.regexp_replace(joined, rf"{mark}(?: ?/ ?{mark})+", PHONE)
    joined = F.regexp_replace(joined, rf"(?iU)({mark})[,;]? ?-? ?{EXTENSION}:? ?[0-9]{{1,5}}(?: ?(?:/|,|e) ?[0-9]{{1,5}})*(?![0-9])", "$1")
    return F.when(c.rlike(r"(?i)[@0-9]|[\[(](?:at|arroba)[\])]|mail"), joined).otherwise(c)
