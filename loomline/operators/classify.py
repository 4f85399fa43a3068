"""Rule-driven classification: ladders, scores, directions of topics, and stories."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, or null."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules])


def decision(title: Column, text: Column, keywords: list[str], blocked: list[str]) -> Column:
    """blocked, index, keep or "no keyword"."""
    rules = [
        ("blocked", title.rlike(T.whole_words(blocked))),
        ("index", (F.length(title) < 15) | (F.length(title) - F.length(F.replace(title, F.lit(" "), F.lit(""))) < 2)),
        ("keep", text.rlike(T.whole_words(keywords))),
    ]
    return F.coalesce(first_reason(rules), F.lit("no keyword"))


def substring_hits(c: Column, words: list[str]) -> Column:
    """How often the words occur, anywhere and in any case, each counted by itself."""
    low = F.lower(c)
    total = F.lit(0)
    for w in words:
        total = total + F.floor((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w))
    return total


def balance(up: Column, down: Column) -> Column:
    return F.bround(F.when(up + down == 0, 0.0).otherwise((up - down) / (up + down)), 3)


def scored(df: DataFrame, rules: list[tuple[str, int, Column]]) -> DataFrame:
    """Adds score (sum of the deltas of rules that hold), rules (their names, by comma) and take: +, -, =, or null for none."""
    score = sum((F.when(F.coalesce(c, F.lit(False)), delta).otherwise(0) for _, delta, c in rules), F.lit(0))
    names = F.concat_ws(",", *[F.when(c, F.lit(name)) for name, _, c in rules])
    take = F.when(F.col("score") > 0, "+").when(F.col("score") < 0, "-").when(F.col("rules") != "", "=")
    return df.withColumns({"score": score, "rules": names}).withColumn("take", take)


WORD, CLAUSES = re.compile(r"\w+").finditer, re.compile(r"[.;!?\n]+").split


def nearest(
    text: str | None, topics: list[tuple[str, str]], ups: list[str], downs: list[str], negators: list[str], reach: int = 60, back: int = 18, owners: dict[str, list[str]] | None = None
) -> dict[str, int]:
    """topic: 1 or -1, by the direction word nearest to it within `reach` characters of its clause. The first clause that
    settles a topic wins, ups win over downs at equal distance, a negator up to `back` characters before turns it.

    Topics that are plain words may be given as owners (word: topics) instead of patterns: they are met in the pass over
    the clause's words that finds directions, whatever their number."""
    out: dict[str, int] = {}
    owners = owners or {}
    rising, turning, signs = set(ups), set(negators), dict.fromkeys(downs, -1) | dict.fromkeys(ups, 1)
    for clause in CLAUSES((text or "").lower()):
        words = [(m.start(), m[0]) for m in WORD(clause)]
        found = [(at, w) for at, w in words if w in signs]
        if not found:
            continue
        turns = [at for at, w in words if w in turning]
        places = [at for at, _ in found]
        marks = []
        for at, w in found:
            k = bisect_left(turns, at)
            turned = k > 0 and turns[k - 1] >= at - back
            marks.append((w not in rising, at, -signs[w] if turned else signs[w]))
        met: dict[str, list[int]] = {}
        for at, w in words:
            for name in owners.get(w, ()):
                if name not in out:
                    met.setdefault(name, []).append(at)
        for name, pattern in topics:
            if name not in out and (starts := [m.start() for m in re.finditer(pattern, clause)]):
                met.setdefault(name, []).extend(starts)
        for name, starts in met.items():
            best = None
            for start in starts:
                k = bisect_left(places, start)
                for j in (k - 1, k):
                    if 0 <= j < len(marks) and (best is None or (abs(places[j] - start), *marks[j]) < best):
                        best = (abs(places[j] - start), *marks[j])
            if best and best[0] <= reach:
                out[name] = best[3]
    return out


def directions(df: DataFrame, key: str, text: str, topics, ups, downs, negators) -> DataFrame:
    """key, topic, direction. Offsets within clauses are needed, so batches of texts go through Arrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, v) for k, t in zip(b[key], b[text], strict=True) for n, v in nearest(t, topics, ups, downs, negators).items()]
            yield pd.DataFrame(rows, columns=[key, "topic", "direction"])

    return df.select(key, text).mapInPandas(run, f"{key} long, topic string, direction int")


def summary_reject(summary: Column, source: Column, least: int, most_words: int) -> Column:
    """The first reason against a summary, or null: empty, short, long, numbers (some that the source lacks)."""
    invented = F.size(F.array_except(T.numbers(summary), T.numbers(source))) > 0
    words = F.size(F.split(F.trim(summary), r"\s+"))
    empty = F.coalesce(F.trim(summary), F.lit("")) == ""
    return first_reason([("empty", empty), ("short", F.length(summary) < least), ("long", words > most_words), ("numbers", invented)])


def subset_of(found: Column, low: list[str], generic: list[str]) -> Column:
    """Some label is of low value and all are of low value or generic."""
    return F.arrays_overlap(found, F.array(*map(F.lit, low))) & (F.size(F.array_except(found, F.array(*map(F.lit, low + generic)))) == 0)


def takes(
    df: DataFrame, text: str, excluded: list[tuple[str, Column]], topics: list[tuple[str, str]], sectors: list[tuple[str, list[str]]],
    rules: list[tuple[str, int, float, Column]], irregular: Column,
) -> DataFrame:
    """The take of each row: exclusion ladder, topics, sector, relevance, rules, and an override for irregular rows.

    rules are (name, delta, confidence, condition). Adds reason (null: not excluded), topics, sector, score, rules,
    confidence (mean over the rules that fired, 0 for none), relevant (some topic and a sector) and take: "+", "-" or "=",
    null for rows that are excluded or not relevant, "=" for irregular ones.
    """
    from loomline.operators.aggregates import first_of_greatest

    sector = first_of_greatest([(n, substring_hits(F.col(text), w)) for n, w in sectors])
    out = df.withColumns({"reason": first_reason(excluded), "topics": T.tagged(F.col(text), topics), "sector": sector})
    out = scored(out, [(n, delta, c) for n, delta, _, c in rules]).drop("take")
    sure = F.array_compact(F.array(*[F.when(c, F.lit(p)) for _, _, p, c in rules]))
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, b: a + b) / F.size(sure)).otherwise(0.0)
    out = out.withColumns({"confidence": F.round(mean, 4), "relevant": (F.size("topics") > 0) & F.col("sector").isNotNull()})
    sign = F.when(irregular, "=").when(F.col("score") > 0, "+").when(F.col("score") < 0, "-").otherwise("=")
    return out.withColumn("take", F.when(F.col("reason").isNull() & F.col("relevant"), sign))


def story_score(covered: Column, best: Column, tier: Column, sources: Column) -> Column:
    """3 for each covered name, the best take (2, 1 or 0), one for a first-tier source, up to two for further sources."""
    return covered * 3 + best + tier.cast("int") + F.least(F.lit(2), sources - 1)
