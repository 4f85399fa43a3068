"""A rule engine for takes: signals of texts as columns, then rules and ladders given as tables of SQL conditions.

Conditions name the columns that `signals` adds: has_<topic> (the topic is in the text), d_<topic> (its direction: 1, -1
or 0), covered (names of companies found), region, sector and further flags. They run inside whole-stage code; the only
Python is the nearest direction word, in Arrow batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators.classify import nearest


@dataclass(frozen=True)
class Vocabulary:
    """What the signals are read by. Topics and flags are words; lists of words vote for sectors and regions, in order."""

    topics: dict[str, list[str]]
    ups: list[str]
    downs: list[str]
    negators: list[str]
    causal: list[str]
    contrast: list[str]
    companies: list[str] = field(default_factory=list)
    regions: dict[str, list[str]] = field(default_factory=dict)
    flags: dict[str, list[str]] = field(default_factory=dict)
    #: Of each sector: weight of its topics, topics, weight of its companies, companies.
    sectors: dict[str, tuple[int, list[str], int, list[str]]] = field(default_factory=dict)


def word(listed: list[str]) -> str:
    return r"(?<![\p{L}\p{N}_])(?:" + "|".join(listed) + r")(?![\p{L}\p{N}_])"


def first_of_most(counts: dict[str, Column], default: str) -> Column:
    """The name of the greatest count, the first of equals; default if all are zero."""
    most = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    return F.coalesce(*[F.when((n == most) & (n > 0), F.lit(name)) for name, n in counts.items()], F.lit(default))


def signals(df: DataFrame, text: str, v: Vocabulary) -> DataFrame:
    """Adds the columns that conditions name. Direction: of the word nearest to a topic in its own clause, clauses of cause
    left out; else of the more numerous kind of different direction words there; 0 for a topic in left-out clauses only."""
    plain = lambda listed: all(re.fullmatch(r"\w+", w) for w in listed)
    topics = [(name, r"(?<!\w)(?:" + "|".join(listed) + r")(?!\w)") for name, listed in v.topics.items() if not plain(listed)]
    owners: dict[str, list[str]] = {}
    for name, listed in v.topics.items():
        for w in listed if plain(listed) else ():
            owners.setdefault(w, []).append(name)

    @F.pandas_udf("map<string,int>")
    def near(texts: pd.Series) -> pd.Series:
        return pd.Series([nearest(t, topics, v.ups, v.downs, v.negators, owners=owners) for t in texts], dtype="object")

    low = F.lower(F.coalesce(text, F.lit("")))
    kept = F.array_join(T.kept_clauses(low, v.causal, v.contrast), "\n")
    split = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    out = df.withColumns({"low_": low, "kept_": kept}).withColumns({"near_": near("kept_"), "all_": split("low_"), "clear_": split("kept_")})
    # Of a text's words only those that some list has are kept, in one pass, so that each list is compared with few.
    listing = lambda ws: F.array(*map(F.lit, sorted(set(ws)))).cast("array<string>")
    named = [w for listed in [*v.topics.values(), *v.flags.values(), v.companies] for w in listed]
    regional = sorted({w for listed in v.regions.values() for w in listed})
    moving = [w for listed in [*v.topics.values(), v.ups, v.downs] for w in listed]
    out = out.withColumns({"set_": F.array_intersect("all_", listing(named)), "words_": F.array_intersect("clear_", listing(moving)), "placed_": F.filter("all_", lambda w: w.isin(regional))})
    # Plain words are looked up among the text's own; only patterns are searched for.
    inside = lambda listed: F.arrays_overlap("set_", F.array(*map(F.lit, listed))) if plain(listed) else F.col("low_").rlike(word(listed))
    many = lambda listed: F.size(F.array_intersect("words_", F.array(*map(F.lit, listed))))
    has = {f"has_{n}": inside(listed) for n, listed in v.topics.items()}
    out = out.withColumn("way_", F.signum(many(v.ups) - many(v.downs)).cast("int"))
    towards = {f"d_{n}": F.when(~F.arrays_overlap("words_", F.array(*map(F.lit, listed))), 0).otherwise(F.coalesce(F.nullif(F.try_element_at("near_", F.lit(n)), F.lit(0)), F.col("way_"))) for n, listed in v.topics.items()}
    found = F.array_compact(F.array(*[F.when(inside([c]), F.lit(c)) for c in v.companies])) if v.companies else F.array().cast("array<string>")
    times = lambda listed: F.size(F.filter("placed_", lambda w: w.isin(listed)))
    regions = {n: times(listed) for n, listed in v.regions.items()}
    flags = {n: inside(listed) for n, listed in v.flags.items()}
    labels = F.array_compact(F.array(*[F.when(c, F.lit(n.removeprefix("has_"))) for n, c in has.items()]))
    out = out.withColumns(has | towards | flags | {"topics": labels, "covered": found, "region": first_of_most(regions, "unknown") if regions else F.lit("unknown")})
    votes = {
        n: w * sum((F.col(f"has_{t}").cast("int") for t in topics_), F.lit(0)) + c * F.size(F.array_intersect("covered", F.array(*map(F.lit, names)).cast("array<string>")))
        for n, (w, topics_, c, names) in v.sectors.items()
    }
    sector = first_of_most(votes, "unknown") if votes else F.lit("unknown")
    return out.withColumn("sector", F.when((sector == "unknown") & (F.size("covered") > 0), "company").otherwise(sector)).drop("low_", "kept_", "near_", "words_", "all_", "set_", "clear_", "placed_", "way_")


Rule = tuple[str, str, int, float]


def moves(topic: str, factor: int, sure: float = 0.85, when: str = "true", only: int = 0) -> list[Rule]:
    """Rules of a topic whose rise counts factor and whose fall counts -factor; only: 1 or -1 keeps one of them."""
    rise = (f"{topic}_up", f"has_{topic} AND d_{topic} > 0 AND {when}", factor, sure)
    fall = (f"{topic}_down", f"has_{topic} AND d_{topic} < 0 AND {when}", -factor, sure)
    return [r for r, way in ((rise, 1), (fall, -1)) if only in (0, way)]


def market_rules(products: list[str], quantities: list[str], flow: list[str], home: str, flow_sector: str) -> list[Rule]:
    """The rules in their order. products: topics that are sold; quantities: topics that claim a direction for themselves;
    flow: topics whose flow stands for demand in flow_sector; home: the region where scrap counts."""
    covered, third = "size(covered) > 0", "size(covered) = 0"
    some = lambda listed: "(" + " OR ".join(f"has_{t}" for t in listed) + ")"
    rules = [*moves("coal", -1), ("coal_neutral", "has_coal AND d_coal = 0", 0, 0.5), *moves("scrap", -1, when=f"region = '{home}'"), *moves("waste", -1, only=-1)]
    rules += [*moves("demand", 1), *moves("inventories", -1), *moves("utilization", 1)]
    priced = f"(price_signal OR NOT {some(quantities)})"
    for p in sorted(products):
        way = f"(CASE WHEN d_{p} <> 0 THEN d_{p} WHEN has_prices THEN d_prices ELSE 0 END)"
        rules += [(f"price_{p}_up", f"has_{p} AND {priced} AND {way} > 0", 1, 0.85), (f"price_{p}_down", f"has_{p} AND {priced} AND {way} < 0", -1, 0.85)]
    first = f"sector = '{flow_sector}' AND {some(flow)}"
    rules += [(f"flow_{n}", c, s, 0.55) for n, c, s in (
        ("exports_up", f"{first} AND has_exports AND d_exports > 0", 1), ("exports_down", f"{first} AND has_exports AND d_exports < 0", -1),
        ("production_up", f"{first} AND NOT has_exports AND has_production AND d_production > 0", 1), ("production_down", f"{first} AND NOT has_exports AND has_production AND d_production < 0", -1))]
    rules += [("capacity_more", f"has_capacity AND {third} AND increase", -1, 0.75), ("capacity_less", f"has_capacity AND {third} AND NOT increase AND cut", 1, 0.8)]
    rules += [("closure", f"has_closure AND {third}", 1, 0.75), ("restart", f"restart AND {third}", -1, 0.65)]
    rules += [("covered_exports", f"has_exports AND {covered} AND NOT excepted AND d_exports > 0", 1, 0.65), *moves("supply", -1, 0.6)]
    macro = f"has_macro AND NOT {some(products)}"
    rules += [("macro_offset", f"{macro} AND offset_", 0, 0.5), ("macro_down", f"{macro} AND NOT offset_ AND bad", -1, 0.6), ("macro_up", f"{macro} AND NOT offset_ AND NOT bad AND good", 1, 0.6), ("macro_neutral", f"{macro} AND NOT offset_ AND NOT bad AND NOT good", 0, 0.45)]
    return rules


def fired(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds score, rules (names in order) and sure (the mean confidence of those that fired; null for none)."""
    holds = {n: F.coalesce(F.expr(c), F.lit(False)) for n, c, _, _ in rules}
    hit = F.array_compact(F.array(*[F.when(holds[n], F.struct(F.lit(n).alias("name"), F.lit(d).alias("delta"), F.lit(s).alias("sure"))) for n, _, d, s in rules]))
    out = df.withColumn("hit_", hit)
    total = lambda c, zero: F.aggregate("hit_", zero, lambda a, x: a + x[c])
    return out.withColumns({"score": total("delta", F.lit(0)), "rules": F.transform("hit_", lambda x: x["name"]), "sure": F.when(F.size("hit_") > 0, total("sure", F.lit(0.0)) / F.size("hit_"))}).drop("hit_")


def settled(df: DataFrame, review: float = 0.4) -> DataFrame:
    """Adds take and confidence to fired(): no rule is neutral, of a covered company with 0.5; a score of one is less
    sure; words of stability turn a weak score without figures neutral; low confidence asks for review."""
    size = F.abs("score")
    none = F.size("rules") == 0
    stable = (size <= 1) & F.col("steady") & ~F.col("figures")
    conf = F.when(size == 0, F.least("sure", F.lit(0.5))).when(size == 1, F.col("sure") * 0.85).otherwise(F.least("sure", F.lit(0.95)))
    sign = F.when(F.col("score") > 0, "+").when(F.col("score") < 0, "-").otherwise("=")
    take = F.when(none | stable, "=").when(conf < review, "review").otherwise(sign)
    confidence = F.when(none, F.when(F.size("covered") > 0, 0.5).otherwise(0.4)).when(stable, F.least("sure", F.lit(0.6))).otherwise(conf)
    return df.withColumns({"take": take, "confidence": F.round(confidence, 4)})


def regional(take: Column, confidence: Column, far: Column) -> tuple[Column, Column]:
    """Directions of far regions are neutral, at 0.5 at most."""
    turned = far & take.isin("+", "-")
    return F.when(turned, "=").otherwise(take), F.when(turned, F.least(confidence, F.lit(0.5))).otherwise(confidence)


def first_reason(reasons: list[tuple[str, str]], always: Column, binding: int = 1) -> Column:
    """The name of the first condition that holds, or null. For rows that are always taken only the first `binding` count."""
    found = [F.when(F.coalesce(F.expr(c), F.lit(False)) & ((~always) if k >= binding else F.lit(True)), F.lit(n)) for k, (n, c) in enumerate(reasons)]
    return F.coalesce(*found)


def report_ladder(anchors: list[str], low: list[str], generic: list[str], worst: str, exempt: str) -> list[tuple[str, str]]:
    """The eight reasons against a text, in order. low: topics of little value, generic: topics that add none; worst: the
    low topic with a reason of its own; exempt: the topic that politics does not shut out."""
    some = lambda listed: "(" + " OR ".join(f"has_{t}" for t in listed) + ")"
    bare = "size(covered) = 0"
    only = f"{some(low)} AND size(array_except(topics, array({', '.join(repr(t) for t in low + generic)}))) = 0 AND {bare}"
    return [
        ("rationale", "rationale"),
        ("irrelevant_region", "hard"),
        ("irrelevant_region", f"off_topic AND {bare} AND NOT has_{exempt}"),
        ("irrelevant_region", f"crime AND {bare}"),
        ("personal_finance", f"personal AND {bare}"),
        ("institutional", f"institution AND NOT (size(covered) > 0 OR {some(anchors)} OR player OR strong) AND NOT (weak AND NOT event)"),
        ("no_take", f"size(topics) = 0 AND {bare} AND NOT player AND tight"),
        ("irrelevant_commodity", f"has_{worst} AND {only}"),
        ("low_relevance", only),
    ]
