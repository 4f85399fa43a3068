"""The take engine and the ladder of exclusions over documents. Rules and conditions are data that both sides read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import takes
from loomline.plans.registry import registry
from loomline.sources import table

QUERIES, SQL, query = registry()

# Words of the invented texts stand for topics, companies and the rest.
V = takes.Vocabulary(
    topics={
        "coal": ["with"], "scrap": ["that", "du"], "waste": ["von"], "demand": ["der", "of"], "inventories": ["las"], "utilization": ["dans"], "prices": ["to"], "ore": ["is", "el"], "pulp": ["le"], "steel": ["mit"],
        "exports": ["qui"], "production": ["sur"], "capacity": ["ist"], "closure": ["est"], "supply": ["it"], "macro": ["un", "eine"], "billet": ["in"],
    },
    ups=["and", "for", "une", "und", "los"], downs=["was", "con", "les", "den", "this"], negators=["not", "no", "nicht", "pas"], causal=["con", "for", "par"], contrast=["not", "die", "que"],
    companies=["trash", "apache", "stupid", "licensed"],
    regions={"us": ["the", "and"], "eu": ["der", "und"], "latam": ["de", "la"]},
    flags={
        "price_signal": ["are", "au"], "increase": ["as", "pour"], "cut": ["at", "les"], "restart": ["pas", "sich"], "excepted": ["be"], "offset_": ["or", "ein"], "bad": ["was", "den"], "good": ["this", "una"], "steady": ["on", "im"], "figures": ["[0-9]+"],
        "hard": ["moron"], "off_topic": ["idiot", "scum"], "crime": ["worthless"], "personal": ["pathetic"], "player": ["have"], "strong": ["from"], "weak": ["by"], "event": ["which"], "rationale": ["cc"],
    },
    sectors={"metals": (2, ["coal", "scrap", "ore", "steel"], 1, ["trash", "apache"]), "paper": (2, ["waste", "pulp"], 1, ["licensed"]), "other": (1, ["demand", "macro"], 1, [])},
)
RULES = takes.market_rules(["ore", "pulp", "steel"], ["inventories", "supply", "demand"], ["pulp", "waste"], "us", "paper")
LADDER = takes.report_ladder(["ore", "pulp", "steel"], ["billet", "closure"], ["demand", "prices", "macro", "capacity"], "billet", "scrap")
FAR = ["latam"]
INSTITUTIONS, TIGHT, CURATED = ["wiki", "src1"], ["blog", "src2"], ["news", "src3"]


def _sql(condition: str) -> str:
    """A condition as DuckDB takes it."""
    condition = re.sub(r"array_except\(topics, array\((.*?)\)\)", r"list_filter(topics, lambda x: NOT list_contains([\1], x))", condition)
    return condition.replace("size(", "len(")


def _has(words: list[str], of: str = "words") -> str:
    """Some of the words is among a list; a pattern of digits is asked of the text."""
    return "len(list_filter(%s, lambda w: regexp_matches(w, '^[0-9]+$'))) > 0" % of if words == ["[0-9]+"] else f"list_has_any({of}, {words})"


def _most(counts: dict[str, str], default: str) -> str:
    most = f"greatest({', '.join(counts.values())})"
    return "CASE " + " ".join(f"WHEN {c} = {most} AND {c} > 0 THEN '{n}'" for n, c in counts.items()) + f" ELSE '{default}' END"


def _signals(columns: str) -> str:
    """CTEs up to sig, which has a row per document with the columns that conditions name."""
    token = r"[\p{L}\p{N}_]+"
    owner = [(w, t) for t, ws in V.topics.items() for w in ws]
    votes = {
        n: f"{w} * ({' + '.join(f'has_{t}::INT' for t in topics) or '0'}) + {c} * len(list_filter(covered, lambda x: list_contains({names}::VARCHAR[], x)))"
        for n, (w, topics, c, names) in V.sectors.items()
    }
    return rf"""
base AS (SELECT doc_id, lower(coalesce(text, '')) AS low, {columns}, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), ' (?:{"|".join(V.contrast)}) |[.;!?]+\s*'), lambda p: trim(regexp_replace(p, '(?s)(^| )({"|".join(V.causal)})( .*)?$', ''))), lambda p: p <> '') AS k FROM documents),
clauses AS (SELECT doc_id, unnest(c) AS clause, generate_subscripts(c, 1) AS n FROM (SELECT doc_id, regexp_split_to_array(array_to_string(k, chr(10)), '[.;!?\n]+') AS c FROM base)),
pieces AS (SELECT doc_id, n, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, n, regexp_extract_all(clause, '{token}|[^\p{{L}}\p{{N}}_]+') AS p FROM clauses)),
tokens AS (SELECT *, sum(length(w)) OVER (PARTITION BY doc_id, n ORDER BY i) - length(w) AS pos FROM pieces),
marks AS (SELECT doc_id, n, pos, CASE WHEN list_contains({V.ups}, w) THEN 0 ELSE 1 END AS o, CASE WHEN list_contains({V.ups}, w) THEN 1 ELSE -1 END AS sign FROM tokens WHERE list_contains({V.ups + V.downs}, w)),
nots AS (SELECT doc_id, n, pos FROM tokens WHERE list_contains({V.negators}, w)),
turned AS (SELECT m.*, EXISTS (SELECT 1 FROM nots x WHERE x.doc_id = m.doc_id AND x.n = m.n AND x.pos < m.pos AND x.pos >= m.pos - 18) AS neg FROM marks m),
owner(w, topic) AS (VALUES {", ".join(f"('{w}', '{t}')" for w, t in owner)}),
pairs AS (SELECT t.doc_id, t.n, owner.topic, min((abs(m.pos - t.pos), m.o, m.pos, CASE WHEN neg THEN -sign ELSE sign END)) AS best FROM tokens t JOIN owner USING (w) JOIN turned m ON m.doc_id = t.doc_id AND m.n = t.n GROUP BY ALL),
near AS (SELECT doc_id, topic, arg_min(best[4], n) AS way FROM pairs WHERE best[1] <= 60 GROUP BY ALL),
dirs AS (SELECT doc_id, {", ".join(f"max(way) FILTER (topic = '{t}') AS n_{t}" for t in V.topics)} FROM near GROUP BY doc_id),
words AS (SELECT base.*, list_distinct(regexp_extract_all(low, '{token}')) AS words, regexp_extract_all(low, '{token}') AS all_, list_distinct(regexp_extract_all(array_to_string(k, chr(10)), '{token}')) AS kept FROM base),
flags AS (SELECT *, {", ".join(f"{_has(w)} AS has_{t}" for t, w in V.topics.items())}, {", ".join(f"{_has(w)} AS {f}" for f, w in V.flags.items())}, list_filter({V.companies}, lambda c: list_contains(words, c)) AS covered,
  sign(len(list_intersect(kept, {V.ups})) - len(list_intersect(kept, {V.downs}))) AS way_ FROM words LEFT JOIN dirs USING (doc_id)),
towards AS (SELECT *, {", ".join(f"CASE WHEN NOT {_has(w, 'kept')} THEN 0 ELSE coalesce(nullif(n_{t}, 0), way_) END AS d_{t}" for t, w in V.topics.items())},
  list_filter([{", ".join(f"CASE WHEN has_{t} THEN '{t}' END" for t in V.topics)}], lambda x: x IS NOT NULL) AS topics,
  {_most({r: f"len(list_filter(all_, lambda w: list_contains({ws}, w)))" for r, ws in V.regions.items()}, "unknown")} AS region FROM flags),
sig AS (SELECT *, CASE WHEN sector_ = 'unknown' AND len(covered) > 0 THEN 'company' ELSE sector_ END AS sector FROM (SELECT *, {_most(votes, "unknown")} AS sector_ FROM towards))"""


def _engine() -> str:
    names = ", ".join(f"CASE WHEN {_sql(c)} THEN '{n}' END" for n, c, _, _ in RULES)
    score = " + ".join(f"CASE WHEN {_sql(c)} THEN {d} ELSE 0 END" for _, c, d, _ in RULES)
    sure = " + ".join(f"CASE WHEN {_sql(c)} THEN {s} ELSE 0 END" for _, c, _, s in RULES)
    return f"""WITH {_signals("source")},
hit AS (SELECT *, list_filter([{names}], lambda x: x IS NOT NULL) AS rules, {score} AS score, {sure} AS total FROM sig),
mean AS (SELECT *, (total / nullif(len(rules), 0))::DOUBLE AS sure, abs(score) <= 1 AND steady AND NOT figures AS stable FROM hit),
conf AS (SELECT *, CASE WHEN score = 0 THEN least(sure, 0.5) WHEN abs(score) = 1 THEN sure * 0.85 ELSE least(sure, 0.95) END AS conf FROM mean),
took AS (SELECT *, CASE WHEN len(rules) = 0 OR stable THEN '=' WHEN conf < 0.4 THEN 'review' WHEN score > 0 THEN '+' WHEN score < 0 THEN '-' ELSE '=' END AS take,
  round(CASE WHEN len(rules) = 0 THEN CASE WHEN len(covered) > 0 THEN 0.5 ELSE 0.4 END WHEN stable THEN least(sure, 0.6) ELSE conf END, 4) AS confidence FROM conf),
far AS (SELECT *, list_contains({FAR}, region) AND sector <> 'paper' AND len(covered) = 0 AND NOT excepted AND take IN ('+', '-') AS far FROM took)
SELECT doc_id, sector, region, len(covered)::INT AS covered, score::INT AS score, array_to_string(rules, ',') AS rules, CASE WHEN far THEN '=' ELSE take END AS take, CASE WHEN far THEN least(confidence, 0.5) ELSE confidence END::DOUBLE AS confidence FROM far"""


def _ladder() -> str:
    reasons = " ".join(f"WHEN {_sql(c)}{' AND NOT curated' if k else ''} THEN '{n}'" for k, (n, c) in enumerate(LADDER))
    at = lambda names: f"list_contains({names}, lower(trim(coalesce(source, ''))))"
    return f"WITH {_signals(f'{at(INSTITUTIONS)} AS institution, {at(TIGHT)} AS tight, {at(CURATED)} AS curated')} SELECT doc_id, CASE {reasons} END AS reason FROM sig"


@query(_engine())
def take_engine(spark: SparkSession, d: str) -> DataFrame:
    """Sector, region, rules that fire, net score, take and confidence of each document."""
    rows = takes.settled(takes.fired(takes.signals(table(spark, d, "documents").select("doc_id", "text"), "text", V), RULES))
    far = F.col("region").isin(FAR) & (F.col("sector") != "paper") & (F.size("covered") == 0) & ~F.col("excepted")
    take, confidence = takes.regional(F.col("take"), F.col("confidence"), far)
    return rows.select("doc_id", "sector", "region", F.size("covered").alias("covered"), "score", F.array_join("rules", ",").alias("rules"), take.alias("take"), confidence.alias("confidence"))


@query(_ladder())
def report_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The first of eight ordered reasons that keeps a document out of a report; curated sources heed the first only."""
    source = F.lower(F.trim(F.coalesce("source", F.lit(""))))
    rows = table(spark, d, "documents").select("doc_id", "text", source.isin(INSTITUTIONS).alias("institution"), source.isin(TIGHT).alias("tight"), source.isin(CURATED).alias("curated"))
    return takes.signals(rows, "text", V).select("doc_id", takes.first_reason(LADDER, F.col("curated")).alias("reason"))

