"""The take engine rule by rule, its final mapping, the ladder reason by reason, and plans that shuffle no text."""

import pytest
from pyspark.sql import functions as F

from loomline.functions.text import unmarked
from loomline.operators import takes
from loomline.plans import catalogue, take_queries

SF = "/root/testdata/sf0.001"
TOPICS = list(take_queries.V.topics)
FLAGS = list(take_queries.V.flags)


def run(spark, covered=(), region="us", sector="metals", topics=None, **given):
    """A row of signals with some topics (their directions) and flags, through the rules."""
    topics = topics or {}
    row = {f"has_{t}": t in topics for t in TOPICS} | {f"d_{t}": topics.get(t, 0) for t in TOPICS} | {f: f in given for f in FLAGS}
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()], F.array(*map(F.lit, covered)).cast("array<string>").alias("covered"), F.lit(region).alias("region"), F.lit(sector).alias("sector"))
    r = takes.settled(takes.fired(df, take_queries.RULES)).first()
    return r.rules, r.score, r.take, r.confidence


CASES = [
    ("coal_up", {"coal": 1}, {}, -1, "-"), ("coal_down", {"coal": -1}, {}, 1, "+"), ("coal_neutral", {"coal": 0}, {}, 0, "="),
    ("scrap_up", {"scrap": 1}, {}, -1, "-"), ("scrap_down", {"scrap": -1}, {}, 1, "+"), ("waste_down", {"waste": -1}, {}, 1, "+"),
    ("demand_up", {"demand": 1}, {}, 1, "+"), ("demand_down", {"demand": -1}, {}, -1, "-"), ("inventories_up", {"inventories": 1}, {}, -1, "-"), ("inventories_down", {"inventories": -1}, {}, 1, "+"),
    ("utilization_up", {"utilization": 1}, {}, 1, "+"), ("utilization_down", {"utilization": -1}, {}, -1, "-"), ("price_ore_up", {"ore": 1}, {}, 1, "+"), ("price_ore_down", {"ore": 0, "prices": -1}, {}, -1, "-"),
    ("flow_exports_up", {"pulp": 0, "exports": 1}, {"sector": "paper"}, 1, "+"), ("flow_exports_down", {"pulp": 0, "exports": -1, "production": 1}, {"sector": "paper"}, -1, "-"),
    ("flow_production_up", {"waste": 0, "production": 1}, {"sector": "paper"}, 1, "+"), ("flow_production_down", {"waste": 0, "production": -1}, {"sector": "paper"}, -1, "-"),
    ("capacity_more", {"capacity": 0}, {"increase": 1, "cut": 1}, -1, "-"), ("capacity_less", {"capacity": 0}, {"cut": 1}, 1, "+"), ("closure", {"closure": 0}, {}, 1, "+"), ("restart", {}, {"restart": 1}, -1, "-"),
    ("covered_exports", {"exports": 1}, {"covered": ["x"]}, 1, "+"), ("supply_up", {"supply": 1}, {}, -1, "-"), ("supply_down", {"supply": -1}, {}, 1, "+"),
    ("macro_offset", {"macro": 0}, {"offset_": 1, "bad": 1}, 0, "="), ("macro_down", {"macro": 0}, {"bad": 1, "good": 1}, -1, "-"), ("macro_up", {"macro": 0}, {"good": 1}, 1, "+"), ("macro_neutral", {"macro": 0}, {}, 0, "="),
]


@pytest.mark.parametrize("rule, topics, given, score, take", CASES, ids=[c[0] for c in CASES])
def test_rule(spark, rule, topics, given, score, take):
    got = run(spark, topics=topics, **given)
    assert (got[0], got[1], got[2]) == ([rule], score, take)


def test_every_rule_has_a_case():
    assert {n for n, *_ in take_queries.RULES} - {c[0] for c in CASES} == {"price_pulp_up", "price_pulp_down", "price_steel_up", "price_steel_down"}


def test_what_keeps_rules_back(spark):
    assert run(spark, topics={"scrap": 1}, region="eu")[0] == []  # scrap counts at home only
    assert run(spark, topics={"waste": 1})[0] == []  # a rise is ambiguous
    assert run(spark, topics={"ore": 1, "inventories": 1})[0] == ["inventories_up"]  # the quantity claims the direction
    assert run(spark, topics={"ore": 1, "inventories": 1}, price_signal=1)[0] == ["inventories_up", "price_ore_up"]
    assert run(spark, topics={"closure": 0}, covered=["x"])[0] == [] == run(spark, restart=1, covered=["x"])[0]
    assert run(spark, topics={"exports": 1}, covered=["x"], excepted=1)[0] == []
    assert run(spark, topics={"macro": 0, "ore": 1}, good=1)[0] == ["price_ore_up"]


def test_final_mapping(spark):
    assert run(spark)[2:] == ("=", 0.4) and run(spark, covered=["x"])[2:] == ("=", 0.5)
    assert run(spark, topics={"demand": 1, "coal": 1})[1:] == (0, "=", 0.5)
    assert run(spark, topics={"demand": 1})[3] == round(0.85 * 0.85, 4)
    assert run(spark, topics={"demand": 1, "utilization": 1})[1:] == (2, "+", 0.85)
    assert run(spark, topics={"demand": 1}, steady=1)[1:] == (1, "=", 0.6) and run(spark, topics={"demand": 1}, steady=1, figures=1)[2] == "+"
    weak = takes.settled(takes.fired(spark.range(1).selectExpr("array() AS covered", "false AS steady", "false AS figures"), [("a", "true", 1, 0.45)])).first()
    assert weak.take == "review"
    far = spark.range(1).select(*[c.alias(n) for c, n in zip(takes.regional(F.lit("+"), F.lit(0.8), F.lit(True)), ("t", "c"), strict=True)]).first()
    assert (far.t, far.c) == ("=", 0.5)


def test_directions(spark):
    v = takes.Vocabulary({"ore": ["ore"], "coal": ["coal"]}, ["rose", "up"], ["fell", "down"], ["not"], ["as"], ["while"], ["acme", "bolt"], {"a": ["north"], "b": ["south"]}, {}, {"m": (2, ["ore"], 1, []), "p": (1, [], 1, ["bolt"])})
    rows = ["Ore fell while coal rose.", "Coal has not fell", "ore up as coal fell", "ore it is. coal up", None, "South bolt north south"]
    got = takes.signals(spark.createDataFrame(list(enumerate(rows)), "i long, t string"), "t", v).orderBy("i").collect()
    assert [(r.d_ore, r.d_coal) for r in got] == [(-1, 1), (0, 1), (1, 0), (1, 1), (0, 0), (0, 0)]
    assert [(r.sector, r.region, r.covered) for r in got[4:]] == [("unknown", "unknown", []), ("p", "b", ["bolt"])]


LADDER = [("rationale", {"rationale"}), ("irrelevant_region", {"hard"}), ("irrelevant_region", {"off_topic"}), ("irrelevant_region", {"crime"}), ("personal_finance", {"personal"}), ("institutional", {"institution"}), ("no_take", {"tight"})]


def ladder(spark, flags, topics=(), covered=(), curated=False):
    names = [*FLAGS, "institution", "tight"]
    df = spark.range(1).select(*[F.lit(n in flags).alias(n) for n in names], *[F.lit(t in topics).alias(f"has_{t}") for t in TOPICS], F.array(*map(F.lit, topics)).cast("array<string>").alias("topics"), F.array(*map(F.lit, covered)).cast("array<string>").alias("covered"))
    return df.select(takes.first_reason(take_queries.LADDER, F.lit(curated)).alias("r")).first().r


@pytest.mark.parametrize("reason, flags", LADDER)
def test_ladder(spark, reason, flags):
    assert ladder(spark, flags) == reason
    assert ladder(spark, flags, curated=True) == ("rationale" if reason == "rationale" else None)
    assert ladder(spark, flags, covered=["x"]) == (reason if flags & {"rationale", "hard"} else None)


def test_ladder_order_and_exemptions(spark):
    assert ladder(spark, {"hard", "personal"}) == "irrelevant_region" and ladder(spark, {"off_topic"}, ["scrap"]) is None
    assert ladder(spark, {"institution", "weak"}) is None and ladder(spark, {"institution", "weak", "event"}) == "institutional" and ladder(spark, {"institution", "strong", "event"}) is None
    assert ladder(spark, {"tight", "player"}) is None and ladder(spark, set()) is None
    assert ladder(spark, set(), ["billet", "demand"]) == "irrelevant_commodity" and ladder(spark, set(), ["closure", "prices"]) == "low_relevance"
    assert ladder(spark, set(), ["billet", "ore"]) is None


def test_unmarked(spark):
    given = ["Éçñ Ǆ ŁÅå ṩ", "éä", "Straße", None]
    got = [r.x for r in spark.createDataFrame(list(enumerate(given)), "i long, t string").orderBy("i").select(unmarked(F.col("t")).alias("x")).collect()]
    assert got == ["ecn ǆ łaa s", "ea", "straße", None]


@pytest.mark.parametrize("name", ["body_precedence", "confusion_matrix"])
def test_no_text_is_shuffled(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.rindex("Relation")].split("Join")
    assert len(joined) > 1 and all("text#" not in part.split("\n")[0] and "html#" not in part.split("\n")[0] for part in joined)


def test_missing_parts_leave_the_rest(tmp_path):
    """Without the llm folders, or a library that only they need, the other queries are there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "loomline", tmp_path / "loomline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=100)


def test_lists_are_compared_with_listed_words_only(spark):
    """Each list was once compared with every word of a text."""
    v = takes.Vocabulary(topics={"ore": ["ore"], "tin": ["tin"]}, ups=["up"], downs=["down"], negators=["not"], causal=["as"], contrast=["but"], companies=["acme"], regions={"us": ["here"], "eu": ["there"]}, flags={"figures": ["[0-9]+"]})
    rows = spark.createDataFrame([(1, "ore up, many other words here here there acme 12"), (2, None), (3, "tin not down")], "i long, t string")
    got = takes.signals(rows, "t", v)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect(all_" in plan and "array_distinct" not in plan
    found = [(r.i, r.has_ore, r.has_tin, r.d_ore, r.d_tin, r.figures, r.covered, r.region) for r in got.orderBy("i").collect()]
    assert found == [(1, True, False, 1, 0, True, ["acme"], "us"), (2, False, False, 0, 0, False, [], "unknown"), (3, False, True, 0, 1, False, [], "unknown")]
