"""Source divergence audit: how far the words of each source stand from those of its language (operator 13).

Single-pass in-memory indexing. A task reads its documents once and builds a block: postings (occurrences, documents) of
each term in each group of lang and source. When the block holds as much as it may, it is spilled: handed on as a run, in
order of term, and a new block begins. Runs go to hash shards, where Spark's sort merges them (a heap over sorted spills)
and equal postings become one frequency. A posting of a frequent term comes from every block, so its occurrences are added
up by (lang, term, source) before the sources of a term meet.

Distances of sources are a base and corrections. Where a term is missing from both, its distance is that of the two
sources' smallest shares, the same for all such terms: the base is that times V. A source's own terms change it whatever
the other is; that sum runs over the source's shares in order, beside the others' smallest ones. What then remains is due
to terms that both have: these pairs are streamed from a term's postings into blocks of sums, which are handed on whenever
they hold as much as they may. So no row per pair and term is ever made.

Shares are p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in exact integers; sums of them stay below 2^63 up to 9 * 10^9 kept terms.

Defined results: null text, lang and source are empty ones; a document without an id, or a repeated one, is a document
like any other; an empty table gives an empty result; other columns are ignored, whatever their names. A language
without kept terms has its pairs, at 0, and q = p = 1 + 0; a language with one source has no pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Bytes that a block of postings may hold, about; a posting counts as its term and this many more.
BLOCK, POSTING = 96 << 20, 200
#: Rows of a run that are handed on at once, and bytes of their terms.
ROWS, TERM_BYTES = 20_000, 32 << 20
#: Sources of one block of pair sums, and blocks held at once.
SIDE, HELD = 128, 256
#: A text is cut where a term ends beyond this many characters.
PIECE = 1 << 20

MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50


def pieces(text: str) -> Iterator[list[str]]:
    """Terms of a text, a stretch at a time."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and TERM(text[end]):
            end += 1
        yield TERM(text[start:end].translate(LOWER))
        start = end


class Block:
    """Postings of the documents met since the last run."""

    def __init__(self):
        self.counts: dict[tuple[str, str], Counter] = {}
        self.docs: dict[tuple[str, str], Counter] = {}
        self.held = 0

    def add(self, group: tuple[str, str], text: str) -> None:
        counts, docs = self.counts.setdefault(group, Counter()), self.docs.setdefault(group, Counter())
        met: set[str] = set()
        before = len(docs)
        for terms in pieces(text):
            counts.update(terms)
            met.update(terms)
        docs.update(met)
        # New terms are about as long as those of the text.
        self.held += (len(docs) - before) * (POSTING + 2 * len(text) // max(1, len(met)))

    def run(self) -> Iterator[pa.RecordBatch]:
        """The postings in order of group and term; a group without terms has a row of its own, with a null term."""
        for (lang, source), counts in sorted(self.counts.items()):
            docs = self.docs[lang, source]
            yield _rows(lang, source, [None], [0], [0])
            terms = sorted(counts)
            # As many rows as hold about TERM_BYTES, were all terms as long as the longest.
            step = max(1, min(ROWS, TERM_BYTES // max(map(len, terms), default=1)))
            for start in range(0, len(terms), step):
                part = terms[start : start + step]
                yield _rows(lang, source, part, list(map(counts.__getitem__, part)), list(map(docs.__getitem__, part)))


RUN = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
SUMS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("c", pa.int64())])


def _rows(lang: str, source: str, terms: list[str | None], n: list[int], docs: list[int]) -> pa.RecordBatch:
    group = (pa.array([x] * len(terms), pa.string()) for x in (lang, source))
    return pa.RecordBatch.from_arrays([*group, pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=RUN)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def postings(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, source, term, n and docs: runs of all blocks, one row per posting and block."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Block()
        for b in batches:
            for lang, source, text in zip(*(b.column(i).cast(pa.large_string()) for i in range(3)), strict=True):
                now.add((lang.as_py(), source.as_py()), text.as_py())
                if now.held >= block:
                    yield from now.run()
                    now = Block()
        yield from now.run()

    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*empty).mapInArrow(index, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.expr("1L") + F.call_function("div", wide(F.lit(SCALE), 10) * (wide(count, 20) + SMOOTH), wide(total, 20) + wide(F.lit(SMOOTH), 1) * wide(terms, 20))


def frequencies(docs: DataFrame, spark: SparkSession, block: int = BLOCK, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """kept (lang, source, term, n), groups (lang, source, total, terms) and langs (lang, total, terms)."""
    found, _ = stash(postings(docs, block).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), spark)
    # A term is kept by its language: its sources meet here, one row each.
    enough = found.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")
    kept, _ = stash(found.join(enough, ["lang", "term"]).select("lang", "source", "term", "n"), spark)
    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups, _ = stash(
        found.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(terms, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("terms", F.lit(0).cast("long")).alias("terms")),
        spark,
    )
    return kept, groups, groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))


def met_together(shares: DataFrame) -> DataFrame:
    """lang, a < b, c: over terms that both have, what the distance is beyond base and one-sided sums.

    shares has lang, term, source, p and the source's smallest share p0. A term's postings come one after the other, in
    order of source; sums are kept in blocks of SIDE x SIDE sources, HELD of them at most.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}
        place: dict[str, dict[str, int]] = {}
        names: dict[str, list[str]] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, i, j), block in sums.items():
                for row in np.flatnonzero(block.any(axis=1)):
                    cols = np.flatnonzero(block[row])
                    x, ys = names[lang][i * SIDE + row], [names[lang][j * SIDE + c] for c in cols]
                    yield batch_of([(lang, min(x, y), max(x, y), int(v)) for y, v in zip(ys, block[row, cols], strict=True)], SUMS)
            for held in (sums, place, names):
                held.clear()

        def add(lang: str, sources: list[str], p: list[int], p0: list[int]) -> None:
            known, listed = place.setdefault(lang, {}), names.setdefault(lang, [])
            for s in sources:
                if s not in known:
                    known[s] = len(listed)
                    listed.append(s)
            at = np.fromiter((known[s] for s in sources), np.int64, len(sources))
            order = np.argsort(at)
            at, p, p0 = at[order], np.array(p, np.int64)[order], np.array(p0, np.int64)[order]
            ends = np.searchsorted(at, np.arange(0, len(listed) + SIDE, SIDE))
            full = [(k, slice(ends[k], ends[k + 1])) for k in range(len(ends) - 1) if ends[k] < ends[k + 1]]
            for n, (i, x) in enumerate(full):
                for j, y in full[n:]:
                    block = sums.get((lang, i, j))
                    if block is None:
                        block = sums[lang, i, j] = np.zeros((SIDE, SIDE), np.int64)
                    px, p0x, py, p0y = p[x, None], p0[x, None], p[None, y], p0[None, y]
                    c = np.abs(px - py) - np.abs(px - p0y) - np.abs(p0x - py) + np.abs(p0x - p0y)
                    block[np.ix_(at[x] - i * SIDE, at[y] - j * SIDE)] += np.triu(c, 1) if i == j else c

        key, held = None, ([], [], [])
        for b in batches:
            for lang, term, *row in zip(*(b.column(c).to_pylist() for c in ("lang", "term", "source", "p", "p0")), strict=True):
                if (lang, term) != key:
                    if len(held[0]) > 1:
                        add(key[0], *held)
                        if len(sums) >= HELD:
                            yield from handed()
                    key, held = (lang, term), ([], [], [])
                for column, v in zip(held, row, strict=True):
                    column.append(v)
        if len(held[0]) > 1:
            add(key[0], *held)
        yield from handed()

    dealt = shares.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(stream, "lang string, a string, b string, c long").groupBy("lang", "a", "b").agg(F.sum("c").alias("c"))


def pair_values(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: every ordered pair of sources of a language, as many rows as the result has."""
    one = groups.select("lang", "source", "p0", "terms")
    pairs = one.join(one.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), "lang").where("source != item")
    # sum over own terms of |p - q0| - |p0 - q0|: own shares in order, and the others' smallest shares among them.
    own = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    none = F.lit(None).cast("long")
    line = own.select("lang", "source", F.lit(None).cast("string").alias("item"), F.col("p").alias("x"), "k", none.alias("p0"), none.alias("terms")).union(
        pairs.select("lang", "source", "item", F.col("q0").alias("x"), F.lit(0).cast("long").alias("k"), "p0", "terms")
    )
    each = Window.partitionBy("lang", "source")
    upto = each.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    x, k = F.col("x"), F.col("k")
    line = line.select("lang", "source", "item", "x", "p0", "terms", F.sum(k).over(upto).alias("below"), F.sum(k * x).over(upto).alias("sum_below"), F.sum(k).over(each).alias("all"), F.sum(k * x).over(each).alias("sum_all")).where("item IS NOT NULL")
    away = x * F.col("below") - F.col("sum_below") + (F.col("sum_all") - F.col("sum_below")) - x * (F.col("all") - F.col("below"))
    base = F.abs(F.col("p0") - x)
    sided = line.select("lang", "source", "item", (away - base * F.col("all")).alias("v"), (base * F.col("terms")).alias("base"))
    both = sided.select("lang", "source", "item", (F.col("v") + F.col("base")).alias("v")).union(sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "v"))
    met = met_together(shares)
    both = both.union(met.select("lang", "a", "b", "c")).union(met.select("lang", "b", "a", "c"))
    return both.groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))


def audit(docs: DataFrame, spark: SparkSession, block: int = BLOCK, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: distances to other sources, and terms that a source uses more than its language."""
    kept, groups, langs = frequencies(docs, spark, block, min_docs)
    p0 = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(1).cast("long"))
    groups = groups.withColumn("p0", p0)
    shares, _ = stash(kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "p0"), spark)
    all_n = kept.groupBy("lang", "term").agg(F.sum("n").alias("all_n")).join(langs, "lang").select("lang", "term", share(F.col("all_n"), F.col("total"), F.col("terms")).alias("q"))
    terms = shares.join(all_n, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(shares, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", ranked).union(terms.withColumn("rank", ranked).where(F.col("rank") <= top))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
met AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM met GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
vocabulary AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
groups AS (SELECT lang, source FROM docs GROUP BY lang, source),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM met JOIN kept USING (lang, term) GROUP BY lang, source, term),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 5 * v) AS p FROM dense JOIN vocabulary USING (lang)),
whole AS (SELECT lang, term, 1 + (1000000000 * (sum(n)::HUGEINT + 5)) // (sum(sum(n)) OVER (PARTITION BY lang)::HUGEINT + 5 * any_value(v)) AS q FROM dense JOIN vocabulary USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY 1, 2, 3, 4),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
