"""SimHash near-duplicates by anchor-point covering (operator 7).

A fingerprint has 64 bits. Two that differ in at most three agree, in one of their 32-bit halves, up to one bit.
The anchors of a half are the words of the perfect [31,26] Hamming code over its low 31 bits, a covering code of
radius one: each fingerprint has a home anchor at distance one or less. Each fingerprint is also replicated to every
anchor within covering radius plus threshold (1 + 1) of it, 16 at most. A linked pair therefore meets at the home of
either member, in one half at least; fingerprints are compared there, exactly, on all 64 bits.

Copies are folded into one class per fingerprint before anything is replicated, so a group of copies costs one row.
Only links between different fingerprints leave the join; components come from star contraction with a table written
to the shared folder after every round.

Defined results: a null or empty text has no words and fingerprint zero, which links like any other; repeated rows
give repeated results; a null doc_id belongs to the component of its fingerprint but never names it (a component
without any other id has a null component_id); extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import discard, stash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Shingle hashes whose bits are counted at once.
BLOCK = 1 << 15


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words_each: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < words_each:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(words_each)), strict=False)))
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    return majority(h)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64))

    return docs.select("doc_id", fp("text").alias("fp"))


def _half(i: int) -> Column:
    """The 31 bits of half i that the code covers."""
    return F.shiftrightunsigned("fp", 32 * i).bitwiseAND(F.lit(0x7FFFFFFF))


def _syndrome(v: Column) -> Column:
    """The xor of the places (1 to 31) of the ones of v: zero for a code word."""
    parity = [F.bit_count(v.bitwiseAND(F.lit(sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)))) % 2 for j in range(5)]
    return reduce(lambda a, b: a + b, (F.shiftleft(p.cast("int"), j) for j, p in enumerate(parity)))


def _flip(v: Column, place: Column) -> Column:
    """v with the bit at a place turned; place zero leaves it."""
    return F.when(place == 0, v).otherwise(v.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1).cast("int"))))


def anchors(fps: DataFrame, near: bool) -> DataFrame:
    """anchor and the columns of fps, fp among them: the home anchors, or if near all anchors within covering radius plus threshold."""
    halves = []
    for i in (0, 1):
        half = fps.withColumn("v", _half(i)).withColumn("s", _syndrome(F.col("v")))
        home = _flip(F.col("v"), F.col("s"))
        if near:
            others = F.transform(
                F.filter(F.sequence(F.lit(1), F.lit(31)), lambda a: (F.col("s") > 0) & (a < a.bitwiseXOR(F.col("s")))),
                lambda a: _flip(_flip(F.col("v"), a), a.bitwiseXOR(F.col("s"))),
            )
            half = half.select(*fps.columns, F.explode(F.concat(F.array(home), others)).alias("at"))
        else:
            half = half.select(*fps.columns, home.alias("at"))
        halves.append(half.select((F.col("at") + F.lit(i << 31)).alias("anchor"), *fps.columns))
    return halves[0].union(halves[1])


def links(classes: DataFrame, threshold: int = 3, of: str = "fp") -> DataFrame:
    """a, b: the column `of` of each pair of different fingerprints at threshold bits or fewer, that of the lesser first.

    A pair may come up more than once.
    """
    home, near = (anchors(classes, far).select("anchor", F.col("fp").alias(f"fp_{x}"), F.col(of).alias(x)) for far, x in ((False, "a"), (True, "b")))
    pair = (home.anchor == near.anchor) & (home.fp_a < near.fp_b) & (F.bit_count(home.fp_a.bitwiseXOR(near.fp_b)) <= threshold)
    return home.join(near, pair).select("a", "b")


def forest(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """node and label, the smallest node reachable, for every node of edges (a, b) but the smallest themselves.

    Large and small stars in turn. The driver keeps what each stage of a round leaves, so a round has few: an edge is held
    by its larger end, and one look at the ends of all edges tells if another round is due.
    """
    now, path = stash(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), spark)
    while True:
        least = now.select(F.col("u").alias("x"), F.col("v").alias("y")).groupBy("x").agg(F.min("y").alias("m"))
        large = now.join(least, F.col("v") == F.col("x"), "left").select("u", F.coalesce("m", "v").alias("v"))
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select("m", F.explode(F.array("u", "v")).alias("u")).where("u != m").select("u", F.col("m").alias("v")).distinct()
        after, new = stash(small, spark)
        # Done when every node points at one root only, and no root points on: the table is then the answer.
        ends = after.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(after.select("v", F.lit(0), F.lit(1)))
        moved = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").limit(1).count()
        discard(spark, path)
        now, path = after, new
        if not moved:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """node and label, the smallest node reachable, for every node of edges (a, b)."""
    found = forest(edges, spark)
    return found.union(found.select("label", "label").distinct())


def near_duplicates(docs: DataFrame, spark: SparkSession, threshold: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest doc_id reachable over links. One row per document."""
    fps, _ = stash(fingerprints(docs), spark)
    classes, _ = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), spark)
    label = components(links(classes.select("fp"), threshold), spark)
    tied = classes.join(label, classes.fp == label.node, "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    smallest = tied.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = tied.join(smallest, "label").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
