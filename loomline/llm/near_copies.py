"""Near copies by Jaccard similarity of word shingles (the pipeline's stage; operator 7's digest stays as it is).

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of SIMILARITY or more. A
64-bit SimHash cannot tell such pairs: at 0.8 they differ in up to 17 bits, within which thousands of unrelated pairs lie
for each true one. So candidates are SimHash links (three bits, over the anchors of `simhash`) and texts that share one
of BANDS keys of ROWS MinHashes each; a pair at 0.8 shares a key with probability 0.99997. Each candidate is then
checked on the whole sets.

Texts of the same set are folded into one class first. In a bucket each class is checked against PIVOTS of its classes
only, so that a large group of near copies costs links in proportion to its size. Classes of buckets that these links
leave in several components are then joined by prefix filter: their shingles are put in one order, those of fewest
classes first, and two sets at SIMILARITY must share one among the first fifth of each; only pairs of different
components, of fitting sizes and places, are made, and of these only pairs whose bitmaps (each bit the parity of the
shingles that fall on it) differ in no more bits than the sets may in shingles. A first round looks at about PROBES classes
of each shingle, which joins what has many links at a cost in proportion; the second looks at all that is still in
different components. No pair that could still join two components is left out.

Defined results: texts without words are one class; of each component one row stays, that of the smallest (doc_id, text
hash), rows with a null doc_id last; repeated rows give one row; all columns are kept.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import repeat
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import discard, once, stash
from .simhash import LOWER, SEED, forest, links, majority

WORDS = 5
#: As a fraction, so that the check is in whole numbers.
SIMILARITY = (4, 5)
BANDS, ROWS = 20, 4
#: Orders of classes; the first class of a bucket in each is one of its pivots.
PIVOTS = 3
#: Classes of a shingle that others are held against before all of them are.
PROBES = 64
#: Bits of a set's bitmap, a power of two.
BITS = 512
#: Shingles whose MinHashes are taken at once.
BLOCK = 2048

_rng = np.random.default_rng(7)
_ODD = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.array([pow(1_000_003, WORDS - 1 - i, 1 << 64) for i in range(WORDS)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the set of shingles, sorted. A text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = len(words)
    if n < WORDS:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if n else [], np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words, repeat(SEED)), np.uint64, n)
    return np.unique(mixed(reduce(np.add, (h[i : n - WORDS + 1 + i] * _POWER[i] for i in range(WORDS)))))


def band_keys(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), BLOCK):
        np.minimum(least, (h[i : i + BLOCK, None] * _ODD + _ADD).min(0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for r in range(ROWS):
        out = mixed(out ^ least[r::ROWS])
    return out


def bitmap(h: np.ndarray) -> np.ndarray:
    """Two sets' bitmaps differ in no more bits than the sets in shingles."""
    on = np.bincount((h >> np.uint64(65 - BITS.bit_length())).astype(np.int64), minlength=BITS) & 1
    return np.packbits(on.astype(bool), bitorder="little").view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), class, SimHash and band keys of each row."""

    @F.pandas_udf("class long, fp long, keys array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        once("near_copies")
        rows = []
        for t in texts:
            h = shingles(t)
            ids = np.array([xxh64_intdigest(h.tobytes()), majority(h)], np.uint64).view(np.int64)
            rows.append((*ids, band_keys(h).view(np.int64)))
        return pd.DataFrame(rows, columns=["class", "fp", "keys"])

    return docs.select("doc_id", text_hash().alias("th"), sketch("text").alias("s")).select("doc_id", "th", "s.*")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, shingles and bitmap of wanted (class, th)."""

    @F.pandas_udf("shingles array<long>, bits array<long>")
    def sets(texts: pd.Series) -> pd.DataFrame:
        found = [shingles(t) for t in texts]
        return pd.DataFrame([(h.view(np.int64), bitmap(h)) for h in found], columns=["shingles", "bits"])

    texts = docs.select(text_hash().alias("th"), "text").join(wanted, "th").dropDuplicates(["class"])
    return texts.select("class", sets("text").alias("s")).select("class", "s.*")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) of classes those that are near copies."""
    up, down = SIMILARITY
    a, b = (sets.select(F.col("class").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    na, nb, both = F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    near = (F.least(na, nb) * down >= F.greatest(na, nb) * up) & (both * down >= (na + nb - both) * up)
    return pairs.join(a, "a").join(b, "b").where(near).select("a", "b")


def prefixes(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, m (shingles), bits, token and j (place) of the shingles of each wanted class one of which a near copy must share.

    The order is by the number of classes, then the shingle. Those of one class come first and are only counted.
    """
    up, down = SIMILARITY
    rows = sets.join(wanted, "class").select("class", F.size("shingles").alias("m"), F.explode("shingles").alias("token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("classes")).where("classes > 1")
    rows = rows.join(shared, "token")
    place = F.row_number().over(Window.partitionBy("class").orderBy("classes", "token")) - F.count("*").over(Window.partitionBy("class")) + F.col("m")
    rows = rows.withColumn("j", place).where(F.col("j") <= F.col("m") - F.expr(f"(m * {up} + {down - 1}) div {down}") + 1)
    return rows.drop("classes").join(sets.select("class", "bits"), "class")


def apart(rows: DataFrame, label: DataFrame, probes: int | None) -> DataFrame:
    """Pairs (a, b) of classes with different labels (class, label) that may still be near copies, by their prefixes.

    With probes each class is held against about so many classes of each shingle only, another choice for each.
    """
    up, down = SIMILARITY
    rows = rows.join(label, "class")
    shared = rows.groupBy("token").agg(F.count("*").alias("classes"), F.min("label").alias("home"), F.max("label").alias("last")).where("home < last")
    rows = rows.join(shared, "token")
    x, y = (rows.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("class", "label", "m", "j", "bits")], "home", "classes") for side in "xy")
    x = x.where("label_x <> home").drop("home", "classes")
    y = y.where(F.pmod(F.xxhash64("class_y", "token"), "classes") < probes) if probes else y
    m = F.col("m_x") + F.col("m_y")
    fits = (F.least("m_x", "m_y") * down >= F.greatest("m_x", "m_y") * up) & ((1 + F.least(F.col("m_x") - F.col("j_x"), F.col("m_y") - F.col("j_y"))) * (up + down) >= m * up)
    differ = reduce(add, (F.bit_count(F.col("bits_x")[i].bitwiseXOR(F.col("bits_y")[i])) for i in range(BITS // 64)))
    pairs = x.join(y.drop("home", "classes"), "token").where((F.col("label_x") != F.col("label_y")) & fits & (differ * (up + down) <= m * (down - up)))
    return pairs.select(F.least("class_x", "class_y").alias("a"), F.greatest("class_x", "class_y").alias("b")).distinct()


def keep_one(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """One document of each component of near copies."""
    used: list[str] = []

    def held(df: DataFrame) -> DataFrame:
        out, path = stash(df, spark)
        used.append(path)
        return out

    none = F.col("doc_id").isNull()
    key = [f"{c}_{uuid.uuid4().hex}" for c in ("none", "id", "th")]  # names that no column of docs has
    row = F.struct(none.alias(key[0]), F.coalesce("doc_id", F.lit(0)).alias(key[1]), F.col("th").alias(key[2]))
    # A row for each class, read by all that follows: k is its row that may stay.
    classes = held(sketched(docs).groupBy("class", "fp", "keys").agg(F.min("th").alias("th"), F.min(row).alias("k")))
    keyed = classes.select("class", F.explode(F.concat("keys", F.array("fp"))).alias("key"))
    order = lambda k: F.xxhash64("class", F.lit(k))
    ends = keyed.groupBy("key").agg(*[F.min_by("class", order(k)).alias(f"p{k}") for k in range(PIVOTS)], F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    crowded = held(keyed.join(ends, "key").select("key", "class", F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("pivots")))
    by_fp = held(classes.groupBy("fp").agg(F.min("class").alias("class")))
    both = links(by_fp, of="class").union(crowded.select("class", F.explode("pivots"))).toDF("x", "y")
    stars = held(both.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    wanted = crowded.select("class").union(stars.select("a")).union(stars.select("b")).distinct()
    sets = held(shingle_sets(docs, classes.select("class", "th").join(wanted, "class")))
    label = forest(held(checked(stars, sets)), spark)
    parts = open_ = None
    for probes in (PROBES, None):
        if open_ is None:
            # Classes of buckets that are still in several components.
            named = crowded.select("key", "class").join(label, F.col("class") == F.col("node"), "left").select("key", "class", F.coalesce("label", "class").alias("label"))
            split = named.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p < q").select("key")
            open_ = held(named.join(split, "key", "left_semi").select("class", "label").distinct())
        if parts is None:
            parts = held(prefixes(sets, open_.select("class")))
        more = held(checked(apart(parts, open_, probes).join(stars, ["a", "b"], "left_anti"), sets))
        if more.limit(1).count():
            # What is joined so far counts as one link for each class.
            label, open_ = forest(more.union(label), spark), None
    tied = classes.select("class", "k").join(label, F.col("class") == F.col("node"), "left").withColumn("label", F.coalesce("label", "class"))
    least = tied.groupBy("label").agg(F.min("k").alias("k"))
    kept, _ = stash(least.select("k.*"), spark)
    for path in used:
        discard(spark, path)
    # One shuffle: the copies of a kept row are then together.
    whole = docs.withColumns(dict(zip(key, (none, F.coalesce("doc_id", F.lit(0)), text_hash()), strict=True)))
    return whole.join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns)
