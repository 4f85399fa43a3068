"""Joins beyond equality: as-of, range, similarity, best match, and joins that tell two versions apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.times import micros


def asof(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], strict: bool = True, tolerance: str | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its keys before its ts (at it too unless strict).

    Both sides are put into one relation and a window carries the last right row forward: one shuffle on the keys, one
    sort, nothing multiplied. Right rows older than the tolerance (an interval) give nulls. No match gives nulls.
    """
    picked = F.struct(F.col(ts).alias("at_"), *values).alias("hit_")
    own = [c for c in left.columns if c not in (*keys, ts)]
    a = left.select(*keys, ts, F.struct(*own).alias("own_"), F.lit(None).cast(right.select(picked).schema[0].dataType).alias("hit_"), F.lit(0 if strict else 1).alias("side_"))
    b = right.select(*keys, ts, F.lit(None).cast(a.schema["own_"].dataType).alias("own_"), picked, F.lit(1 if strict else 0).alias("side_"))
    w = Window.partitionBy(*keys).orderBy(ts, "side_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = a.union(b).withColumn("hit_", F.last("hit_", ignorenulls=True).over(w)).where(F.col("side_") == (0 if strict else 1))
    if tolerance:
        out = out.withColumn("hit_", F.when(F.col("hit_.at_") >= F.col(ts) - F.expr(f"INTERVAL {tolerance}"), F.col("hit_")))
    return out.select(*keys, ts, *[F.col(f"own_.{c}") for c in own], F.col("hit_.at_").alias("matched_ts"), *[F.col(f"hit_.{v}") for v in values])


def in_range(points: DataFrame, ranges: DataFrame, ts: str, start: str, end: str, width_s: int, keys: list[str] | None = None) -> DataFrame:
    """Points with the ranges [start, end) that hold them. Ranges are cut into buckets of width_s seconds, points have
    one; the join is on equality of bucket (and keys), so it is hashed, not nested."""
    bucket = lambda c: F.floor(micros(c) / (width_s * 1_000_000))
    cut = ranges.withColumn("bucket_", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end) - F.expr("INTERVAL 1 MICROSECOND")))))
    found = points.withColumn("bucket_", bucket(F.col(ts))).join(cut, ["bucket_", *(keys or [])])
    return found.where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("bucket_")


def preferred_match(left: DataFrame, right: DataFrame, on: str, prefer: Column, order: list[Column]) -> DataFrame:
    """Each left row with one right row of its key: one for which `prefer` holds if there is any, else the first."""
    w = Window.partitionBy(on).orderBy(F.coalesce(prefer, F.lit(False)).desc(), *order)
    best = right.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")
    return left.join(best, on, "left")


def token_jaccard(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str, least: float) -> DataFrame:
    """Pairs whose token sets have Jaccard similarity of `least` or more. tokens: an array of distinct strings.

    Prefix filter: a pair that reaches `least` shares one of the first n - ceil(least * n) + 1 tokens of either set, in
    the order rarest first. Only these are joined, by fitting sizes and by how many tokens can still follow; whole sets
    are compared once for each pair that meets there. Sets whose size no set of the other side fits go before that.
    """
    bounds = F.broadcast(right.agg(F.min(F.size(tokens)).alias("low_"), F.max(F.size(tokens)).alias("high_")))  # one row
    fitting = (F.size(tokens) >= F.col("low_") * least - 1e-9) & (F.size(tokens) * least <= F.col("high_") + 1e-9)
    left = left.crossJoin(bounds).where(fitting).drop("low_", "high_")
    rank = right.select(F.explode(tokens).alias("t")).groupBy("t").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, i: str) -> DataFrame:
        flat = df.select(i, F.size(tokens).alias("size"), F.explode(tokens).alias("t")).join(rank, "t", "left")
        w = Window.partitionBy(i).orderBy(F.coalesce("n", F.lit(0)), "t")
        kept = flat.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * least) + 1)
        return kept.select(i, "t", "size", (F.col("size") - F.col("r")).alias("after"))

    x, y = prefix(left, left_id), prefix(right, right_id).withColumnsRenamed({"size": "size_", "after": "after_"})
    fits = (F.least("size", "size_") >= F.greatest("size", "size_") * least - 1e-9) & ((1 + F.least("after", "after_")) * (1 + least) >= (F.col("size") + F.col("size_")) * least - 1e-9)
    pairs = x.join(y, "t").where(fits).select(left_id, right_id).distinct()
    sets = pairs.join(left.select(left_id, F.col(tokens).alias("a")), left_id).join(right.select(right_id, F.col(tokens).alias("b")), right_id)
    both = F.size(F.array_intersect("a", "b"))
    return sets.select(left_id, right_id, (both / F.greatest(F.size("a") + F.size("b") - both, F.lit(1))).alias("jaccard")).where(F.col("jaccard") >= least)


def reconcile(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and op of every row that differs: added, removed or changed."""
    a = old.select(key, F.struct(*columns).alias("a_"))
    b = new.select(key, F.struct(*columns).alias("b_"))
    op = F.when(F.col("a_").isNull(), "added").when(F.col("b_").isNull(), "removed").when(~F.col("a_").eqNullSafe(F.col("b_")), "changed")
    return a.join(b, key, "full").select(key, op.alias("op")).where("op IS NOT NULL")


def overlay(base: DataFrame, patch: DataFrame, key: str, deleted: str) -> DataFrame:
    """base with a patch on top: rows it deletes go, its other rows replace or add."""
    kept = base.join(patch, key, "left_anti")
    return kept.unionByName(patch.where(~F.col(deleted)).select(*base.columns))


def splice(old: DataFrame, new: DataFrame, key: str, ts: str) -> DataFrame:
    """old rows before the first new row of their key, then the new rows."""
    first = new.groupBy(key).agg(F.min(ts).alias("from_"))
    kept = old.join(first, key, "left").where(F.col("from_").isNull() | (F.col(ts) < F.col("from_"))).drop("from_")
    return kept.unionByName(new)


def bridge(old: DataFrame, new: DataFrame, key: str, day: str, value: str, days: int = 10, least: int = 3) -> DataFrame:
    """key and ratio: the median of new / old over the first common days, null for fewer than `least`."""
    w = Window.partitionBy(key).orderBy(day)
    both = old.select(key, day, F.col(value).alias("old_")).join(new.select(key, day, F.col(value).alias("new_")), [key, day]).where("old_ <> 0")
    first = both.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= days)
    return first.groupBy(key).agg(F.when(F.count("*") >= least, F.median(F.col("new_") / F.col("old_"))).alias("ratio"))
