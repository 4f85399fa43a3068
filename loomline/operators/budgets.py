"""Budgets, quotas, attempts and rankings: what may run now, and in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.times import micros


def token_bucket(df: DataFrame, key: str, order: list[str], ts: str, cost: str, capacity: float, per_second: float) -> DataFrame:
    """Adds available, the budget just before each row: it accrues with time up to capacity, each row spends its cost and
    may leave a debt. A full bucket overflows; what overflowed so far is a running maximum, so no row is stepped through."""
    w = Window.partitionBy(key).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seconds = (micros(ts) - micros(F.first(ts).over(so_far))) / 1_000_000
    spent = F.sum(cost).over(so_far) - F.col(cost)
    free = df.withColumn("free_", F.lit(capacity) + seconds * per_second - spent)
    over = F.max(F.greatest(F.col("free_") - capacity, F.lit(0.0))).over(so_far)
    return free.withColumn("over_", over).withColumn("available", F.col("free_") - F.col("over_")).drop("free_", "over_")


def attempts(df: DataFrame, key: str, order: list[str], failed: Column, most: int, broken_after: int) -> DataFrame:
    """Adds attempt and allowed: at most `most` attempts of a key, none just after `broken_after` failures in a row."""
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(-broken_after, -1)
    bad = F.sum(failed.cast("int")).over(before)
    return df.withColumn("attempt", F.row_number().over(w)).withColumn("allowed", (F.col("attempt") <= most) & ~(F.coalesce(bad, F.lit(0)) >= broken_after))


def backlog(df: DataFrame, day: str, first: Column, order: str, cost: str, quota: float, block: int = 4096) -> DataFrame:
    """Rows of each day, those with `first` before others, then by order (a whole number), while the sum of costs stays
    within the quota. Costs are summed up by blocks of the order first, so that a busy day is no single window."""
    keys = [day, "late_", "block_"]
    rows = df.withColumns({"late_": ~F.coalesce(first, F.lit(False)), "block_": F.floor(F.col(order) / block)})
    prior = Window.partitionBy(day).orderBy("late_", "block_").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*keys).agg(F.sum(cost).alias("sum_")).withColumn("base_", F.coalesce(F.sum("sum_").over(prior), F.lit(0.0))).drop("sum_")
    base = base.where(F.col("base_") <= quota)  # costs are not negative: later blocks are over
    within = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(base, keys).withColumn("used", F.col("base_") + F.sum(cost).over(within)).where(F.col("used") <= quota).drop("late_", "block_", "base_")


def ranked_providers(df: DataFrame, group: str, name: str, load: str, capacity: str, slow: str, quality: str, least: float = 0.2) -> DataFrame:
    """Providers of a group with enough headroom (else the one with most), by slowness, quality and headroom."""
    room = df.withColumn("headroom", F.lit(1) - F.col(load) / F.col(capacity))
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("headroom"), name))
    kept = room.withColumn("best_", best).withColumn("any_", F.max("headroom").over(Window.partitionBy(group)) >= least)
    kept = kept.where((F.col("headroom") >= least) | (~F.col("any_") & (F.col("best_") == 1)))
    place = F.row_number().over(Window.partitionBy(group).orderBy(slow, F.desc(quality), F.desc("headroom"), name))
    return kept.withColumn("place", place).drop("best_", "any_")
