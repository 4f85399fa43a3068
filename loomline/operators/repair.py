"""Repair of stored series by reconstructed ones, and joins of an old series with a thinned one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repaired(stored: DataFrame, rebuilt: DataFrame, key: str, day: str, value: str, phantom: str) -> DataFrame:
    """key, day, value, origin. Phantom days take the rebuilt value or go; days that are missing between the first and
    last stored one are filled; all others stay. One shuffle: both sides are grouped by key and day."""
    both = stored.select(key, day, F.col(value).alias("s_"), F.col(phantom).alias("p_"), F.lit(None).cast("double").alias("b_")).unionByName(
        rebuilt.select(key, day, F.lit(None).cast("double").alias("s_"), F.lit(None).cast("boolean").alias("p_"), F.col(value).alias("b_")))
    days = both.groupBy(key, day).agg(F.max("s_").alias("s_"), F.bool_or("p_").alias("p_"), F.max("b_").alias("b_"))
    span = Window.partitionBy(key)
    there = F.when(F.col("p_").isNotNull(), F.col(day))
    days = days.withColumns({"from_": F.min(there).over(span), "to_": F.max(there).over(span)})
    origin = F.when(F.col("p_").isNull(), "filled").when(F.col("p_"), "rebuilt").otherwise("stored")
    out = days.where(F.col(day).between(F.col("from_"), F.col("to_"))).withColumn("origin", origin)
    out = out.withColumn(value, F.when(F.col("origin") == "stored", F.col("s_")).otherwise(F.col("b_")))
    return out.where((F.col("origin") == "stored") | F.col(value).isNotNull()).select(key, day, value, "origin")


def errors(stored: DataFrame, rebuilt: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """key, n, identical, mean_pct and worst_pct: how far the rebuilt values are from the stored ones on common days."""
    both = stored.select(key, day, F.col(value).alias("s_")).join(rebuilt.select(key, day, F.col(value).alias("b_")), [key, day])
    pct = F.abs(F.col("b_") / F.nullif(F.col("s_"), F.lit(0)) - 1) * 100
    return both.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("b_") == F.col("s_")).alias("identical"), F.round(F.avg(pct), 4).alias("mean_pct"), F.round(F.max(pct), 4).alias("worst_pct"))


def junction(old: DataFrame, light: DataFrame, key: str, day: str, value: str, cut: Column) -> DataFrame:
    """key, day, value, conflict: old points before the cut, light ones from it on. conflict: the key's series differ
    on some day that both hold."""
    tagged = old.select(key, day, value, F.lit(0).alias("side_")).union(light.select(key, day, value, F.lit(1)))
    both = Window.partitionBy(key, day)
    odd = (F.max("side_").over(both) - F.min("side_").over(both) == 1) & (F.max(value).over(both) != F.min(value).over(both))
    marked = tagged.withColumn("odd_", odd).withColumn("conflict", F.bool_or("odd_").over(Window.partitionBy(key)))
    return marked.where(F.when(F.col(day) < cut, F.col("side_") == 0).otherwise(F.col("side_") == 1)).select(key, day, value, "conflict")


def widened(df: DataFrame, key: str, day: str, value: str, width: int, points: int, different: int, most: int = 3) -> DataFrame:
    """key, width, n: the narrowest window (whole multiples of width days, up to `most`) that ends at the key's last day
    and holds enough points and different values; the widest if none does."""
    last = F.max(day).over(Window.partitionBy(key))
    rows = df.withColumn("back_", F.date_diff(last, F.col(day))).where(F.col("back_") < width * most)
    inside = [F.col("back_") < width * k for k in range(1, most + 1)]
    sums = [F.count_if(c).alias(f"n{k}_") for k, c in enumerate(inside)] + [F.count_distinct(F.when(c, F.col(value))).alias(f"d{k}_") for k, c in enumerate(inside)]
    got = rows.groupBy(key).agg(*sums)
    ok = [(F.col(f"n{k}_") >= points) & (F.col(f"d{k}_") >= different) for k in range(most)]
    pick = F.coalesce(*[F.when(c, k + 1) for k, c in enumerate(ok)], F.lit(most))
    return got.select(key, (pick * width).alias("width"), F.element_at(F.array(*[F.col(f"n{k}_") for k in range(most)]), pick).alias("n"))
