"""Windows and sequences over series. Every window is partitioned by the series' key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.times import micros, month_index


def lag_return(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Adds ret = value / the value before - 1; rows without a value are left out first."""
    w = Window.partitionBy(key).orderBy(ts)
    return df.where(F.col(value).isNotNull()).withColumn("ret", F.col(value) / F.nullif(F.lag(value).over(w), F.lit(0)) - 1)


def sessions(df: DataFrame, key: str, ts: str, gap_s: int) -> DataFrame:
    """Adds session, counted from 1 per key: a gap over gap_s seconds begins a new one."""
    w = Window.partitionBy(key).orderBy(ts)
    new = F.when(micros(ts) - micros(F.lag(ts).over(w)) > gap_s * 1_000_000, 1).otherwise(0)
    return df.withColumn("new_", new).withColumn("session", F.sum("new_").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) + 1).drop("new_")


def islands(df: DataFrame, key: str, order: list[str], flag: Column, least: int) -> DataFrame:
    """Runs of consecutive rows with the flag: key, first, last and length, of `least` rows at least."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("f_", F.coalesce(flag, F.lit(False))).withColumn("n_", F.row_number().over(w)).where("f_")
    rows = rows.withColumn("g_", F.col("n_") - F.row_number().over(w))
    return rows.groupBy(key, "g_").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("g_")


def newest(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")


def runs(df: DataFrame, key: str, month: str, gap: int) -> DataFrame:
    """Adds run, counted from 1 per key: more than `gap` missing months begin a new one. month: an index."""
    w = Window.partitionBy(key).orderBy(month)
    new = F.when(F.col(month) - F.lag(month).over(w) - 1 > gap, 1).otherwise(0)
    return df.withColumn("new_", new).withColumn("run", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("new_")


def run_length(df: DataFrame, key: str, month: str, value: str, gap: int) -> DataFrame:
    """key, start, values: a row for each run, months that a run lacks as nulls."""
    found = runs(df, key, month, gap)
    span = found.groupBy(key, "run").agg(F.min(month).alias("start"), F.max(month).alias("end"), F.map_from_entries(F.collect_list(F.struct(month, value))).alias("m"))
    return span.select(key, "start", F.transform(F.sequence("start", "end"), lambda i: F.try_element_at("m", i)).alias("values"))


def run_decode(encoded: DataFrame, key: str) -> DataFrame:
    """key, month, value of run_length's rows, nulls left out."""
    return encoded.select(key, "start", F.posexplode("values").alias("i", "value")).where("value IS NOT NULL").select(key, (F.col("start") + F.col("i")).alias("month"), "value")


def dense_months(df: DataFrame, keys: list[str], day: str, value: Column) -> DataFrame:
    """keys, month (an index), value: every month from a key's first to its last, null where there is none."""
    sums = df.groupBy(*keys, month_index(F.col(day)).alias("month")).agg(value.alias("value"))
    span = sums.groupBy(*keys).agg(F.explode(F.sequence(F.min("month"), F.max("month"))).alias("month"))
    return span.join(sums, [*keys, "month"], "left")


def period_changes(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """key, last_day, last and percent changes d, w, m, y (1 point, 7, 30, 365 days) and ytd, to two decimals."""
    w = Window.partitionBy(key)
    rows = df.withColumn("end", F.max(day).over(w)).withColumn("n", F.row_number().over(w.orderBy(F.desc(day))))
    at = lambda cond: F.max_by(F.when(cond, F.col(value)), F.when(cond, F.col(day)))
    base = {
        "d": F.max(F.when(F.col("n") == 2, F.col(value))),
        **{name: at(F.col(day) <= F.date_sub("end", n)) for name, n in (("w", 7), ("m", 30), ("y", 365))},
        "ytd": at(F.col(day) < F.trunc("end", "year")),
    }
    out = rows.groupBy(key).agg(F.max(day).alias("last_day"), F.max_by(value, day).alias("last"), *[c.alias(f"{n}_base") for n, c in base.items()])
    return out.select(key, "last_day", "last", *[F.round(F.when(F.col(f"{n}_base") != 0, (F.col("last") - F.col(f"{n}_base")) / F.abs(f"{n}_base") * 100), 2).alias(n) for n in base])


def resampled(df: DataFrame, key: str, ts: str, value: str, points: int, top: int = 1000) -> DataFrame:
    """key, place, scaled: at most `points` points at evenly spread, rounded indexes, scaled to 0..top (flat: top / 2)."""
    w = Window.partitionBy(key).orderBy(ts)
    whole = Window.partitionBy(key)
    rows = df.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(whole)).withColumn("low", F.min(value).over(whole)).withColumn("high", F.max(value).over(whole))
    k = F.least("n", F.lit(points))
    place = F.floor(F.col("i") * (k - 1) / F.greatest(F.col("n") - 1, F.lit(1)) + 0.5)
    wanted = F.floor(place * (F.col("n") - 1) / F.greatest(k - 1, F.lit(1)) + 0.5)
    scaled = F.when(F.col("high") == F.col("low"), F.lit(top / 2)).otherwise(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * top + 0.5))
    return rows.where(wanted == F.col("i")).select(key, place.cast("long").alias("place"), scaled.cast("long").alias("scaled"))


def keep_last(df: DataFrame, key: str, ts: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(ts))
    return df.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= n).drop("rank_")


def folds(df: DataFrame, key: str, ts: str, least: int, size: int) -> DataFrame:
    """Adds fold of a walk forward: rows after the first `least` are tested in blocks of `size`; null: training only."""
    w = Window.partitionBy(key).orderBy(ts)
    n = F.row_number().over(w)
    return df.withColumn("fold", F.when(n > least, F.floor((n - 1 - least) / size)))


def bars(events: DataFrame, key: str, ts: str, value: str, width: str = "hour") -> DataFrame:
    """Open, high, low, close and count per key and time unit."""
    stamp = F.struct(ts, "event_id")
    return events.groupBy(key, F.date_trunc(width, ts).alias("bar")).agg(F.min_by(value, stamp).alias("o"), F.max(value).alias("h"), F.min(value).alias("l"), F.max_by(value, stamp).alias("c"), F.count("*").alias("volume"))
