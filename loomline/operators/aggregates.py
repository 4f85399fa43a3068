"""Aggregations: gauges, counters, ranks, fits and encodings. All combine map-side where the function allows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.times import micros


def gauge(up: Column, down: Column, scored: Column, least: int) -> Column:
    """50 + 50 * (up - down) / scored, rounded half to even; null for fewer than `least` scored."""
    return F.when(scored >= least, F.bround(F.lit(50) + (up - down) / scored * 50, 0).cast("long"))


def take_counts(take: Column) -> list[Column]:
    """up, down, neutral, without a take and pending (null) in one pass."""
    return [
        F.count_if(take == "+").alias("up"),
        F.count_if(take == "-").alias("down"),
        F.count_if(take == "=").alias("neutral"),
        F.count_if(take == "").alias("notake"),
        F.count_if(take.isNull()).alias("pending"),
    ]


def counter_map(df: DataFrame, keys: list[str], name: Column) -> DataFrame:
    """keys and counts, a map from each name (null: "?") to its rows."""
    each = df.groupBy(*keys, F.coalesce(name, F.lit("?")).alias("name_")).agg(F.count("*").alias("n_"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name_", "n_")))).alias("counts"))


def first_of_greatest(scores: list[tuple[str, Column]]) -> Column:
    """The label of the greatest score, the first in order among equals; null if all are zero."""
    top = F.greatest(*[c for _, c in scores])
    out = F.when(top == 0, F.lit(None).cast("string"))
    for label, c in scores:
        out = out.when(c == top, label)
    return out


def cadence(df: DataFrame, source: str, ts: str, now: Column, least: int = 5) -> DataFrame:
    """now: an aggregate. Returns source, seen, last, avg_gap_h, limit_h (five gaps, 72 hours to 14 days) and silent; sources of fewer rows are left out."""
    span = (micros(F.max(ts)) - micros(F.min(ts))) / 3_600_000_000
    out = df.groupBy(source).agg(F.count("*").alias("seen"), F.max(ts).alias("last"), span.alias("span"), now.alias("now")).where(F.col("seen") >= least)
    gap = F.col("span") / (F.col("seen") - 1)
    limit = F.least(F.greatest(gap * 5, F.lit(72.0)), F.lit(336.0))
    silent = (micros("now") - micros("last")) / 3_600_000_000 > limit
    return out.select(source, "seen", "last", F.round(gap, 4).alias("avg_gap_h"), F.round(limit, 4).alias("limit_h"), silent.alias("silent"))


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the rank of value within keys, the mean of their places for equal values."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2)


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n and rho; null for fewer than three rows or no variance."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(both, keys, x, "rx_"), keys, y, "ry_")
    usable = (F.count("*") >= 3) & (F.stddev_pop("rx_") > 0) & (F.stddev_pop("ry_") > 0)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.when(usable, F.corr("rx_", "ry_")).alias("rho"))


def standardised(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds (value - mean) / sample deviation per keys; a deviation of zero or null counts as one."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("mu_"), F.coalesce(F.nullif(F.stddev_samp(value), F.lit(0.0)), F.lit(1.0)).alias("sd_"))
    return df.join(stats, keys).withColumn(name, (F.col(value) - F.col("mu_")) / F.col("sd_")).drop("mu_", "sd_")


def dot(weights: list[float], vector: Column) -> Column:
    """Sum of products, null if any element is missing."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    whole = (F.size(vector) == len(weights)) & F.forall(vector, lambda x: x.isNotNull())
    return F.when(whole, F.aggregate(F.zip_with(w, vector, lambda a, b: a * b.cast("double")), F.lit(0.0), lambda s, x: s + x))


def ridge(df: DataFrame, keys: list[str], features: list[str], target: str, alpha: float) -> DataFrame:
    """keys, n, intercept and one coefficient per feature on standardised features; the intercept is not penalised.

    Only sums of products leave the data (one partial row per task and key); each key's small system is then solved.
    """
    x = [F.col(f).cast("double") for f in features]
    y = F.col(target).cast("double")
    rows = df.where(" AND ".join(f"{c} IS NOT NULL" for c in (*features, target)))
    sums = [F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
    sums += [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)] + [F.sum(c * y).alias(f"y{i}") for i, c in enumerate(x)]
    sums += [F.sum(a * b).alias(f"p{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if j <= i]
    p = len(features)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                n = r["n"]
                mean = np.array([r[f"s{i}"] / n for i in range(p)])
                cov = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)]) - n * np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov), 0) / max(n - 1, 1))
                sd = np.where(sd > 0, sd, 1.0)
                xy = (np.array([r[f"y{i}"] for i in range(p)]) - mean * r["sy"]) / sd
                beta = np.linalg.solve(cov / np.outer(sd, sd) + alpha * np.eye(p), xy)
                out.append([*(r[k] for k in keys), n, r["sy"] / n, *beta])
            yield pd.DataFrame(out, columns=[*keys, "n", "intercept", *(f"beta_{f}" for f in features)])

    grouped = rows.groupBy(*keys).agg(*sums)
    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    return grouped.mapInPandas(solve, ", ".join(filter(None, [kinds, "n long, intercept double", *(f"beta_{f} double" for f in features)])))


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """column and code: places of its distinct values in order, from 0. Counted by ranges, so no task holds all of them."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    dealt = values.withColumn("head_", F.substring(column, 1, 2))
    sizes = dealt.groupBy("head_").agg(F.count("*").alias("n_"))
    base = sizes.withColumn("base_", F.coalesce(F.sum("n_").over(Window.orderBy("head_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    rank = F.row_number().over(Window.partitionBy("head_").orderBy(column)) - 1
    return dealt.withColumn("rank_", rank).join(base, "head_").select(column, (F.col("base_") + F.col("rank_")).alias("code"))


def coverage(df: DataFrame, features: list[str], least: float) -> DataFrame:
    """feature, share of rows that have it, and whether it is kept."""
    shares = df.agg(*[F.avg(F.col(f).isNotNull().cast("int")).alias(f) for f in features])
    rows = shares.select(F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*features))).alias("feature", "share"))
    return rows.select("feature", F.round("share", 6).alias("share"), (F.col("share") >= least).alias("kept"))


def fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, n and print: a digest of each group's set of rows in any order, as a sum of row digests. It adds up before
    the shuffle, so groups of any size cost one row per task."""
    part = F.conv(F.substring(F.sha1(F.concat_ws("|", *columns)), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(part).alias("print"))


def sparse_mean(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The mean of two sparse vectors over the union of their keys, a missing side taken as zero: one grouping, no join."""
    return a.select(*keys, value).unionByName(b.select(*keys, value)).groupBy(*keys).agg((F.sum(value) / 2).alias(value))


def concordance(value: Column) -> Column:
    """How far the signs of a group agree: 0 to 1."""
    return F.abs(F.avg(F.signum(value)))


def drift(rho: Column, n: Column, least: int = 10, low: float = -1.0, high: float = 1.65) -> Column:
    """"few", "broken", "weak" or "holds", by rho times the root of n."""
    z = rho * F.sqrt(n)
    return F.when((n < least) | rho.isNull(), "few").when(z < low, "broken").when(z < high, "weak").otherwise("holds")


def score(value: Column, sigma: Column) -> Column:
    """-100..100: value over two sigmas, cut."""
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value / F.nullif(sigma * 2, F.lit(0)))) * 100, 1)


def nested_counters(df: DataFrame, keys: list[str], tokens: Column, value: Column) -> DataFrame:
    """keys and counts: of each token of a row, how many rows have it ("n") and how many of each value; a map of maps.

    Tokens are trimmed and put in upper case, empty ones go, one of a row twice counts twice. Counting is by (keys, token,
    value) before anything is shuffled; maps are put together of counts only. Null values count under "n" alone.
    """
    names = F.filter(F.transform(tokens, lambda t: F.upper(F.trim(t))), lambda t: t != "")
    each = df.select(*keys, F.explode(names).alias("token_"), value.alias("value_"))
    counted = each.groupBy(*keys, "token_", "value_").agg(F.count("*").alias("n_"))
    entries = F.collect_list(F.when(F.col("value_").isNotNull(), F.struct("value_", "n_")))
    inner = counted.groupBy(*keys, "token_").agg(F.sort_array(entries).alias("e"), F.sum("n_").alias("all"))
    inner = inner.select(*keys, "token_", F.map_from_entries(F.concat(F.array(F.struct(F.lit("n").alias("value_"), F.col("all").alias("n_"))), "e")).alias("m"))
    return inner.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token_", F.to_json("m").alias("m"))))).alias("t")).select(*keys, F.transform_values("t", lambda k, v: F.from_json(v, "map<string,bigint>")).alias("counts"))
