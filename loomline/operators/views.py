"""What keeps stored views in step with their source: probes, routing of late rows, merges by stamp, content digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def probe(df: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Rows and greatest stamp of each view: enough to tell whether to read it again."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(stamp).alias("top"))


def refreshed(stored: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """now (probes) with decision: new, reread if its probe differs from the stored one, else keep."""
    was = stored.select(*keys, F.col("n").alias("n_"), F.col("top").alias("top_"), F.lit(True).alias("known"))
    same = F.col("n").eqNullSafe(F.col("n_")) & F.col("top").eqNullSafe(F.col("top_"))
    decision = F.when(F.col("known").isNull(), "new").when(same, "keep").otherwise("reread")
    return now.join(was, keys, "left").select(*now.columns, decision.alias("decision"))


def routed(df: DataFrame, key: str, arrival: str, bucket: Column) -> DataFrame:
    """Adds bucket and late: whether a later bucket of the key was open when the row arrived."""
    before = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("bucket", bucket)
    return out.withColumn("late", F.coalesce(F.max("bucket").over(before) > F.col("bucket"), F.lit(False)))


def newest_stamp(old: DataFrame, new: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """One row a key: the later stamp wins, of equals the incoming row, and a null stamp loses. Aggregates map-side."""
    values = [c for c in old.columns if c not in keys]
    both = old.withColumn("src_", F.lit(0)).unionByName(new.withColumn("src_", F.lit(1)))
    rank = F.struct(F.col(stamp).isNotNull(), F.col(stamp), F.col("src_"), *[F.col(v) for v in values if v != stamp])
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*values, "src_"), rank).alias("best"))
    return best.select(*keys, *[F.col("best")[v].alias(v) for v in values], F.col("best.src_").alias("src"))


def renumbered(df: DataFrame, group: str, marked: Column, order: list[Column], most: int) -> DataFrame:
    """Adds pin: marked rows of a group numbered 1..most in order, null for the rest and the excess."""
    place = F.row_number().over(Window.partitionBy(group, marked).orderBy(*order))
    return df.withColumn("pin", F.when(marked & (place <= most), place))


def _picked(names: list[str]):
    return lambda x: F.struct(*[x[n].alias(n) for n in names])


def canonical(schema: StructType, ignored: set[str], at: str = "") -> list[Column]:
    """Columns by name, of structs too, without the ignored ones at any level."""
    out = []
    for f in sorted((f for f in schema.fields if f.name not in ignored), key=lambda f: f.name):
        here = f"{at}`{f.name}`"
        if isinstance(f.dataType, StructType):
            out.append(F.struct(*canonical(f.dataType, ignored, here + ".")).alias(f.name))
        elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
            out.append(F.transform(here, _picked(sorted(set(f.dataType.elementType.names) - ignored))).alias(f.name))
        else:
            out.append(F.col(here).alias(f.name))
    return out


def content_hash(df: DataFrame, ignored: set[str]) -> Column:
    """SHA-256 of a row's JSON with sorted keys and without stamps."""
    return F.sha2(F.to_json(F.struct(*canonical(df.schema, ignored))), 256)


def overlapping(start: Column, end: Column, recurring: Column, first: Column, last: Column) -> Column:
    """A range meets [first, last]; what recurs always does."""
    return recurring | ((start <= last) & (F.coalesce(end, start) >= first))


def with_fixed(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """All rows of df, and a row of nulls for each member that df lacks. members: one column, the key."""
    return df.join(members.union(df.select(key)).distinct(), key, "right")
