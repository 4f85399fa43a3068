"""Writing views: keyed merges, change hashes, publishing decisions and incremental reads, on plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """old, and the rows of new whose key it lacks (of repeated new keys the first in order)."""
    w = Window.partitionBy(key).orderBy(*order)
    first = new.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")
    return old.unionByName(first.join(old.select(key), key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """The row with the newest stamp of each key; equal stamps: the new one; a null stamp loses."""
    both = old.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    columns = F.struct(*old.columns)
    return both.groupBy(key).agg(F.max_by(columns, F.struct(F.col(stamp).isNotNull(), stamp, "new_")).alias("r_")).select("r_.*")


def patched(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with the non-null columns of new written over; keys of one side only stay as they are."""
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, key, "full").select(key, *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in columns])


def change_hash(columns: list[str]) -> Column:
    """A digest of columns in the order of their names, nulls kept apart from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in sorted(columns)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def changed(rows: DataFrame, known: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and hash of rows whose digest is not the known one (key, hash); rows of a repeated key always count as changed."""
    n = F.count("*").over(Window.partitionBy(key))
    now = rows.select(key, change_hash(columns).alias("hash")).withColumn("n_", n)
    before = known.select(key, F.col("hash").alias("before_"))
    return now.join(before, key, "left").where((F.col("n_") > 1) | ~F.col("hash").eqNullSafe(F.col("before_"))).select(key, "hash")


def decision(force: Column, hash_: Column, last_hash: Column, published_hash: Column, age_s: Column, heartbeat_s: int) -> Column:
    """What to do with a view: first of forced, seed (never sent, but published alike), changed, heartbeat, skip."""
    return (
        F.when(force, "forced")
        .when(last_hash.isNull() & (hash_ == published_hash), "seed")
        .when(last_hash.isNull() | (hash_ != last_hash), "changed")
        .when(age_s >= heartbeat_s, "heartbeat")
        .otherwise("skip")
    )


def capped(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """Adds sent: the first `most` rows of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("sent", F.row_number().over(w) <= most)


def due(df: DataFrame, found: str, taken: str, found_mark: Column, taken_mark: Column) -> DataFrame:
    """Rows new since either watermark: found within 30 minutes before its mark, taken within 2 minutes before its."""
    return df.where((F.col(found) >= found_mark - F.expr("INTERVAL 30 MINUTES")) | (F.col(taken) >= taken_mark - F.expr("INTERVAL 2 MINUTES")))


def advanced(df: DataFrame, ts: str, now: Column) -> DataFrame:
    """The watermark after df: its greatest stamp, but never after now."""
    return df.agg(F.least(F.max(ts), now).alias("watermark"))


def audit_counts(source: DataFrame, view: DataFrame, bucket: Column) -> DataFrame:
    """bucket, source_rows, view_rows of buckets whose counts differ."""
    a = source.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("source_rows"))
    b = view.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("view_rows"))
    both = a.join(b, "bucket", "full").fillna(0, ["source_rows", "view_rows"])
    return both.where("source_rows <> view_rows")


def banned(df: DataFrame, names: set[str]) -> list[str]:
    """Paths of fields, at any depth, whose name is banned."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    def walk(kind, path: str) -> list[str]:
        if isinstance(kind, StructType):
            return [p for f in kind for p in ([f"{path}.{f.name}"] if f.name in names else []) + walk(f.dataType, f"{path}.{f.name}")]
        if isinstance(kind, ArrayType):
            return walk(kind.elementType, f"{path}[]")
        if isinstance(kind, MapType):
            return walk(kind.valueType, f"{path}{{}}")
        return []

    return walk(df.schema, "$")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, or an error when it is read if a key repeats: never "the last one wins"."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("n_", n).where(F.when(F.col("n_") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.to_json(F.struct(*keys))))).isNull()).drop("n_")


def write_partitions(df: DataFrame, path: str, by: str, spark: SparkSession) -> None:
    """Overwrites just the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
