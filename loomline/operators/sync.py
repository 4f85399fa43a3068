"""Stored copies kept true to their source: sweeps by digest in rotation, verified swaps of a window, and families of
files by entity with an index.

A copy is a Parquet table partitioned by a bucket (a week, an entity). Whatever is rewritten is rewritten by partition, so a
run costs what has changed, and a reader of other partitions sees nothing of it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A copy, or an empty table where there is none yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written beside its place and then renamed, so that no half of it is ever read."""
    fs, where = _fs(spark, path)
    _, beside = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"{path} was not written")


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())


def row_digest(columns: list[str]) -> Column:
    """64 bits of a row: columns by name, nulls kept apart from all values."""
    return F.xxhash64(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def digests(df: DataFrame, bucket: str, columns: list[str]) -> DataFrame:
    """bucket, rows and a digest that does not hang on their order: sums of two hashes of each row, in 128 bits' room."""
    h = row_digest(columns)
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    return df.groupBy(bucket).agg(F.count("*").alias("n"), wide(h).alias("d1"), wide(F.xxhash64(h, F.lit(1))).alias("d2"))


def differing(source: DataFrame, copy: DataFrame, bucket: str, columns: list[str]) -> list:
    """The buckets that the two do not hold alike, in order. As many as there are buckets at most; callers bound these."""
    a, b = digests(source, bucket, columns), digests(copy, bucket, columns).withColumnsRenamed({c: f"{c}_" for c in (bucket, "n", "d1", "d2")})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("n", "d1", "d2")]
    both = a.join(b, F.col(bucket).eqNullSafe(F.col(f"{bucket}_")), "full").where(~(same[0] & same[1] & same[2]))
    return sorted(r[0] for r in both.select(F.coalesce(bucket, f"{bucket}_")).collect())


def replace_buckets(rows: DataFrame, path: str, bucket: str, buckets: list, spark: SparkSession) -> None:
    """The copy's buckets become the rows'. A bucket without rows goes."""
    held = rows.where(F.col(bucket).isin(buckets))
    have = {r[0] for r in held.select(bucket).distinct().collect()}
    held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)
    for gone in set(buckets) - have:
        remove(spark, f"{path}/{bucket}={gone}")


def sweep(spark: SparkSession, source: DataFrame, path: str, bucket: str, most: int, state: str) -> dict:
    """One run of an anti-entropy sweep: the next `most` buckets in rotation are held against the source, those that differ
    are read again. Returns the buckets looked at and repaired, and where the next run goes on.

    The bucket is an integer or a text without slashes. The cursor is a file; it moves on only after the repair, so a run that
    fails is made again. Both sides are read for the buckets of the run only (partition filters, where the source is
    partitioned too).
    """
    cursor = json.loads(read_text(spark, state) or "null")
    columns = source.columns
    copy = read(spark, path, source.schema)
    known = source.select(bucket).union(copy.select(bucket)).distinct().where(F.col(bucket).isNotNull())
    ahead = known if cursor is None else known.where(F.col(bucket) > cursor)
    chosen = [r[0] for r in ahead.orderBy(bucket).limit(most).collect()]
    wrapped = len(chosen) < most
    if wrapped and cursor is not None:
        chosen += [r[0] for r in known.where(F.col(bucket) <= cursor).orderBy(bucket).limit(most - len(chosen)).collect()]
    if not chosen:
        return {"seen": [], "repaired": [], "cursor": cursor}
    within = F.col(bucket).isin(chosen)
    bad = differing(source.where(within), copy.where(within), bucket, columns)
    if bad:
        replace_buckets(source, path, bucket, bad, spark)
    write_text(spark, state, json.dumps(chosen[-1]))
    return {"seen": chosen, "repaired": bad, "cursor": chosen[-1]}


def swap_window(spark: SparkSession, rows: DataFrame, path: str, bucket: str, window: list, stamp: str, probe: tuple) -> str:
    """The copy's window replaced by rows read again, if these hold what the source's probe (rows, greatest stamp) says.

    The rows are staged first, so that what is verified is what is swapped in. Returns "swapped", or "short" or "stale":
    then the old window stays.
    """
    staged = f"{path}.{uuid.uuid4().hex}"
    try:
        rows.where(F.col(bucket).isin(window)).write.parquet(staged)
        again = spark.read.schema(rows.schema).parquet(staged)
        n, top = again.agg(F.count("*"), F.max(stamp)).first()
        if n != probe[0]:
            return "short"
        if top != probe[1]:
            return "stale"
        replace_buckets(again, path, bucket, window, spark)
        return "swapped"
    finally:
        remove(spark, staged)


def publish_family(spark: SparkSession, rows: DataFrame, path: str, entity: str, stamp: str, run: int) -> DataFrame:
    """A family of one partition for each entity, and its index: entity, digest, first, last, points and the run that wrote it.

    An entity whose rows are those of its partition is left alone. One without rows any more keeps what is published. The
    index is a table of its own, made of the partitions that exist: entries of this run and those left alone. Rows come
    once by (entity, stamp): of several the greatest counts.
    """
    columns = [c for c in rows.columns if c != entity]
    once = rows.where(F.col(entity).isNotNull()).groupBy(entity, stamp).agg(F.max(F.struct(*[c for c in columns if c != stamp])).alias("r")).select(entity, stamp, "r.*")
    marks = once.groupBy(entity).agg(F.concat_ws("/", F.count("*").cast("string"), F.sum(row_digest([entity, *columns]).cast("decimal(20,0)")).cast("string")).alias("digest"), F.min(stamp).alias("first"), F.max(stamp).alias("last"), F.count("*").alias("points"))
    marks = marks.withColumn("run", F.lit(run))
    before = latest_index(spark, path, marks.schema)
    old = before.select(entity, F.col("digest").alias("digest_"))
    changed = marks.join(old, entity, "left").where(~F.col("digest").eqNullSafe(F.col("digest_"))).drop("digest_")
    kept = before.join(changed.select(entity), entity, "left_anti")
    # Only changed partitions are written; the others are not read.
    once.join(changed.select(entity), entity, "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(entity).parquet(f"{path}/data")
    changed.unionByName(kept).write.parquet(f"{path}/index/run={run:09d}")
    write_text(spark, f"{path}/current", str(run))
    return latest_index(spark, path, marks.schema)


def latest_index(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The index of the last run that came to its end."""
    run = read_text(spark, f"{path}/current")
    return read(spark, f"{path}/index/run={int(run):09d}", schema) if run else spark.createDataFrame([], schema)


def family(spark: SparkSession, path: str, entities: list | None = None, entity: str = "") -> DataFrame:
    """What is published, of some entities or of all."""
    found = spark.read.parquet(f"{path}/data")
    return found if entities is None else found.where(F.col(entity).isin(entities))


def newest_windows(df: DataFrame, key: str, stamp: str, windows: int, width: Column) -> DataFrame:
    """Rows of the last `windows` windows that each key has. Windows are counted, rows are not ranked."""
    rows = df.withColumn("window_", width)
    mine = rows.select(key, "window_").distinct().withColumn("k_", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("window_")))).where(F.col("k_") <= windows)
    return rows.join(mine.drop("k_"), [key, "window_"], "left_semi").drop("window_")
