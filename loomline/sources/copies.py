"""What is published or kept as files of JSON: each file read, packed or not, with what came of it as a status.

A file that is not there, or cannot be read, is a row like any other: one bad file fails no job and is told from one that
was never published.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a packed file may unpack to; beyond, it is unreadable.
MOST = 64 << 20
MAGIC = b"\x1f\x8b"


def gunzipped(raw: bytes | None, most: int = MOST) -> bytes | None:
    """All members of a gzip file, or null if it is cut off, broken or too large."""
    if raw is None:
        return None
    out, left = bytearray(), raw
    try:
        while left:
            one = zlib.decompressobj(31)
            out += one.decompress(left, most + 1 - len(out))
            if not one.eof or len(out) > most:
                return None
            left = one.unused_data
    except zlib.error:
        return None
    return bytes(out)


def gzipped(raw: bytes | None) -> bytes | None:
    """Packed so that the same bytes always give the same file: no name, no time."""
    if raw is None:
        return None
    one = zlib.compressobj(9, zlib.DEFLATED, 31)
    return one.compress(raw) + one.flush()


def _each(f, raw: Column) -> Column:
    return F.arrow_udf(lambda batch: pa.array([f(x) for x in batch.to_pylist()], pa.binary()), "binary")(raw)


def packed(raw: Column) -> Column:
    return _each(gzipped, raw)


def document(content: Column) -> Column:
    """The text of a file's bytes, unpacked if they begin as gzip files do; null if they are no UTF-8 or do not unpack."""
    packed_ = F.substring(content, 1, 2) == F.lit(bytearray(MAGIC))
    return F.try_validate_utf8(F.when(packed_, _each(gunzipped, F.when(packed_, content))).otherwise(content).cast("string"))


def opened(files: DataFrame, content: str, version_key: str, version: int) -> DataFrame:
    """files with text and status: absent (no content), unreadable (not unpacked, no UTF-8, no JSON object), other
    version, or ok. text is the document where it is ok."""
    read = files.withColumn("text_", document(F.col(content)))
    whole = F.json_object_keys("text_").isNotNull() & F.try_parse_json("text_").isNotNull()
    status = F.when(F.col(content).isNull(), "absent").when(F.col("text_").isNull() | ~whole, "unreadable").when(~F.get_json_object("text_", f"$.{version_key}").eqNullSafe(F.lit(str(version))), "other version").otherwise("ok")
    return read.withColumn("status", status).withColumn("text", F.when(F.col("status") == "ok", F.col("text_"))).drop("text_", content)


def published(spark: SparkSession, folder: str, names: DataFrame, name: str, version_key: str, version: int) -> DataFrame:
    """name, status and text for each name asked for, of the files of that name in a folder. An empty file is as good as absent."""
    try:
        files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias(name), F.coalesce("content", F.lit("").cast("binary")).alias("content"))
        files.schema  # noqa: B018  a folder that is not there fails here
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.createDataFrame([], f"{name} string, content binary")
    return opened(names.select(name).distinct().join(files, name, "left"), "content", version_key, version)


def state(files: DataFrame, content: str, schema: str, version: int, version_key: str = "version") -> DataFrame:
    """A kept state by schema. What is not ok begins as an empty state; a part that is missing or of another kind is null."""
    read = opened(files, content, version_key, version)
    return read.withColumn("state", F.from_json(F.coalesce("text", F.lit("{}")), schema)).drop("text")
