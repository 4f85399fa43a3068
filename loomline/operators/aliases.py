"""Names of many words found in texts: aliases matched as runs of words, the longest first, without overlaps.

A text's words are taken once; of each length that an alias has, its runs of words are made and looked up by equality, so
the cost hangs on the text and on the number of lengths, not on the number of aliases. Aliases are a table; Spark sends
it out or shuffles runs by it as its size asks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}_]+"


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def canonical(aliases: DataFrame, alias: str, entity: str) -> DataFrame:
    """run (words by one space), size and entity; an alias without words goes, one of several entities keeps the least."""
    rows = aliases.select(words(F.col(alias)).alias("w"), F.col(entity).alias("entity")).where(F.size("w") > 0)
    return rows.groupBy(F.array_join("w", " ").alias("run"), F.size("w").alias("size")).agg(F.min("entity").alias("entity"))


def without_overlaps(found: Column) -> Column:
    """Of spans (size, place, ...) those that are left when each, the longest first and then the earliest, takes its words.
    Words taken are marked, so the cost grows with the spans' words only."""

    @F.pandas_udf("array<int>")
    def kept(sizes: pd.Series, places: pd.Series) -> pd.Series:
        def one(size, place) -> list[int]:
            size, place = size.tolist(), place.tolist()
            taken = bytearray(max(map(int.__add__, size, place), default=0))
            left = []
            for k in sorted(range(len(size)), key=lambda k: (-size[k], place[k])):
                a, b = place[k], place[k] + size[k]
                if not any(taken[a:b]):
                    taken[a:b] = b"\1" * (b - a)
                    left.append(k)
            return sorted(left, key=place.__getitem__)

        return pd.Series([one(s, p) for s, p in zip(sizes, places, strict=True)], dtype="object")

    return F.transform(kept(found["size"], found["place"]), lambda k: F.get(found, k))


def runs(texts: DataFrame, key: str, listed: str, sizes: list[int]) -> DataFrame:
    """key, place, size and run: of each list of words all runs of the sizes given, joined column by column in Arrow."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 128):
                part = batch.slice(first, 128)
                words_ = part.column(1).flatten()
                lengths = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(lengths)), lengths)
                place = np.arange(len(words_)) - (np.cumsum(lengths) - lengths)[row]
                left = lengths[row] - place
                for n in sizes:
                    count = max(len(words_) - n + 1, 0)
                    whole = np.flatnonzero(left[:count] >= n)
                    joined = pc.binary_join_element_wise(*(words_.slice(i, count) for i in range(n)), pa.scalar(" ", words_.type))
                    columns = [part.column(0).take(pa.array(row[whole])), pa.array(place[whole].astype(np.int32)), pa.array(np.full(len(whole), n, np.int32)), joined.take(pa.array(whole))]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "place", "size", "run"])

    return texts.select(key, listed).mapInArrow(made, f"`{key}` {dict(texts.dtypes)[key]}, place int, size int, run string")


def mentions(texts: DataFrame, key: str, text: str, aliases: DataFrame, alias: str, entity: str, overlaps: bool = False) -> DataFrame:
    """key, place (word number from 0), size, run and entity of each mention. key is one row's; a null text has none."""
    names = canonical(aliases, alias, entity)
    # Few: no more than the longest alias has words.
    sizes = sorted(r[0] for r in names.select("size").distinct().collect())
    each = runs(texts.select(key, words(F.coalesce(text, F.lit(""))).alias("w_")), key, "w_", sizes)
    found = each.join(names, ["run", "size"]).select(key, "place", "size", "run", "entity")
    if overlaps:
        return found
    grouped = found.groupBy(key).agg(F.collect_list(F.struct("size", "place", "run", "entity")).alias("f"))
    return grouped.select(key, F.explode(without_overlaps(F.col("f"))).alias("m")).select(key, "m.place", "m.size", "m.run", "m.entity")
