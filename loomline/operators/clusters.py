"""Stories of a digest window: groups whose words and companies grow as rows join, in order of arrival.

A row joins the first group, in order of their beginnings, that it is alike to: by the share of words that row and group
have in common, or by a company of both together with enough common words. The group then takes in the row's words and
companies, so what joins later is held against all that came before. The outcome hangs on the order, so a window is folded
row by row; different windows are independent, and a window is as long as the digest it is for. What is kept of a window
is one set of words and one of companies for each group, never its rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType


class Groups:
    """The groups of one window."""

    def __init__(self, least: float, shared: int, begun: Iterable[tuple[int, Iterable[str], Iterable[str]]] = ()):
        self.least, self.shared = least, shared
        self.stories: list[int] = []
        self.words: list[set[str]] = []
        self.companies: list[set[str]] = []
        self.having: dict[str, list[int]] = defaultdict(list)
        for story, words, companies in begun:
            self._grow(self._new(story), set(words), set(companies))

    def _new(self, story: int) -> int:
        self.stories.append(story)
        self.words.append(set())
        self.companies.append(set())
        return len(self.stories) - 1

    def _grow(self, at: int, words: set[str], companies: set[str]) -> None:
        for w in words - self.words[at]:
            self.having[w].append(at)
        self.words[at] |= words
        self.companies[at] |= companies

    def add(self, row: int, words: Iterable[str], companies: Iterable[str]) -> int:
        """The row's place among the groups, after it has joined one or begun one. Only groups with a common word are met."""
        words, companies = set(words), set(companies)
        common = Counter(at for w in words for at in self.having.get(w, ()))
        for at in sorted(common):
            n = common[at]
            alike = n >= self.least * (len(words) + len(self.words[at]) - n)
            if alike or n >= self.shared and not companies.isdisjoint(self.companies[at]):
                break
        else:
            at = self._new(row)
        self._grow(at, words, companies)
        return at


def grown(df: DataFrame, keys: list[str], order: str, words: str, companies: str, least: float = 0.45, shared: int = 2) -> DataFrame:
    """keys, order and story: the order of the row that began the row's group. words and companies are arrays of text.

    One shuffle by window. A row without words is alike to nothing; null arrays are empty ones; rows of one order are taken
    as their words and companies sort; a null key is a window like any other.
    """
    head = [f for f in df.select(*keys).schema]
    schema = StructType([*head, StructField(order, LongType()), StructField("story", LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, groups = None, Groups(least, shared)
        for b in batches:
            rows = [c.to_pylist() for c in b.columns]
            stories = []
            for i in range(b.num_rows):
                if window != (window := tuple(rows[k][i] for k in range(len(keys)))):
                    groups = Groups(least, shared)
                row = rows[-3][i]
                stories.append(groups.stories[groups.add(row, rows[-2][i], rows[-1][i])])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], b.columns[-3], pa.array(stories, pa.int64())], names=schema.names)

    none = F.array().cast("array<string>")
    rows = df.select(*keys, F.col(order).cast("long").alias(order), F.coalesce(words, none).alias("words_"), F.coalesce(companies, none).alias("companies_"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, order, "words_", "companies_").mapInArrow(fold, schema)


GROUP = StructType([StructField("at", LongType()), StructField("story", LongType()), StructField("words", ArrayType(StringType())), StructField("companies", ArrayType(StringType()))])


class StoryProcessor(StatefulProcessor):
    """Groups of a window as state, one entry each; rows of a micro-batch are taken in order of arrival. A batch
    rewrites only the groups that it changed."""

    def __init__(self, order: str, least: float = 0.45, shared: int = 2):
        self.order, self.least, self.shared = order, least, shared

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("groups", StructType([StructField("at", LongType())]), GROUP)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begun = sorted((tuple(g) for _, g in self.held.iterator()), key=lambda g: g[0])
        groups = Groups(self.least, self.shared, ((story, words, companies) for _, story, words, companies in begun))
        texts = lambda x: [] if x is None else list(x)
        batch = sorted((int(i), texts(w), texts(c)) for part in rows for i, w, c in zip(part[self.order], part["words"], part["companies"], strict=True))
        changed, out = set(), []
        for row, words, companies in batch:
            at = groups.add(row, words, companies)
            changed.add(at)
            out.append((*key, row, groups.stories[at]))
        for at in changed:
            self.held.updateValue((at,), (at, groups.stories[at], sorted(groups.words[at]), sorted(groups.companies[at])))
        yield pd.DataFrame(out, columns=[*(f"key{i}" for i in range(len(key))), self.order, "story"])

    def close(self) -> None:
        pass


def grown_stream(stream: DataFrame, keys: list[str], order: str, words: str, companies: str, spark: SparkSession, least: float = 0.45, shared: int = 2) -> DataFrame:
    """As grown(), over a stream: a row is held against the groups as they stand when it arrives. Sets the state store that maps need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], F.col(order).cast("long").alias(order), F.col(words).alias("words"), F.col(companies).alias("companies"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"key{i} {kinds[f'key{i}']}" for i in range(len(keys))), f"{order} long", "story long"])
    got = rows.groupBy(*[f"key{i}" for i in range(len(keys))]).transformWithStateInPandas(StoryProcessor(order, least, shared), schema, "Append", "None")
    return got.select(*[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], order, "story")
