"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only a local master may do without: it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders of open workspaces, the innermost last.
_open: list[str] = []


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Tables stashed inside go to a folder that is deleted at the end."""
    path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    _open.append(path)
    try:
        yield path
    finally:
        _open.remove(path)
        discard(spark, path)


def stash(df: DataFrame, spark: SparkSession, **options: str) -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder and reads it back: its lineage ends there, and lost executors cost nothing."""
    path = f"{_open[-1] if _open else shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stashed table that nothing reads any more."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def in_fold(doc_id: str, folds: int, fold: int):
    """crc32 of the id's text modulo folds equals fold; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, bound: int) -> pd.DataFrame:
    """At most `bound` labelled rows outside the held-out fold, with whole texts, picked by a hash of the id.

    The pick is ordered by hash, so it is the same on every run. Only ids reach the broadcast side, and at most `bound`
    of them. An id with several texts is taken with the least of them, one row per id, before anything is collected.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~in_fold("doc_id", folds, fold))
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id", ignore_index=True)


def chunks(texts: list[str], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Slices of a batch that hold about `chars` characters each, one text at least."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


#: Of this Python worker: what its operators keep over tasks (key, value, task of the last use), tasks so far and the last one.
_kept: dict[str, list] = {}
_tasks: list = [0, None]


def once(name: str, key: Hashable = None, make: Callable[[], object] = lambda: None):
    """What an operator makes once in a worker and uses over tasks. What no task has used lately is dropped."""
    task = TaskContext.get()
    if (now := task.taskAttemptId() if task else -1) != _tasks[1]:
        _tasks[:] = _tasks[0] + 1, now
        for old in [n for n, held in _kept.items() if held[2] < _tasks[0] - 2]:
            del _kept[old]
    if name not in _kept or _kept[name][0] != key:
        _kept.pop(name, None)
        _kept[name] = [key, make(), 0]
    _kept[name][2] = _tasks[0]
    return _kept[name][1]
