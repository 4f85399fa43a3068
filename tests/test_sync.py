"""Sweeps, verified swaps and families, run after run."""

import json

from pyspark.sql import functions as F

from loomline.operators import sync

SCHEMA = "id long, v string, week int"


def rows_of(spark, path, columns=("id", "v", "week")):
    return sorted(map(tuple, spark.read.parquet(path).select(*columns).collect()), key=repr)


def files_of(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def table(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.partitionBy("week").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def test_sweep_converges(spark, tmp_path):
    good = [(i, f"v{i}" if i % 9 else None, i % 10) for i in range(200)]
    source = table(spark, f"{tmp_path}/source", good)
    damaged = [r for r in good if r[0] != 13 and r[2] != 6] + [(500, "extra", 4), (900, "gone week", 77), (11, "twice", 1)]
    damaged = [(i, "" if i == 18 else v, w) for i, v, w in damaged]
    table(spark, f"{tmp_path}/copy", damaged)
    before = files_of(tmp_path / "copy")
    runs = [sync.sweep(spark, source, f"{tmp_path}/copy", "week", 4, f"{tmp_path}/cursor") for _ in range(4)]
    assert [r["seen"] for r in runs] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 77, 0], [1, 2, 3, 4]]
    assert [r["repaired"] for r in runs] == [[1, 3], [4, 6], [8, 77], []]
    assert rows_of(spark, f"{tmp_path}/copy") == sorted(good, key=repr)
    # What was alike is as it was, file by file.
    same = {f for f in before if any(f.startswith(f"week={w}/") for w in (0, 2, 5, 7, 9))}
    assert same and same <= files_of(tmp_path / "copy")


def test_sweep_reads_its_buckets_only(spark, tmp_path):
    source = table(spark, f"{tmp_path}/source", [(i, "v", i % 10) for i in range(50)])
    plan = sync.digests(source.where(F.col("week").isin([2, 3])), "week", source.columns)._jdf.queryExecution().toString()
    assert "PartitionFilters: [week" in plan and "week#" in plan.split("PartitionFilters: [")[1]


def test_sweep_of_nothing_and_from_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert sync.sweep(spark, empty, f"{tmp_path}/none", "week", 3, f"{tmp_path}/c0") == {"seen": [], "repaired": [], "cursor": None}
    source = table(spark, f"{tmp_path}/source", [(1, "a", 1), (2, None, 2)])
    assert sync.sweep(spark, source, f"{tmp_path}/copy", "week", 5, f"{tmp_path}/c1")["repaired"] == [1, 2]
    assert rows_of(spark, f"{tmp_path}/copy") == [(1, "a", 1), (2, None, 2)]


def test_swap_is_verified(spark, tmp_path):
    path = f"{tmp_path}/copy"
    table(spark, path, [(1, "a", 1), (2, "old", 2), (3, "old", 3)])
    new = spark.createDataFrame([(2, "new", 2), (4, "new", 2)], SCHEMA)
    was = files_of(tmp_path / "copy")
    assert sync.swap_window(spark, new.where("id = 2"), path, "week", [2, 3], "id", (2, 4)) == "short"
    assert sync.swap_window(spark, new, path, "week", [2, 3], "id", (2, 9)) == "stale"
    assert files_of(tmp_path / "copy") == was
    assert sync.swap_window(spark, new, path, "week", [2, 3], "id", (2, 4)) == "swapped"
    assert rows_of(spark, path) == [(1, "a", 1), (2, "new", 2), (4, "new", 2)]
    assert {p.name for p in tmp_path.iterdir()} == {"copy"}  # nothing staged is left


def test_family_writes_what_changed(spark, tmp_path):
    path = f"{tmp_path}/family"
    series = lambda extra=(): spark.createDataFrame([(f"s{k}", t, float(k * t)) for k in range(4) for t in range(1, 6)] + list(extra), "name string, t long, v double")
    first = {r.name: (r.first, r.last, r.points, r.run) for r in sync.publish_family(spark, series(), path, "name", "t", 1).collect()}
    assert first == {f"s{k}": (1, 5, 5, 1) for k in range(4)}
    was = files_of(tmp_path / "family" / "data")
    index = sync.publish_family(spark, series([("s2", 9, 1.0), ("new", 3, 0.0), (None, 1, 1.0), ("s0", 2, 0.0)]), path, "name", "t", 2)
    assert {r.name: (r.last, r.points, r.run) for r in index.collect()} == {"s0": (5, 5, 1), "s1": (5, 5, 1), "s2": (9, 6, 2), "s3": (5, 5, 1), "new": (3, 1, 2)}
    now = files_of(tmp_path / "family" / "data")
    assert {f.split("/")[0] for f in now - was} == {"name=s2", "name=new"} and {f for f in was if not f.startswith("name=s2")} <= now
    left = sync.publish_family(spark, series().where("name = 's1'"), path, "name", "t", 3)
    assert {r.name: r.run for r in left.collect()} == {"s0": 1, "s1": 1, "s2": 2, "s3": 1, "new": 2}
    assert sync.family(spark, path, ["new"], "name").count() == 1 and json.loads(sync.read_text(spark, f"{path}/current")) == 3


def test_newest_windows(spark):
    rows = spark.createDataFrame([("a", t) for t in (1, 2, 11, 12, 35, 36)] + [("b", 5)], "k string, t int")
    got = sync.newest_windows(rows, "k", "t", 2, F.floor(F.col("t") / 10)).collect()
    assert sorted((r.k, r.t) for r in got) == [("a", 11), ("a", 12), ("a", 35), ("a", 36), ("b", 5)]
