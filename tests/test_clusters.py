"""Growing stories against one pass in order of arrival, in batch and over a stream."""

import random

import pytest

from loomline.operators import clusters

SCHEMA = "k string, i long, w array<string>, c array<string>"


def one_pass(rows, least=0.45, shared=2):
    """Every group is looked at, in order of their beginnings."""
    windows, out = {}, []
    for k, i, w, c in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or [], r[3] or [])):
        w, c = set(w or ()), set(c or ())
        groups = windows.setdefault(k, [])
        for g in groups:
            n = len(w & g[1])
            if w | g[1] and n / len(w | g[1]) >= least or c & g[2] and n >= shared:
                g[1].update(w)
                g[2].update(c)
                break
        else:
            groups.append(g := (i, w, c))
        out.append((k, i, g[0]))
    return sorted(out, key=repr)


def titles(rng, n):
    words = ["iron", "ore", "price", "rise", "fall", "mine", "ship", "port", "strike", "china", "pulp", "mill", "tariff", "steel"]
    return [(rng.choice(["a", "b", None]), i, rng.sample(words, rng.randint(0, 6)), rng.sample(["V", "G", "S"], rng.choice([0, 0, 1, 2]))) for i in range(n)]


# Each is alike to what came before, not to the first: only a group that grows takes all of them.
CHAIN = [("chain", 1000 + i, [f"w{i + j}" for j in range(4)], []) for i in range(8)]
# No word in common but two, and a company that the group got from its second row.
HANDED = [("co", 2000, ["a", "b", "c", "d"], []), ("co", 2001, ["a", "b", "c"], ["V"]), ("co", 2002, ["a", "b", "x", "y", "z", "q", "r"], ["V"]), ("co", 2003, ["a", "p", "q"], ["V"])]
ODD = [("odd", 3000, [], ["V"]), ("odd", 3001, None, None), ("odd", 3002, ["a", "b"], None), ("odd", 3002, ["a", "b"], None), (None, 3003, ["a", "b"], [])]


def test_against_one_pass(spark):
    rows = titles(random.Random(17), 300) + CHAIN + HANDED + ODD
    got = clusters.grown(spark.createDataFrame(rows, SCHEMA), ["k"], "i", "w", "c").collect()
    assert sorted(map(tuple, got), key=repr) == one_pass(rows)
    stories = {(r.k, r.i): r.story for r in got}
    assert {stories["chain", 1000 + i] for i in range(3)} == {1000} and stories["co", 2002] == 2000
    assert clusters.grown(spark.createDataFrame([], SCHEMA), ["k"], "i", "w", "c").collect() == []


def test_groups_take_up_what_was_held():
    rows = [r for r in titles(random.Random(5), 200) if r[0] == "a"]
    whole, parts = clusters.Groups(0.45, 2), clusters.Groups(0.45, 2)
    for k, (_, i, w, c) in enumerate(rows):
        if k % 7 == 0:
            parts = clusters.Groups(0.45, 2, zip(parts.stories, map(sorted, parts.words), map(sorted, parts.companies), strict=True))
        assert whole.stories[whole.add(i, w, c)] == parts.stories[parts.add(i, w, c)]


@pytest.mark.parametrize("files", [1, 3])
def test_over_a_stream(spark, tmp_path, files):
    pytest.importorskip("google.protobuf")
    rows = titles(random.Random(23), 120) + CHAIN + HANDED
    for n in range(6):  # each file holds what arrived in its turn
        spark.createDataFrame(rows[n * 22 : (n + 1) * 22], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    got = clusters.grown_stream(stream, ["k"], "i", "w", "c", spark)
    got.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("k", "i", "story").collect()), key=repr) == one_pass(rows[:132])
