"""The pipeline's near copies against brute force over all pairs."""

import random

import numpy as np

from loomline.llm import near_copies


def words(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The kept (doc_id, text): one of each component of texts at 0.8 or more."""
    sets = {t: words(t) for _, t in rows}
    texts = list(sets)
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) * 5 >= 4 * len(x | y):
                root[find(a)] = find(b)
    best = {}
    for i, t in rows:
        best[find(t)] = min(best.get(find(t), (True, 0)), (i is None, i or 0))
    return sorted(best.values())


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for k in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 150, 400]))]
        for _ in range(14):
            copy = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(999)}"
            rows.append((len(rows) * 7 % 1000, " ".join(copy)))
    rows += [(2000, None), (2001, ""), (None, "just the same words here now"), (None, "just the same words here now"), (2002, "just the same words here now"), (None, "alone and with no id"), (None, "alone and with no id")]
    rows += [(2003, "one id with one text"), (2003, "and with another text too")]
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), spark).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == brute(rows)


def test_near_copies_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = near_copies.keep_one(docs, spark)
    assert got.columns == docs.columns
    assert sorted((False, r.doc_id) for r in got.collect()) == brute(rows)


def test_large_groups_equal_brute_force(spark):
    """A group around one text, with copies near and just beyond the bound, and texts made of shared passages."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for k in range(220):
        copy = base[:]
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    parts = [" ".join(f"p{rng.randrange(900)}" for _ in range(12)) for _ in range(10)]
    rows += [(300 + k, " ".join(rng.sample(parts, rng.randint(6, 9)))) for k in range(120)]
    got = near_copies.keep_one(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, label long, th_ long").drop("th_"), spark).collect()
    assert sorted((False, r.doc_id) for r in got) == brute(rows)


def test_two_texts_under_one_id(spark):
    """Both stay if they are not alike; a row is dropped for another text only."""
    one, two = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(1, one), (1, two), (2, one), (1, one)]
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), spark).collect()
    assert sorted(map(tuple, got)) == [(1, one), (1, two)]


def test_candidates_grow_with_a_group_not_its_square(spark, monkeypatch):
    """Copies of one text, many of them beyond the bound from the pivots: pairs that are made are few to a copy."""
    made = []
    whole = near_copies.apart

    def counted(*args):
        made.append(whole(*args))
        return made[-1]

    monkeypatch.setattr(near_copies, "apart", counted)
    monkeypatch.setattr(near_copies, "discard", lambda *_: None)
    rng = random.Random(14)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for k in range(400):
        copy = base[:]
        for _ in range(rng.choice([2, 3, 3, 4, 4, 5])):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), spark).collect()
    assert sorted((False, r.doc_id) for r in got) == brute(rows)
    assert made and sum(df.count() for df in made) < 6 * len(rows)


def test_bitmaps_differ_no_more_than_sets():
    rng = np.random.default_rng(15)
    for n in (0, 1, 5, 200, 3000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        b = np.r_[a[n // 4 :], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)]
        x, y = near_copies.bitmap(a), near_copies.bitmap(b)
        assert len(x) == near_copies.BITS // 64
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= n // 4 + n // 3
