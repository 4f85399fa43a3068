"""Nulls in records and ids on many rows, against brute force."""

import hashlib
import random

from loomline.llm import merkle

SCHEMA = "archive long, rec_offset long, record_id long, payload string"


def audited(spark, a, b):
    got = merkle.audit(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), spark)
    return sorted(((r.archive, r.rec_offset, r.record_id, r.status) for r in got.collect()), key=repr)


def brute(a, b):
    """Records that only one side has, by key; changed where the key is on both."""
    a, b = ({(*r[:3], r[3] or "") for r in rows} for rows in (a, b))
    out = set()
    for key in {r[:3] for r in a ^ b}:
        x, y = ({r[3] for r in rows if r[:3] == key} for rows in (a, b))
        assert len(x) < 2 and len(y) < 2
        out.add((*key, "changed" if x and y else "missing" if x else "extra"))
    return sorted(out, key=repr)


def test_a_null_keeps_its_place(spark):
    one, other = [(1, 5, None, "p")], [(1, None, 5, "p")]
    assert audited(spark, one, other) == brute(one, other) == [(1, 5, None, "missing"), (1, None, 5, "extra")]
    texts = [(1, 12, 3, "p")], [(1, 1, 23, "p")]
    assert audited(spark, *texts) == brute(*texts)


def test_random_nulls(spark):
    rng = random.Random(41)
    some = lambda n: rng.choice([None, *range(n)])
    good = list({(a, o, i): (a, o, i, rng.choice(["x", "y", None, ""])) for a, o, i in ((some(3), some(8), some(8)) for _ in range(400))}.values())
    bad = [r for r in good if rng.random() > 0.05]
    bad = [(*r[:3], "z") if rng.random() < 0.05 else r for r in bad] + [(9, None, None, "new"), (None, 9, None, "new"), (None, None, 9, "new")]
    assert audited(spark, good, bad) == brute(good, bad)
    assert audited(spark, good, good) == []


def test_offsets_of_repeated_ids(spark):
    rng = random.Random(42)
    pages = [(7, f"u{rng.randrange(40)}", "h" * rng.randrange(50)) for _ in range(600)] + [(i, "u", "x" * i) for i in range(30)] + [(7, "same", "same")] * 200 + [(None, None, None)] * 3
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    got = sorted((r.rec_offset, r.digest) for r in merkle.page_records(df, spark).where("archive = 0").collect())
    digest = lambda h: hashlib.sha256(f"{len(h or '')}:{h or ''}".encode()).hexdigest()
    at, want = 0, []
    for _, u, d, h in sorted((i, u, digest(h), h) for i, u, h in pages if i is not None):
        want.append((at, d))
        at += len(h) + len(u) + 200
    assert got == sorted(want)
