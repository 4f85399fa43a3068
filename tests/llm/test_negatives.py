"""Operator 12 against all pairs."""

import math
import random
from itertools import islice

import duckdb
import numpy as np
import pytest

from loomline.llm import negatives, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, score double, block string, cell string"


def brute(rows):
    """rows: vec_id, embedding, label. Anchors are taken once by id."""
    fine = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in e), (y + 1) % 10 if i % 7 == 0 else y) for i, e, y in rows if None not in (i, e, y) and all(x is not None and math.isfinite(x) for x in e)]
    out, seen = [], set()
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for i, v, y in sorted(fine, key=lambda r: (r[0], r[2])):
        if i % 50 or i in seen:
            continue
        seen.add(i)
        all_ = sorted(((-score(v, w), j, z) for j, w, z in fine), key=lambda r: r[:2])
        for s, j, z in [r for r in all_ if r[1] != i and r[2] == y][:5]:
            window = [(n, -t) for t, n, z in all_ if z != y and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, k + 1, n, -s, t) for k, (n, t) in enumerate(window)]
    return sorted(out)


def mined(spark, rows):
    given = spark.createDataFrame([(i, e, y, 0.5, "x", None) for i, e, y in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.mine(given, spark).collect())


def small(monkeypatch, cell=4, block=8, sample=40):
    for name, value in (("CELL", cell), ("BLOCK", block), ("SAMPLE", sample)):
        monkeypatch.setattr(negatives, name, value)


@pytest.mark.parametrize("d, values", [(6, 3), (5, 1000), (1, 2)])
def test_against_all_pairs(spark, monkeypatch, d, values):
    small(monkeypatch)
    rng = random.Random(d)
    rows = [(i, [rng.randint(-values, values) / 256 for _ in range(d)], rng.choice([0, 1, 2, 2, 9])) for i in range(400)]
    got = mined(spark, rows)
    assert got == brute(rows) and got


def test_ties_repeats_and_a_common_vector(spark, monkeypatch):
    small(monkeypatch)
    rng = random.Random(2)
    common = [0.5, -0.25, 1.0, 0.125]
    rows = [(i, common if i % 3 else [rng.randint(-256, 256) / 256 for _ in range(4)], rng.randint(0, 3)) for i in range(300)]
    rows += rows[40:60] + [(i, [x * 0.75 for x in common], 5) for i in range(300, 330)]
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > len({r[:3] for r in got}) - 1


def test_odd_rows(spark, monkeypatch):
    small(monkeypatch)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.randint(0, 1)) for i in range(150)]
    odd = [(200, None, 1), (201, [1.0, None, 1.0, 1.0], 1), (202, [float("nan")] * 4, 1), (203, [float("inf"), 0.0, 0.0, 0.0], 0), (None, [9.0] * 4, 1), (204, [9.0] * 4, None)]
    others = [(250, [9.0] * 3, 1), (300, [], 0), (350, [1e30, 0.0, 0.0, 0.0], 0)]
    assert mined(spark, rows + odd + others) == brute(rows + odd)
    assert mined(spark, rows[:1]) == [] and mined(spark, odd[:3]) == [] and mined(spark, []) == []


def test_large_numbers_stay_exact(spark, monkeypatch):
    small(monkeypatch)
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-2_000_000, 2_000_000)) for _ in range(4)], rng.randint(0, 2)) for i in range(200)]
    got = mined(spark, rows)
    assert got == brute(rows) and max(r[4] for r in got) > 2**53


def test_of_the_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = queries.op12_hard_negatives(spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(con.execute(negatives.SQL).fetchall()) and rows


def test_cells_come_by_falling_bound():
    rng = np.random.default_rng(5)
    for n, m in ((7, 5), (1, 9), (4, 1), (0, 3)):
        u, w = rng.integers(-5, 5, n).astype(float), rng.integers(-5, 5, m).astype(float)
        cells = list(negatives.cells_by_bound(u, w))
        assert sorted((i, j) for _, i, j in cells) == [(i, j) for i in range(n) for j in range(m)]
        assert [b for b, _, _ in cells] == sorted((u[i] + w[j] for _, i, j in cells), reverse=True)


def test_bounds_hold_and_visits_end_early():
    """Rows around far centres: no bound is exceeded, and most cells are never opened."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 2000, (12, 8))
    rows = np.floor(centres[rng.integers(0, 12, 3000)] + rng.normal(0, 20, (3000, 8))).astype("<i4")
    books = tuple(negatives.codebook(part.astype(float), 12) for part in (rows[:, :4], rows[:, 4:]))
    cells = negatives.nearest(rows[:, :4], books[0])[0] * 12 + negatives.nearest(rows[:, 4:], books[1])[0]
    block = negatives.Block(np.arange(3000), rng.integers(0, 3, 3000), rows, cells, books)
    opened, whole = [], block.scores
    block.scores = lambda a, b, q: opened.append(b - a) or whole(a, b, q)
    for q in rows[:40].astype(float):
        u, w, lu, lw, slack = block.halves.bounds(q)
        for bound, i, j in islice(negatives.cells_by_bound(u, w), 500):
            if span := block.spans.get(block.of[0][i] * 12 + block.of[1][j]):
                s = whole(*span, q)
                assert s.max() <= bound + slack and s.min() >= lu[i] + lw[j] - slack
        found = block.search(-1, 0, q, True, [negatives.FLOOR], [negatives.CEILING], 5)
        s = np.where(block.labels == 0, block.rows @ q, -np.inf)
        assert [x for _, x, _ in found] == block.ids[np.lexsort((block.ids, -s))[:5]].tolist()
    assert sum(opened) < 0.5 * 40 * 3000
