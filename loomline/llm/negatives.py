"""Hard negatives by exact search over an inverted multi-index (operator 12).

A vector is cut into two halves, each with a codebook of its own; a cell is a pair of codes. The score of a query q with
a row of cell (i, j) is at most u_i + w_j, where u_i = q1 . c1_i + |q1| r1_i with the code's radius r1_i, and w_j likewise.
A multi-sequence heap over the sorted half-scores yields cells by falling bound. A window is a range of scores of which
the k best rows are asked for; it is certified, and the visit of cells ends, when no bound left reaches its k-th best score.

On Spark: the codebooks are fitted on a bounded sample (SAMPLE rows, picked by a hash of the id); every row is indexed. Rows
lie in blocks of about BLOCK rows: small cells share one, a large cell has several, so that a group of equal vectors is
split. A query is first routed: windows begin with what the sample alone proves, the heap visits the cells of the whole
index, and the query goes to the blocks of visited cells only. A task reads a block's rows, then streams the block's
queries past them, with a heap over the block's own cells and radii. The best of all blocks meet in one window per query.
First each anchor's positives are found (same label, any score), then negatives in the window of each positive's score.

Scores are exact integers: products run in doubles while they stay below 2^53, in 64-bit integers beyond.

Defined results: rows without an id, label or vector, or with a null or non-finite component, take no part; nor do rows of
another length than most rows have (of equally frequent lengths the larger counts), or with a component beyond
sqrt(2^62 / length), whose scores a long might not hold. Other rows are those of another id. An id names one anchor: of
several rows with an anchor's id the least by label and vector. Repeated rows are found as often as they occur. An anchor without
positives, or a positive without negatives, has no rows. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import floor, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

#: Rows that codebooks are fitted on and that windows begin with. A bound: more rows give no larger sample.
SAMPLE = 8192
#: Rows of a cell that a codebook aims at, codes of a half at most, and rounds of fitting.
CELL, CODES, ROUNDS = 200, 256, 8
#: Rows of a block; partitions that blocks are dealt to, at most.
BLOCK, PARTS = 1024, 5000
FLOOR, CEILING = -(1 << 62), 1 << 62

SCALE = 256
ANCHORS, POSITIVES, NEGATIVES = 50, 5, 3
#: Negative scores in hundredths of the positive's.
FROM, TO = 50, 95

FOUND = "anchor_id long, window int, other_id long, score long"


def codebook(half: np.ndarray, codes: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; a code that loses its rows stays where it is."""
    centres = half[np.linspace(0, len(half) - 1, codes).astype(int)].astype(float)
    for _ in range(ROUNDS):
        near = nearest(half, centres)[0]
        for c in np.unique(near):
            centres[c] = half[near == c].mean(axis=0)
    return centres


def nearest(half: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its distance."""
    codes = np.argmin((centres**2).sum(1) - 2 * (half @ centres.T), axis=1) if len(half) else np.zeros(0, int)
    return codes, np.sqrt(((half - centres[codes]) ** 2).sum(1))


def cells_by_bound(u: np.ndarray, w: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs (i, j) by falling u[i] + w[j]: the multi-sequence heap."""
    left, right = np.argsort(-u, kind="stable"), np.argsort(-w, kind="stable")
    us, ws, left, right = u[left].tolist(), w[right].tolist(), left.tolist(), right.tolist()
    if not us or not ws:
        return
    heap = [(-us[0] - ws[0], 0, 0)]
    while heap:
        bound, x, y = heapq.heappop(heap)
        yield -bound, left[x], right[y]
        # (x, y) comes after (x, y - 1); the first column also opens the next row. So none is pushed twice.
        if y + 1 < len(ws):
            heapq.heappush(heap, (-us[x] - ws[y + 1], x, y + 1))
        if y == 0 and x + 1 < len(us):
            heapq.heappush(heap, (-us[x + 1] - ws[0], x + 1, 0))


class Halves:
    """Codes of both halves with radii, and the bounds of a query's scores with the rows of each."""

    def __init__(self, centres: tuple[np.ndarray, np.ndarray], radii: tuple[np.ndarray, np.ndarray]):
        self.centres, self.radii, self.cut = centres, radii, centres[0].shape[1]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """Upper bounds by code of either half, lower ones, and what rounding may be off by."""
        out = []
        for part, centres, radii in zip((q[: self.cut], q[self.cut :]), self.centres, self.radii, strict=True):
            middle, away = centres @ part, np.sqrt(part @ part) * radii
            out.append((middle + away, middle - away))
        (u, lu), (w, lw) = out
        return u, w, lu, lw, 1 + 1e-9 * (np.abs(u).max(initial=0) + np.abs(w).max(initial=0) + np.abs(lu).max(initial=0) + np.abs(lw).max(initial=0))


def kept(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first rows: higher scores, then smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Block:
    """The rows of a block, by cell."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, cells: np.ndarray, centres: tuple[np.ndarray, np.ndarray]):
        order = np.argsort(cells, kind="stable")
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order].astype(float)
        self.most = float(np.abs(self.rows).max(initial=0))
        found, starts = np.unique(cells[order], return_index=True)
        self.spans = dict(zip(found.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True), strict=True))
        codes, cut = len(centres[1]), centres[0].shape[1]
        used, self.of, radii = [], [], []
        for centre, code, part in ((centres[0], cells[order] // codes, self.rows[:, :cut]), (centres[1], cells[order] % codes, self.rows[:, cut:])):
            own, at = np.unique(code, return_inverse=True)
            away = np.zeros(len(own))
            np.maximum.at(away, at, np.sqrt(((part - centre[code]) ** 2).sum(1)))
            used.append(centre[own])
            radii.append(away)
            self.of.append(own.tolist())
        self.halves, self.codes, self.masks = Halves(tuple(used), tuple(radii)), codes, {}

    def scores(self, start: int, end: int, q: np.ndarray) -> np.ndarray:
        if len(q) * self.most * np.abs(q).max(initial=0) < 2**53:
            return (self.rows[start:end] @ q).astype(np.int64)
        return self.rows[start:end].astype(np.int64) @ q.astype(np.int64)

    def mask(self, label: int, same: bool) -> np.ndarray:
        if label not in self.masks:
            self.masks[label] = self.labels == label
        return self.masks[label] if same else ~self.masks[label]

    def search(self, anchor: int, label: int, q: np.ndarray, same: bool, lows: list[int], highs: list[int], k: int) -> list[tuple[int, int, int]]:
        """(window, id, score) of the k first rows of each window, as far as they reach its low end."""
        u, w, lu, lw, slack = self.halves.bounds(q)
        ok, lows, top = self.mask(label, same), list(lows), max(highs)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(lows)
        for bound, i, j in cells_by_bound(u, w):
            if bound + slack < min(lows):
                break
            span = self.spans.get(self.of[0][i] * self.codes + self.of[1][j])
            if span is None or lu[i] + lw[j] - slack > top:
                continue
            scores, ids = self.scores(*span, q), self.ids[span[0] : span[1]]
            use = ok[span[0] : span[1]] & (scores >= min(lows)) & (scores <= top)
            if same:
                use &= ids != anchor
            if not use.any():
                continue
            scores, ids = scores[use], ids[use]
            for n, (low, high) in enumerate(zip(lows, highs, strict=True)):
                into = (scores >= low) & (scores <= high)
                s, x = np.concatenate((best[n][0], scores[into])), np.concatenate((best[n][1], ids[into]))
                first = kept(s, x, k)
                best[n] = s[first], x[first]
                if len(first) == k:
                    lows[n] = max(low, int(s[first[-1]]))
        return [(n, x, s) for n, b in enumerate(best) for s, x in zip(b[0].tolist(), b[1].tolist(), strict=True)]


def vectors(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), -1)


class Index:
    """What the driver knows: codebooks, radii, which blocks hold which cell, and the sample; all of bounded size."""

    def __init__(self, rows: DataFrame, spark: SparkSession):
        """rows: vec_id, label, v (array<long>)."""
        size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        self.d, n = (size.d, size["count"]) if size else (0, 0)
        limit = min(isqrt((1 << 62) // max(1, self.d)), (1 << 31) - 1)
        rows = rows.where((F.size("v") == self.d) & F.forall("v", lambda x: F.abs(x) <= limit))
        some = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(SAMPLE).toArrow()
        self.sample = np.array(some["v"].to_pylist(), float).reshape(len(some), self.d)
        self.sample_ids, self.sample_labels = some["vec_id"].to_numpy(), some["label"].to_numpy()
        codes = min(CODES, max(1, isqrt(n // CELL)), max(1, len(some)))
        cut = self.d // 2
        self.centres = tuple(codebook(part, codes) if len(some) else np.zeros((codes, part.shape[1])) for part in (self.sample[:, :cut], self.sample[:, cut:]))
        self.rows, _ = stash(self._coded(rows), spark)
        cells = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).orderBy("cell").collect()
        radii = np.zeros((2, codes))
        self.blocks: dict[int, tuple[int, int]] = {}
        block = held = 0
        for c in cells:
            i, j = divmod(c.cell, codes)
            radii[0, i], radii[1, j] = max(radii[0, i], c.r1), max(radii[1, j], c.r2)
            if held and held + c.n > BLOCK:
                block, held = block + 1, 0
            many = -(-c.n // BLOCK)
            self.blocks[c.cell] = block, many
            block, held = (block + many, 0) if many > 1 else (block, held + c.n)
        self.parts = min(2 * block + 2, PARTS)
        self.halves = Halves(self.centres, (radii[0], radii[1]))
        table = spark.createDataFrame([(c, *b) for c, b in self.blocks.items()], "cell int, first int, many int")
        # As many rows as cells, CODES^2 at most.
        self.dealt = self.rows.join(F.broadcast(table), "cell").select((F.col("first") + F.col("n") % F.col("many")).cast("int").alias("block"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "label", "v", "cell")

    def _coded(self, rows: DataFrame) -> DataFrame:
        """vec_id, label, v as bytes, cell, distances to both centres, and a number within the task by which large cells are split."""
        centres, d = self.centres, self.d

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done = 0
            for b in batches:
                whole = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
                cut = d // 2
                (i, r1), (j, r2) = (nearest(part.astype(float), c) for part, c in zip((whole[:, :cut], whole[:, cut:]), centres, strict=True))
                v = pa.array([x.tobytes() for x in whole.astype("<i4")], pa.binary())
                n = np.arange(done, done + b.num_rows)
                done += b.num_rows
                cell = pa.array(i * len(centres[1]) + j, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), v, cell, pa.array(r1), pa.array(r2), pa.array(n, pa.int64())], names=["vec_id", "label", "v", "cell", "r1", "r2", "n"])

        return rows.select("vec_id", "label", "v").mapInArrow(coded, "vec_id long, label int, v binary, cell int, r1 double, r2 double, n long")

    def begun(self, q: np.ndarray, anchor: int, label: int, same: bool, lows: list[int], highs: list[int], k: int) -> list[int]:
        """Low ends that the sample proves: its k-th best score in each window, if it has as many."""
        ok = (self.sample_labels == label) & (self.sample_ids != anchor) if same else self.sample_labels != label
        scores = self.sample[ok] @ q
        slack = 1 + 1e-9 * np.abs(scores).max(initial=0)
        out = []
        for low, high in zip(lows, highs, strict=True):
            s = scores[(scores >= low + slack) & (scores <= high - slack)]
            out.append(max(low, floor(np.partition(s, len(s) - k)[len(s) - k] - slack)) if len(s) >= k else low)
        return out

    def route(self, q: np.ndarray, lows: list[int], highs: list[int]) -> set[int]:
        """Blocks of the cells that the heap visits before the windows are certified."""
        u, w, lu, lw, slack = self.halves.bounds(q)
        least, top, codes, blocks = min(lows), max(highs), len(self.centres[1]), set()
        for bound, i, j in cells_by_bound(u, w):
            if bound + slack < least:
                break
            if (at := self.blocks.get(i * codes + j)) and lu[i] + lw[j] - slack <= top:
                blocks.update(range(at[0], at[0] + at[1]))
        return blocks

    def search(self, queries: DataFrame, same: bool, k: int, spark: SparkSession) -> DataFrame:
        """FOUND: for each query (anchor_id, label, v, lows, highs) the first k rows of each window, by rank."""
        state = spark.sparkContext.broadcast((self.halves, self.blocks, self.sample, self.sample_ids, self.sample_labels, self.centres))

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index.__new__(Index)
            index.halves, index.blocks, index.sample, index.sample_ids, index.sample_labels, index.centres = state.value
            names = ["block", "kind", "id", "label", "v", "lows", "highs"]
            for b in batches:
                for q, anchor, label, v, lows, highs in zip(vectors(b.column("v")).astype(float), *(b.column(c).to_pylist() for c in ("anchor_id", "label", "v", "lows", "highs")), strict=True):
                    lows = index.begun(q, anchor, label, same, lows, highs, k)
                    if blocks := sorted(index.route(q, lows, highs)):
                        n = len(blocks)
                        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([1] * n, pa.int32()), pa.array([anchor] * n, pa.int64()), pa.array([label] * n, pa.int32()), pa.array([v] * n, pa.binary()), pa.array([lows] * n, pa.list_(pa.int64())), pa.array([highs] * n, pa.list_(pa.int64()))], names=names)

        def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = state.value[5]
            now, rows, block = None, [], None
            for b in batches:
                kinds, blocks = b.column("kind").to_numpy(), b.column("block").to_numpy()
                # Stretches of one block and kind.
                ends = np.flatnonzero(np.diff(blocks * 2 + kinds)) + 1
                for start, end in zip([0, *ends.tolist()], [*ends.tolist(), b.num_rows], strict=True):
                    part = b.slice(start, end - start)
                    if now != (now := int(blocks[start])) or kinds[start] == 0 and block is not None:
                        rows, block = [], None
                    if kinds[start] == 0:
                        rows.append(part)
                        continue
                    if not rows:
                        continue
                    if block is None:
                        whole = pa.Table.from_batches(rows)
                        block = Block(whole["id"].to_numpy(), whole["label"].to_numpy(), vectors(whole["v"]), whole["cell"].to_numpy(), centres)
                    found = []
                    for q, anchor, label, lows, highs in zip(vectors(part.column("v")).astype(float), *(part.column(c).to_pylist() for c in ("id", "label", "lows", "highs")), strict=True):
                        found += [(anchor, n, x, s) for n, x, s in block.search(anchor, label, q, same, lows, highs, k)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["anchor_id", "window", "other_id", "score"])

        visits = queries.mapInArrow(routed, "block int, kind int, id long, label int, v binary, lows array<long>, highs array<long>")
        both = self.dealt.unionByName(visits, allowMissingColumns=True).repartition(self.parts, "block").sortWithinPartitions("block", "kind")
        found = both.mapInArrow(streamed, FOUND)
        order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "other_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def taking_part(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v: whole rows with labels moved on where the id is divisible by seven, components as integers."""
    e = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    return embeddings.where(fine).select("vec_id", label.alias("label"), F.transform(e, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long")).alias("v"))


def mine(embeddings: DataFrame, spark: SparkSession) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores: the first negatives of every anchor and positive."""
    index = Index(taking_part(embeddings), spark)
    anchors = index.rows.where(F.col("vec_id") % ANCHORS == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("a")).select("anchor_id", "a.*")
    anchors, _ = stash(anchors, spark)
    longs = lambda x: F.array(F.lit(x)).cast("array<long>")
    positives = index.search(anchors.select("*", longs(FLOOR).alias("lows"), longs(CEILING).alias("highs")), True, POSITIVES, spark)
    positives, _ = stash(positives.select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), spark)
    # Positives of one score share a window. No score of a window is negative: 50 s <= 95 s.
    wide = F.col("positive_score").cast("decimal(20,0)")
    scores = positives.where("positive_score >= 0").select("anchor_id", "positive_score").distinct()
    scores = scores.withColumn("window", F.row_number().over(Window.partitionBy("anchor_id").orderBy("positive_score")) - 1)
    ends = scores.withColumns({"low": F.call_function("div", F.lit(FROM) * wide + 99, F.lit(100)), "high": F.call_function("div", F.lit(TO) * wide, F.lit(100))})
    windows = ends.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("window", "low", "high"))).alias("w"))
    asked = anchors.join(windows, "anchor_id").select("anchor_id", "label", "v", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    negatives = index.search(asked, False, NEGATIVES, spark).join(scores, ["anchor_id", "window"])
    return positives.join(negatives, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH rows AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::INT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), TRUE)),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id != b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id))::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY rank <= 3
"""
