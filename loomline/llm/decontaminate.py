"""Benchmark passages in documents, by CGK embedding and bit-sampling LSH over item-sized windows (operator 3).

A text is its lower-case letters and digits, all else one space. The CGK embedding walks along it: at each step it puts
out the character it stands on and, by a random bit of that character and step, moves on or stays, so that two texts a
few edits apart fall into step again and differ in few places. An LSH key is the embedding at randomly sampled places,
anew for each repetition. A window is as long as an item. It has a walk from each of its anchors, the places whose next
GRAM characters have a small hash: one walk over a whole window would, at one edit in five characters, hardly ever be
in step (see the README). The windows of a document that share keys from enough anchors with an item, at about the
same distance from each other, are checked exactly: the least edit distance in characters between the item and any
part of the passage there, by bit-parallel dynamic programming. Before that, passages go that have fewer runs of RUN
characters of the item than so many edits must leave whole, and those whose distances from the parts of a long item,
of a word of the machine each, add up to more.

Items of fewer than SHORT characters or of too few anchors are looked up by their parts instead: of an item with at most k edits,
cut into k + 1 parts, one part is whole. Short ones must begin and end with words.

Distinct items go to every task in blocks of about CHARS characters, one pass over the documents for each; a benchmark
of any size has the same results. Long documents are scanned in overlapping pieces.

Defined results: null or empty texts and items match nothing; repeated rows give repeated results, repeated items one
row each; rows and items without an id are reported without one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, once, stash

#: Characters that make an anchor, and the share of places that are one.
GRAM, DENSITY = 4, 1 / 3
#: Steps of a walk, the places of the embedding that a key samples, and the repetitions.
STEPS, SAMPLED, REPEATS = 24, 13, 3
#: Least share of an item's anchors that must agree before it is checked, and least number.
SHARE, AGREE = 0.06, 3
#: Characters from which an item needs two anchors that agree, and three: at one edit in five a short item has few that do.
ONE, TWO = 96, 128
#: Least similarity, 1 - distance / characters of the item.
SIMILARITY = 0.8
#: Characters of an item that is looked up by its parts, and anchors that an item must have else.
SHORT, ANCHORS = 56, 10
#: Characters of items in a block (one item at least).
CHARS = 2_000_000
#: Characters scanned at once, pairs whose distances are taken at once, their characters, and those of an item up to which they are.
PIECE, TOGETHER, CELLS, LONG = 1_000_000, 4096, 4_000_000, 2000
#: Characters of the runs that are counted in a passage before its distance is taken, cells in which they are, passages at once.
RUN, COUNTS, COUNTED = 3, 2048, 1024
#: Pairs that wait before their distances are taken.
WAITING = 8192

_rng = np.random.default_rng(20240)
#: Whether the walk moves on, by repetition, step and character (folded to a byte); never past the end of a text.
_MOVES = _rng.integers(0, 2, (REPEATS, STEPS, 256)).astype(np.int32)
_MOVES[:, :, 0] = 0
_PLACES = [{0, *(_rng.permutation(STEPS - 1)[: SAMPLED - 1] + 1).tolist()} for _ in range(REPEATS)]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_PLAIN = bytes(b if chr(b).isalnum() and b < 128 else 32 for b in range(128)) + bytes(range(128, 256))
_OTHER = re.compile(r"[^\w\x00-\x7f]+")


def plain(text: str | None) -> str:
    """Lower-case letters and digits with single spaces between them."""
    low = (text or "").lower()
    if low.isascii():
        return b" ".join(low.encode().translate(_PLAIN).split()).decode()
    low = _OTHER.sub(" ", low)
    return b" ".join(low.encode("utf-8", "surrogatepass").translate(_PLAIN).split()).decode("utf-8", "surrogatepass")


def codes(text: str) -> np.ndarray:
    """A byte for each character; zero for NUL only, which stands between texts."""
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(wide < 256, wide, (wide ^ wide >> 7) % 255 + 1).astype(np.uint8)


def anchors(c: np.ndarray) -> np.ndarray:
    if len(c) < GRAM:
        return np.zeros(0, np.int32)
    wide = c.astype(np.uint32)
    h = wide[: len(c) - GRAM + 1].copy()
    for k in range(1, GRAM):
        h *= np.uint32(1_000_003)
        h += wide[k : len(c) - GRAM + 1 + k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return np.flatnonzero(h < np.uint32(DENSITY * (1 << 32))).astype(np.int32)


def runs(c: np.ndarray) -> np.ndarray:
    """The cell of each run of RUN characters."""
    n = max(0, len(c) - RUN + 1)
    h = np.zeros(n, np.uint32)
    for k in range(RUN):
        h *= np.uint32(1_000_003)
        h += c[k : k + n]
    return (h * np.uint32(0x9E3779B1) >> np.uint32(33 - COUNTS.bit_length())).astype(np.int64)


def keys(c: np.ndarray, at: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """The LSH keys of the walks from `at`, and where the walks end. c ends with a zero."""
    pos = at.astype(np.intp)
    key = np.full(len(at), 1009 + repeat, np.uint64)
    for step in range(STEPS):
        here = c.take(pos)
        if step in _PLACES[repeat]:
            key *= np.uint64(0x100000001B3)
            key += here
        pos += _MOVES[repeat, step].take(here)
    key *= _MIX
    return key ^ key >> np.uint64(29), pos


def distance(item: str, passage: str, most: int) -> tuple[int, int]:
    """Least edit distance between item and any part of passage, and where that part ends; most + 1 if it is more."""
    size = len(item)
    if (at := passage.find(item)) >= 0:
        return 0, at + size
    mask, top = (1 << size) - 1, 1 << (size - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = mask, 0, size
    best, end = (size, 0) if size <= most else (most + 1, 0)
    for j, c in enumerate(passage, 1):
        eq = where.get(c, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(diag | up) & mask
        minus = up & diag
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1, minus << 1
        up = (minus | ~(diag | down | plus)) & mask
        down = plus & diag & mask
        if score < best:
            best, end = score, j
    return best, end


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def hopeless(pairs: list[tuple[str, str, int]]) -> set[int]:
    """Of (item, passage, most) those whose item is too far by its parts of 64 characters, the last part left out."""
    spent = dict.fromkeys((k for k, (item, *_) in enumerate(pairs) if 64 < len(item) <= LONG), 0)
    out: set[int] = set()
    at = 0
    while spent:
        parts = [(pairs[k][0][at : at + 64], pairs[k][1], pairs[k][2] - n) for k, n in spent.items()]
        now = {k: n + d for (k, n), (d, _) in zip(spent.items(), distances(parts), strict=True)}
        out.update(k for k, n in now.items() if n > pairs[k][2])
        at += 64
        spent = {k: n for k, n in now.items() if n <= pairs[k][2] and at + 64 < len(pairs[k][0])}
    return out


def distances(pairs: list[tuple[str, str, int]]) -> list[tuple[int, int]]:
    """distance() of many (item, passage, most) at once: the same bits, in words of 64, of all pairs of a group.

    An item's last character stands at the last bit. The bits before its first match every character and cost nothing.
    Pairs of items over LONG characters are left to distance().
    """
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    left = []
    far = hopeless(pairs)
    for k, (item, passage, most) in enumerate(pairs):
        if k in far:
            out[k] = most + 1, 0
        elif len(item) > LONG or item in passage:
            out[k] = distance(item, passage, most)
        else:
            left.append(k)
    left.sort(key=lambda k: (-(-len(pairs[k][0]) // 64), len(pairs[k][1])))
    one, high = np.uint64(1), np.uint64(63)
    done = 0
    while done < len(left):
        longest = max(len(pairs[k][1]) for k in left[done : done + TOGETHER])
        group = left[done : done + max(256, min(TOGETHER, CELLS // longest))]
        done += len(group)
        items = {t: j for j, t in enumerate(dict.fromkeys(pairs[k][0] for k in group))}
        words = -(-max(map(len, items)) // 64)
        letters, ids = np.unique(points("".join(items)), return_inverse=True)
        size = np.array([len(t) for t in items])
        row = np.repeat(np.arange(len(items)), size)
        at = np.arange(len(ids)) + np.repeat(64 * words - np.cumsum(size), size)  # of each character, its bit
        whole = np.zeros((words, len(items)), np.uint64)
        np.bitwise_or.at(whole, (at // 64, row), one << (at % 64).astype(np.uint64))
        match = np.repeat(~whole[:, :, None], len(letters) + 1, 2)
        np.bitwise_or.at(match, (at // 64, row, ids + 1), one << (at % 64).astype(np.uint64))
        which = np.array([items[pairs[k][0]] for k in group])
        lengths = np.array([len(pairs[k][1]) for k in group])
        text = points("".join(pairs[k][1] for k in group))
        near = np.minimum(np.searchsorted(letters, text), len(letters) - 1)
        seen = np.zeros((lengths.max(initial=0), len(group)), np.int32)
        lane = np.repeat(np.arange(len(group)), lengths)
        seen[np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths), lane] = np.where(letters[near] == text, near + 1, 0)
        up, down = list(whole[:, which]), [np.zeros(len(group), np.uint64) for _ in range(words)]
        score, most = (np.array(x) for x in zip(*((len(pairs[k][0]), pairs[k][2]) for k in group), strict=True))
        best, end = score.copy(), np.zeros(len(group), np.int64)
        for j in range(len(seen)):
            eqs = match[:, which, seen[j]]
            carry = more = less = np.zeros(len(group), np.uint64)
            for w in range(words):
                eq, u, d = eqs[w], up[w], down[w]
                x = eq & u
                total = x + u
                over = total < x
                total = total + carry
                carry = (over | (total < carry)).astype(np.uint64)
                diag = total ^ u | eq | d
                plus, minus = d | ~(diag | u), u & diag
                shifted, lowered = plus << one | more, minus << one | less
                more, less = plus >> high, minus >> high
                up[w], down[w] = lowered | ~(diag | shifted), shifted & diag
            score = score + more.astype(np.int64) - less.astype(np.int64)
            better = (score < best) & (j < lengths)
            if better.any():
                best[better], end[better] = score[better], j + 1
            # Each character left takes one off a distance at most.
            if j % 8 == 7 and (np.minimum(best, score - np.maximum(lengths - j - 1, 0)) > most).all():
                break
        for j, k in enumerate(group):
            out[k] = (int(best[j]), int(end[j])) if best[j] <= pairs[k][2] else (pairs[k][2] + 1, 0)
    return out


class Items:
    """Anchors and keys of distinct benchmark items; rows: (name, text)."""

    def __init__(self, rows: list[tuple[object, str | None]], similarity: float = SIMILARITY):
        self.rows = [(name, t) for name, text in rows if (t := plain(text))]
        size = [len(t) for _, t in self.rows]
        self.most = [int((1 - similarity) * n + 1e-9) for n in size]
        self.longest = max(size, default=0)
        self.least = np.zeros(len(size), np.int64)  # anchors that must agree
        self.parts: dict[str, list[tuple[int, int]]] = {}  # of short items: item and offset
        found: list[list[np.ndarray]] = [[] for _ in range(REPEATS)]
        for k, (_, t) in enumerate(self.rows):
            c = np.r_[codes(t), np.uint8(0)]
            at = anchors(c[:-1])
            walks = [keys(c, at, r) for r in range(REPEATS)]
            whole = sum(int((end < size[k]).sum()) for _, end in walks) // REPEATS
            if size[k] < SHORT or whole < ANCHORS:
                self._cut(k)
                continue
            self.least[k] = max(min(AGREE, 1 + int(size[k] >= ONE) + int(size[k] >= TWO)), int(SHARE * whole))
            for r, (key, end) in enumerate(walks):
                own = end < size[k]
                found[r].append(np.c_[key[own].view(np.int64), np.full(own.sum(), k), at[own]])
        self.keys: list[np.ndarray] = []
        self.hits: list[np.ndarray] = []
        self.bits = np.zeros((REPEATS, 1 << _BITS), bool)
        for r in range(REPEATS):
            rows_ = np.concatenate(found[r]) if found[r] else np.zeros((0, 3), np.int64)
            key = rows_[:, 0].view(np.uint64)
            order = np.argsort(key, kind="stable")
            self.keys.append(key[order])
            self.hits.append(rows_[order, 1:].astype(np.int32))
            self.bits[r][(key >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.any = any(len(k) for k in self.keys)
        # An edit changes RUN of an item's runs at most.
        self.runs = [runs(codes(self.text(k))).astype(np.int16) for k in range(len(size))]
        self.kept = np.array([len(r) - RUN * m for r, m in zip(self.runs, self.most, strict=True)], np.int64)

    def likely(self, run: np.ndarray, spans: list[tuple[int, int, range]]) -> np.ndarray:
        """Whether each passage (piece, item, place) has as many of the item's runs, each as often, as the edits allowed must leave."""
        item, begin, stop = np.array([(k, s.start, s.stop) for _, k, s in spans], np.int64).T
        shared = np.zeros(len(spans), np.int64)
        for x in range(0, len(spans), COUNTED):
            some, which = np.unique(item[x : x + COUNTED], return_inverse=True)
            own = [self.runs[k] for k in some]
            there = np.concatenate(own) + np.repeat(np.arange(len(some)) * COUNTS, [len(r) for r in own])
            start = begin[x : x + COUNTED]
            n = np.maximum(stop[x : x + COUNTED] - start - RUN + 1, 0)
            at = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)
            here = run[at] + np.repeat(np.arange(len(n)) * COUNTS, n)
            counts = [np.bincount(c, minlength=rows * COUNTS).reshape(rows, COUNTS).astype(np.int32) for c, rows in ((there, len(some)), (here, len(n)))]
            shared[x : x + COUNTED] = np.minimum(counts[0][which], counts[1]).sum(1)
        return shared >= self.kept[item]

    def text(self, k: int) -> str:
        """The item as it is compared: short ones with the spaces around their words."""
        t = self.rows[k][1]
        return f" {t} " if len(t) < SHORT else t

    def _cut(self, k: int) -> None:
        t, n = self.text(k), self.most[k] + 1
        edges = [len(t) * i // n for i in range(n + 1)]
        for a, b in zip(edges, edges[1:], strict=False):
            self.parts.setdefault(t[a:b], []).append((k, a))

    def windows(self, joined: str, c: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, low, high) of windows to check: low and high are where the item may start. first: of each text."""
        if self.any:
            at = anchors(c)
            hits = []
            wide = (len(c) + 2 * self.longest).bit_length()  # of a start, moved up by the longest item
            for r in range(REPEATS):
                key, _ = keys(c, at, r)
                near = np.flatnonzero(self.bits[r][(key >> np.uint64(64 - _BITS)).astype(np.int64)])
                got = key[near]
                low = np.searchsorted(self.keys[r], got, "left")
                n = np.searchsorted(self.keys[r], got, "right") - low
                pick = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
                item, offset = self.hits[r][pick].T.astype(np.int64)
                place = np.repeat(at[near].astype(np.int64), n)
                hits.append(((item << wide) + place - offset + self.longest << wide) + place)
            rows = np.concatenate(hits)
            rows.sort()
            rows = rows[np.diff(rows, prepend=-1) != 0]  # an anchor's hits of several repetitions are one
            place, start = rows & ((1 << wide) - 1), (rows >> wide & ((1 << wide) - 1)) - self.longest
            yield from self._agreeing(rows >> 2 * wide, start, place, first)
        for part, owners in self.parts.items():
            at_ = joined.find(part)
            while at_ >= 0:
                d = int(np.searchsorted(first, at_, "right")) - 1
                for k, offset in owners:
                    yield d, k, at_ - offset, at_ - offset
                at_ = joined.find(part, at_ + 1)

    def _agreeing(self, item: np.ndarray, start: np.ndarray, place: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Windows of hits of one item, sorted by start: in one text, starts within the edits allowed, enough anchors."""
        text = np.searchsorted(first, place, "right") - 1
        most = np.array([*self.most, 0], np.int64)[item]
        # In one order of (item, start), how many hits come no further than the edits allowed after each.
        line = item * (int(place.max(initial=0)) + 4 * self.longest + 2) + start + self.longest
        after = np.searchsorted(line, line + most, "right")
        full = np.flatnonzero(after - np.arange(len(line)) >= self.least[item]) if len(line) else np.zeros(0, np.int64)
        # Windows that overlap, of one item and text, are one passage to check.
        new = np.r_[True, (full[1:] >= after[full[:-1]]) | (item[full[1:]] != item[full[:-1]]) | (text[full[1:]] != text[full[:-1]])] if len(full) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        for a, b in zip(full[begin].tolist(), after[full[np.r_[begin[1:], len(full)] - 1]].tolist() if len(full) else [], strict=True):
            yield int(text[a]), int(item[a]), int(start[a]), int(start[b - 1])

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(row, item, distance, end in the plain text) of the best match of each text and item."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        lap = 2 * self.longest + 2 * STEPS
        step = max(PIECE, lap)
        pairs: list[tuple[str, str, int]] = []
        where: list[tuple[int, int, int]] = []  # row, item, and where the passage starts

        def settle() -> None:
            for (row, k, start), (got, end) in zip(where, distances(pairs), strict=True):
                best[row, k] = min(best.get((row, k), (got, start + end)), (got, start + end))
            pairs.clear()
            where.clear()

        for x, y in chunks([t or "" for t in texts], PIECE):
            pieces: list[tuple[int, int, str]] = []
            for row in range(x, y):
                t = f" {plain(texts[row])} "
                pieces += [(row, a, t[a : a + step + lap]) for a in range(0, max(1, len(t) - lap), step)]
            for row, k, start, passage in self._passages(pieces):
                pairs.append((self.text(k), passage, self.most[k]))
                where.append((row, k, start))
            if len(pairs) >= WAITING:
                settle()
        settle()
        return [(row, k, got, end) for (row, k), (got, end) in sorted(best.items()) if got <= self.most[k]]

    def _passages(self, pieces: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, int, str]]:
        """(row, item, start, text) of what may hold an item, of pieces (row, place, text)."""
        for a, b in chunks([p for *_, p in pieces], PIECE):
            joined = "\0".join(p for *_, p in pieces[a:b]) + "\0"
            ends = np.cumsum([len(p) + 1 for *_, p in pieces[a:b]])
            first = np.r_[0, ends[:-1]]
            c = codes(joined)
            run = runs(c)
            spans: list[tuple[int, int, range]] = []  # piece, item, and the passage's place
            for d, k, low, high in self.windows(joined, c, first):
                most = self.most[k]
                reach = len(self.text(k)) + most  # no match is longer; long passages are cut, each match is whole in one part
                begin, stop = max(low - most, int(first[d])), min(high + reach, int(ends[d]) - 1)
                for at in range(begin, max(begin + 1, stop - reach), 2 * reach):
                    spans.append((d, k, range(at, min(at + 3 * reach, stop))))
            for x, y in chunks([s for *_, s in spans], CELLS):
                for (d, k, s), take in zip(spans[x:y], self.likely(run, spans[x:y]).tolist(), strict=True):
                    if take:
                        row, offset, _ = pieces[a + d]
                        yield row, k, offset + s.start - int(first[d]) - 1, joined[s.start : s.stop]


FOUND = "name string, distance int, similarity double, end_char long"


def blocks(benchmark: DataFrame, chars: int) -> Iterator[list[tuple[str, str]]]:
    """The distinct texts of a benchmark with their digests, dealt by digest into blocks of about so many characters."""
    spark = benchmark.sparkSession
    texts, _ = stash(benchmark.where("text IS NOT NULL").select(F.md5("text").alias("name"), "text").distinct(), spark)
    n = -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // chars) or 1
    for k in range(n):
        yield [tuple(r) for r in texts.where(F.pmod(F.xxhash64("name"), F.lit(n)) == k).orderBy("name").collect()]


def found_in(docs: DataFrame, similarity: float, block: list[tuple[str, str]]) -> DataFrame:
    """doc_id and what each document holds of a block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(Items(block, similarity))

    @F.pandas_udf(f"array<struct<{FOUND.replace(' ', ':').replace(',:', ',')}>>")
    def run(texts: pd.Series) -> pd.Series:
        once("decontaminate")
        items = sent.value
        out: list[list[dict]] = [[] for _ in texts]
        for row, k, d, end in items.scan(texts.tolist()):
            out[row].append({"name": items.rows[k][0], "distance": d, "similarity": 1 - d / len(items.rows[k][1]), "end_char": end})
        return pd.Series(out, dtype="object")

    return docs.select("doc_id", F.explode(run("text")).alias("m")).select("doc_id", "m.*")


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, chars: int = CHARS) -> DataFrame:
    """doc_id, item_id, distance, similarity and end_char (in the plain text) of each benchmark item found in a document."""
    found = reduce(DataFrame.union, map(partial(found_in, docs, similarity), blocks(benchmark, chars)))
    ids = benchmark.select("item_id", F.md5("text").alias("of"))
    return found.join(ids, found.name == ids.of).select("doc_id", "item_id", "distance", "similarity", "end_char")


def leaking(docs: DataFrame, similarity: float, block: list[tuple[str, str]]):
    """A column function: whether a text holds an item of a block."""
    sent = docs.sparkSession.sparkContext.broadcast(Items(block, similarity))

    @F.pandas_udf("boolean")
    def leaked(texts: pd.Series) -> pd.Series:
        once("decontaminate")
        hit = np.zeros(len(texts), bool)
        hit[[row for row, *_ in sent.value.scan(texts.tolist())]] = True
        return pd.Series(hit)

    return leaked


def clean_filter(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, chars: int = CHARS) -> DataFrame:
    """The documents that hold no benchmark item, all columns kept. With one block of items no document is shuffled."""
    tests = [leaking(docs, similarity, b) for b in blocks(benchmark, chars)]
    if len(tests) == 1:
        return docs.where(~tests[0](F.col("text")))
    bad = reduce(DataFrame.union, (docs.where(t(F.col("text"))).select(F.md5("text").alias("bad")) for t in tests)).distinct()
    bad, _ = stash(bad, docs.sparkSession)
    return docs.join(bad, F.md5(docs.text) == bad.bad, "left_anti")
