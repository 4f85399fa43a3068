"""Document fingerprints from closed syncmers (operator 4).

Of each run of K characters (code points), the hashes of its inner runs of S characters are compared. The run is a
closed syncmer if the least of them stands first or last. Whether it is depends on these K characters alone, so that
equal passages have the same anchors in any text, at the same distances from each other.

A fingerprint is a one-permutation min-hash of a text's syncmers: BINS least values by the leading bits, empty bins
filled from the next one that is not, 16 bits kept of each, and the rank of its anchor's (first) position among them.
Likeness matches positions: of the bins whose values are equal, as many as stand in one order in both texts (the longest
run of ranks that never falls), as a share of all.

`edited_fingerprints` deals the texts out by ranges of (doc_id, digest) once and reads the next document on the way, so
that each text is shuffled and fingerprinted once. Only the documents of each range's last id wait for the next range's
first; a range gives the first document of each of its first two ids for that.

Defined results: a text without a syncmer (shorter than K, mostly) is one anchor itself; a null or empty text has
the fingerprint of all zeros, like another empty text only. In `edited_fingerprints`, a null id has no next document
and its edited text ends where the cut is; of repeated ids the next document is the text of least SHA-256; repeated rows
give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import stash

K, S, BINS = 16, 8, 64
_P = [np.uint64(pow(0x100000001B3, n, 1 << 64)) for n in range(K)]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def syncmers(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of a text."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    if len(codes) < K:
        return (np.zeros(1, np.int64), np.array([xxh64_intdigest(codes.tobytes())], np.uint64)) if len(codes) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    h = _mixed(codes.astype(np.uint64) + np.uint64(1))
    for n in (1, 2, 4):
        h = h[:-n] * _P[n] + h[n:]
    inner, whole = _mixed(h), _mixed(h[:-S] * _P[S] + h[S:])
    span = K - S + 1
    least, width = inner, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(whole)], least[span - width :][: len(whole)])
    at = np.flatnonzero((inner[: len(whole)] == least) | (inner[span - 1 :] == least))
    return at, whole[at]


def sketch(at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """BINS values of 16 bits and the ranks of their positions, two rows; zeros only for no hashes."""
    if not len(hashes):
        return np.zeros((2, BINS), np.uint16)
    order = np.lexsort((at, hashes))
    of, first = np.unique((hashes[order] >> np.uint64(58)).astype(np.int64), return_index=True)
    least = order[first]
    source = np.searchsorted(of, np.arange(BINS)) % len(of)  # of an empty bin, the next full one
    far = (of[source] - np.arange(BINS)) % BINS
    values = _mixed(hashes[least[source]] + far.astype(np.uint64) * _MIX)
    ranks = np.unique(at[least[source]], return_inverse=True)[1]
    return np.stack([((values >> np.uint64(48)) | np.uint64(1)).astype(np.uint16), ranks.astype(np.uint16)])


def fingerprint(text: str | None) -> np.ndarray:
    return sketch(*syncmers(text))


def printed(a: np.ndarray) -> str:
    """Four hex digits of each value, then two of each rank."""
    return a[0].astype(">u2").tobytes().hex() + a[1].astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    same = a[0] == b[0]
    if not same.any():
        return 0.0
    x, y = a[1][same], b[1][same]
    run: list[int] = []
    for r in y[np.lexsort((y, x))].tolist():
        k = bisect_right(run, r)
        run[k : k + 1] = [r]
    return len(run) / BINS


def anchor_rows(docs: DataFrame) -> DataFrame:
    """doc_id, position and hash of each closed syncmer, for positional matching."""

    @F.pandas_udf("array<struct<position:long,hash:long>>")
    def run(texts: pd.Series) -> pd.Series:
        found = (syncmers(t) for t in texts)
        return pd.Series([[{"position": int(p), "hash": int(v)} for p, v in zip(at, h.view(np.int64), strict=True)] for at, h in found], dtype="object")

    return docs.select("doc_id", F.explode(run("text")).alias("a")).select("doc_id", "a.*")


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Results, or (waits) a text whose next document is in another range, or (heads) a document that others may wait for.
DEALT = f"doc_id long, kind string, text string, {RESULT}"


def _result(text: str, own: np.ndarray, head: str, then: np.ndarray | None) -> tuple:
    cut = len(text) // 4
    edited = text[: len(text) - cut] + head[:cut]
    new = own if edited == text else fingerprint(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), sha, printed(own), printed(new), likeness(own, new), likeness(own, then) if then is not None else 0.0


def _range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The documents of one range in order: results of all but those of its last id."""
    none = [None] * 6
    ids, last, waiting, early, done = 0, None, [], False, []
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
            own = fingerprint(text)
            if doc_id != last:
                ids += 1
                done += [(last, "done", None, *_result(t, p, text, own)) for t, p in waiting]
                if ids < 3 or early:
                    done.append((doc_id, "head", text, *none))
                last, waiting, early = doc_id, [], False
            waiting.append((text, own))
            if len(waiting) > 256:  # an id on many rows: they wait as rows of the result, not in memory
                done += [(last, "waits", t, *none) for t, _ in waiting]
                waiting, early = [], True
            if len(done) > 512:
                yield _rows(done)
                done = []
    yield _rows(done + [(last, "waits", t, *none) for t, _ in waiting])


def _rows(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in DEALT.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"doc_id": "int64", "n_chars": "Int64"})


def edited_fingerprints(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter comes from the start of the next document."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", F.sha2("text", 256)]
    # Digits of hashes repeat nothing: only a codec with an entropy coder (snappy has none) halves them.
    dealt, _ = stash(texts.where("doc_id IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_range, DEALT), spark, compression="zstd")
    heads = dealt.where("kind = 'head'").groupBy("doc_id").agg(F.min_by("text", F.sha2("text", 256)).alias("head"))
    # Of each id that waits the next head; two ids a range at most, so that the window has few rows.
    ids = heads.select("doc_id", F.col("doc_id").alias("at")).union(dealt.where("kind = 'waits'").select("doc_id", F.lit(None).cast("long")).distinct())
    ids = ids.groupBy("doc_id").agg(F.max("at").alias("at"))
    after = F.min("at").over(Window.orderBy("doc_id").rowsBetween(1, Window.unboundedFollowing))
    turn = ids.select("doc_id", F.coalesce(after, F.min("at").over(Window.partitionBy(F.lit(0)))).alias("next_id"))
    turn = turn.join(heads.withColumnRenamed("doc_id", "next_id"), "next_id").select("doc_id", "head")

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series, heads: pd.Series) -> pd.DataFrame:
        known: dict[str | None, np.ndarray | None] = {None: None}
        rows = []
        for text, head in zip(texts, heads, strict=True):
            if head not in known:
                known = {None: None, head: fingerprint(head)}
            rows.append(_result(text, fingerprint(text), head or "", known[head]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    waits = dealt.where("kind = 'waits'").select("doc_id", "text").join(turn, "doc_id")
    alone = texts.where("doc_id IS NULL").withColumn("head", F.lit(None).cast("string"))
    late = waits.union(alone).select("doc_id", run("text", "head").alias("r")).select("doc_id", "r.*")
    return dealt.where("kind = 'done'").select(*late.columns).union(late)
