"""Token counts by batch encoding in an Arrow function that returns lengths only (operator 11).

A text is cut at safe boundaries, places where the vocabulary's normaliser and its splitting rule cannot join what stands
on both sides: before white space of ASCII, always; inside longer runs without any also before a digit of ASCII, and
between a letter and a full stop, comma or the like. The count of a text is then the sum over its pieces. Pieces that the
worker has not met lately are encoded together, in batches of about the same number of bytes, and only the lengths are
kept. Long texts are cut before anything else, so that what is held at a time does not grow with the longest text.

The boundaries hold for vocabularies that drop white space and take each digit by itself; `Counter` refuses others.
Special strings inside a text count as the library counts them by default.

Defined results: a null text is an empty one, with no bytes and no tokens; repeated rows give repeated results; a run
without any boundary is encoded whole, whatever its length; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import once

#: Bytes of text that are cut into pieces at once.
TEXT_BYTES = 1 << 21
#: Bytes of pieces in a batch that goes to the library.
BATCH_BYTES = 1 << 18
#: Words whose counts a worker remembers, in each of two generations, and the longest of them, in bytes.
KNOWN, KNOWN_BYTES = 300_000, 48
#: Runs without white space are cut further where they are longer than this.
RUN_BYTES = 512

_SPACE = re.compile(rb"[\t-\r ]")
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_INSIDE = re.compile("(?=[0-9])|(?<=[A-Za-zぁ-ゖァ-ヺ一-鿿])(?=[,.;:!?、。！，？])")


def stretches(text: bytes, size: int = TEXT_BYTES) -> Iterator[bytes]:
    """The text in parts of about that many bytes, each but the first beginning with white space."""
    start = 0
    while len(text) - start > size and (m := _SPACE.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def runs(word: bytes, size: int = RUN_BYTES) -> Iterator[str]:
    """A run without white space in parts of about that many characters, cut where nothing joins across."""
    text, start = word.decode(), 0
    while len(text) - start > size and (m := _INSIDE.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def plainer(word: bytes) -> tuple[bytes, ...]:
    """Words with the same count together: what is written in ASCII goes to lower case, closing marks go apart."""
    base = word.rstrip(b".,;:!?*%$&#")
    cut = 0 < len(base) < len(word) and base[-1:].isalpha()
    parts = (base, word[len(base) :]) if cut else (word,)
    if parts[0].isascii() and b"<|" not in word:
        parts = (parts[0].lower(), *parts[1:])
    return parts


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split = json.dumps(rules["pre_tokenizer"])
        if r"|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" not in split or '"invert": true' not in split or rules["post_processor"] or any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in rules["added_tokens"]):
            raise ValueError("texts of this vocabulary have other safe boundaries")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work; a worker keeps to one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.long: list[bytes] = []
        # Words of small Latin letters are what normalising and splitting would make of them; the rest of the way is the same.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer, self.letters.pre_tokenizer = None, ByteLevel(add_prefix_space=False, use_regex=False)

    def learn(self, words: Iterable[bytes]) -> None:
        """Counts for words that are not known, no word twice. What the last generation knew is taken over."""
        letters, others, made, known, old = [], set(), [], self.known, self.old
        for word in words:
            if (n := old.get(word)) is not None:
                known[word] = n
            elif _LETTERS(word):
                letters.append(word)
            else:
                made.append((word, parts := plainer(word)))
                others.update(parts)
        for p in others.difference(known, letters):
            if (n := old.get(p)) is not None:
                known[p] = n
            elif _LETTERS(p):
                letters.append(p)
            else:
                known[p] = -1
        self._encode(self.letters, letters)
        self._encode(self.tokenizer, unmet := [p for p in others if known[p] < 0])
        for word, parts in made:
            known[word] = sum(map(known.__getitem__, parts))
        self.long += [w for part in (letters, unmet) for w in part if len(w) > KNOWN_BYTES]

    def _encode(self, library: Tokenizer, words: list[bytes]) -> None:
        """Batches of whole words, balanced by bytes; the longest words are cut and have batches of their own."""
        short = [w for w in words if len(w) <= RUN_BYTES]
        size = np.cumsum(np.fromiter(map(len, short), np.int64, len(short)))
        ends = np.searchsorted(size, np.arange(BATCH_BYTES, (size[-1] if short else 0) + BATCH_BYTES, BATCH_BYTES), "right")
        for start, end in pairwise((0, *ends.tolist())):
            batch = short[start:end]
            self.known.update(zip(batch, self._lengths(library, [w.decode() for w in batch]), strict=True))
        for word in words:
            if len(word) > RUN_BYTES:
                self.known[word], batch, held = 0, [], 0
                for part in runs(word):
                    batch.append(part)
                    held += len(part)
                    if held >= BATCH_BYTES:
                        self.known[word] += sum(self._lengths(library, batch))
                        batch, held = [], 0
                self.known[word] += sum(self._lengths(library, batch))

    def _lengths(self, library: Tokenizer, batch: list[str]) -> Iterable[int]:
        return map(len, library.encode_batch_fast(batch, add_special_tokens=False))

    def counts(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text; texts hold about TEXT_BYTES together."""
        words = [t.split() for t in texts]
        new = set().union(*words).difference(self.known)
        self.learn(new)
        out = [sum(map(self.known.__getitem__, w)) for w in words]
        for w in [*self.long, *(w for w in new if len(w) > KNOWN_BYTES)]:
            self.known.pop(w, None)
        self.long = []
        if len(self.known) > KNOWN:
            self.old, self.known = self.known, {}
        return out


def counter(path: str) -> Counter:
    return once("token counts", path, lambda: Counter(path))


def count_texts(c: Counter, texts: pa.Array) -> list[int]:
    """Tokens of each text of a column, cut and dealt into batches by bytes."""
    out, batch, rows, held = [0] * len(texts), [], [], 0

    def flush() -> None:
        for row, n in zip(rows, c.counts(batch), strict=True):
            out[row] += n

    for row, text in enumerate(texts.cast(pa.large_binary())):
        for part in stretches(text.as_py() or b""):
            batch.append(part)
            rows.append(row)
            held += len(part)
            if held >= TEXT_BYTES:
                flush()
                batch, rows, held = [], [], 0
    flush()
    return out


def token_counts(docs: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each document. No shuffle; texts stay where they are read."""

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array(count_texts(counter(vocabulary), texts), pa.int64())

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
