"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton (operator 8).

Bytes are mapped to Latin-1 characters, so that pyahocorasick can hold the vocabulary. Each piece of the text
is encoded left to right by longest matches. A token may follow another only if the two are compatible: the
merges of their joined bytes give back just these two. Where no token fits, the last one is taken back and a
shorter one is tried; ends from which no way leads on are marked, so none is tried twice. A sequence whose
neighbours are all compatible is the one that the merges produce, so the result equals that of exact merging.

The pattern that splits a text is applied by `regex`. For texts all of whose characters are below U+0250 (or common
punctuation), the usual pattern has an equivalent for the faster `re`; tests hold the two against each other.

Defined results: a null text is an empty one and has no tokens; repeated rows give repeated results; columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once

#: Pieces that a worker remembers. When there are as many, they become the old generation; those of it in use come back.
CACHE = 250_000
#: Pairs that a worker remembers; beyond that it forgets all and starts anew.
PAIRS = 500_000
#: Longer pieces are encoded each time.
CACHED_CHARS = 40

# The pattern of byte-level vocabularies, and its equivalent for texts that PLAIN matches.
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = re.compile(rf" ?[{_L}]++|'(?:[stmd]|re|ve|ll)| ?[{_N}]++| ?[^{_S}{_L}{_N}]++|[{_S}]+(?![^{_S}])|[{_S}]+").findall
PLAIN = re.compile("[\x00-\x1b\x20-\u024f\u2010-\u2027]*+").fullmatch


class Pieces(dict):
    """Results by piece, in two generations."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, piece: str):
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class BytePairCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ids = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.findall, self.usual = regex.compile(pattern).findall, pattern == USUAL
        self.pieces = Pieces(self.encode_piece)
        self.digests = Pieces(self._printed)
        self.pairs: dict[int, bool] = {}
        self.sizes = {i: len(t) for i, t in self.tokens.items()}
        self.shorter = {i: self._prefix(t) for t, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for t, i in self.ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()

    def _prefix(self, token: str) -> int:
        """The longest token that is a proper prefix, or -1."""
        return next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), -1)

    def split(self, text: str) -> list[str]:
        return LATIN(text) if self.usual and PLAIN(text) else self.findall(text)

    def merged(self, text: str) -> list[str]:
        """The merges themselves, lowest rank first and leftmost among equals; for short texts."""
        parts, rank_of, none = list(text), self.ids.get, 1 << 40
        while len(parts) > 1:
            ranks = [rank_of(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            rank = min(ranks)
            if rank == none:
                break
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        one, two = self.tokens[a].decode("latin-1"), self.tokens[b].decode("latin-1")
        known = self.pairs[a << 32 | b] = self.merged(one + two) == [one, two]
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        text = piece.encode("utf-8").decode("latin-1")
        whole = self.ids.get(text)
        if whole is not None:
            return (whole,)
        known, shorter, sizes, size = self.pairs.get, self.shorter, self.sizes, len(text)
        longest = [-1] * (size + 1)
        for end, token in self.automaton.iter(text):  # by rising end, so that the longest from a start comes last
            longest[end - sizes[token] + 1] = token
        out: list[int] = []
        dead = bytearray(size + 1)
        pos, token, last = 0, longest[0], -1
        while pos < size:
            while token >= 0:
                if not dead[pos + sizes[token]]:
                    if last < 0:
                        break
                    fits = known(last << 32 | token)
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos += sizes[token]
                last, token = token, longest[pos]
            else:
                dead[pos] = 1
                out.pop()
                pos -= sizes[last]
                token = shorter[last]
                last = out[-1] if out else -1
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def _printed(self, piece: str) -> tuple[int, str, bytes]:
        ids = self.encode_piece(piece)
        return len(ids), ",".join(map(str, ids)), self.decode(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Token count, sha256 of the decimal ids and of the bytes that they decode to."""
        pieces = self.split(text)
        n, ids, decoded = zip(*map(self.digests.__getitem__, pieces), strict=True) if pieces else ((), (), ())
        return sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()


def codec(path: str, pattern: str) -> BytePairCodec:
    """Read once by each Python worker from the installed vocabulary."""

    def read() -> BytePairCodec:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in lines if line.strip())}
        return BytePairCodec(ranks, pattern)

    return once("bpe", (path, pattern), read)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row per document: token count and digests of its ids and of the decoded bytes. No shuffle."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        c = codec(vocabulary, pattern)
        return pd.DataFrame([c.digest(t or "") for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")


def token_ids(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: what a training run reads."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        c = codec(vocabulary, pattern)
        return pd.Series([c.encode(t or "") for t in texts], dtype="object")

    return docs.select("doc_id", ids("text").alias("ids"))
