"""Operators 11 and 13 against the library and a plain count, and their defined results for odd rows."""

import random

import duckdb
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomline.llm import divergence, queries, token_counts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_bytes string, term string"
# Words, marks, digits, letters that other letters join, white space of all kinds, and special strings.
ALPHABET = ["a", "B", "é", "é", "漢", "。", "、", " ", "  ", "\n", "\x0b", "\x1c", "\xa0", "\x85", "'s", "'", "'LL", "12", "½", "٣", "the", "ing", "🙂", "!!", ".", ",", "A", "J̌", "<|endoftext|>", "<|startoftext|>", "<|END", "<|", "_", "Σ", "σ", "İ", "̸", "=", "<", "ǅ", "ﬁ", "ᄀ", "ᅡ", "가", "か", "゙", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.COUNTED)


def test_counts_equal_library(library):
    rng = random.Random(11)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    want = [len(library.encode(t, add_special_tokens=False)) for t in texts]
    c = token_counts.Counter(queries.COUNTED)
    assert token_counts.count_texts(c, pa.array(texts)) == want
    assert token_counts.count_texts(c, pa.array(texts)) == want  # what is remembered counts alike


def test_counts_cut_anywhere(library, monkeypatch):
    rng = random.Random(12)
    for name, value in (("TEXT_BYTES", 12), ("BATCH_BYTES", 6), ("RUN_BYTES", 3), ("KNOWN", 5), ("KNOWN_BYTES", 4)):
        monkeypatch.setattr(token_counts, name, value)
    monkeypatch.setattr(token_counts.stretches, "__defaults__", (12,))
    monkeypatch.setattr(token_counts.runs, "__defaults__", (3,))
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    assert any(len(list(token_counts.stretches(t.encode()))) > 1 for t in texts) and any(len(list(token_counts.runs(t.encode()))) > 1 for t in texts)
    got = token_counts.count_texts(token_counts.Counter(queries.COUNTED), pa.array(texts))
    assert got == [len(library.encode(t, add_special_tokens=False)) for t in texts]


def test_counts_of_long_texts(library):
    texts = ["word " * 600_000, "漢字。" * 20_000, "1234567890" * 5000, "a" * 20_000, ("x" * 700 + "\n") * 300, "", None]
    want = [len(library.encode(t or "", add_special_tokens=False)) for t in texts]
    assert token_counts.count_texts(token_counts.Counter(queries.COUNTED), pa.array(texts)) == want


def test_counts_of_odd_rows(spark, library):
    rows = [(1, "a b", "", "", None, None), (1, "a b", "", "", None, None), (2, None, None, None, "x", "y"), (3, "", "", "", "", ""), (None, "héllo wörld", "de", "s", "", ""), (4, "é" * 3000, "x", "y", "", "")]
    out = token_counts.token_counts(spark.createDataFrame(rows, SCHEMA), queries.COUNTED, 2048)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = lambda t: len(library.encode(t or "", add_special_tokens=False))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((r[0], len((r[1] or "").encode()), n(r[1]), n(r[1]) > 2048)) for r in rows)
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), queries.COUNTED, 2048).collect() == []


def test_counts_of_the_table(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_token_counts(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in docs.items()}


def test_counts_refuse_other_rules():
    import public_tokenizers as P

    with pytest.raises(ValueError, match="safe boundaries"):
        token_counts.Counter(P.path("byte_bpe_50k.json"))


def sql_rows(frame, sql):
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    return sorted(con.execute(sql).fetchall())


def audited(docs, spark, **more):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.audit(docs, spark, **more).collect())


def test_divergence_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = audited(docs, spark)
    assert got == sql_rows(docs, divergence.SQL) and {r[2] for r in got} == {"pair", "term"}


@pytest.mark.parametrize("block, side, held", [(3000, 2, 1), (divergence.BLOCK, 3, 2)])
def test_divergence_in_small_blocks(spark, monkeypatch, block, side, held):
    monkeypatch.setattr(divergence, "SIDE", side)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(13)
    words = ["a", "B", "b", "é", "漢 字", "x1y", "_", "Z", "zz", "", "W" * 300]
    rows = [(rng.choice([None, i, 7]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) if rng.random() > 0.1 else None, rng.choice(["en", "de", None, "xx"]), rng.choice(["s1", "s2", None, "s4", "S", "é", "s1"]), "n", "t") for i in range(1500)]
    rows += [(1, "nothing here", "solo", "one", "", ""), (2, None, "bare", "p", "", ""), (2, "q", "bare", "q", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    # Where a worker is forked before the change it keeps the larger blocks; results are the same.
    assert audited(docs, spark, block=block) == sql_rows(docs, divergence.SQL)


def test_divergence_by_hand(spark):
    docs = spark.createDataFrame([(i, "a a b", "en", "s", "", "") for i in range(30)] + [(i, "a", "en", "t", "", "") for i in range(30)], SCHEMA)
    share = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    far = abs(share(60, 90, 2) - share(30, 30, 2)) + abs(share(30, 90, 2) - share(0, 30, 2))
    got = audited(docs, spark)
    assert [r for r in got if r[2] == "pair"] == [("en", "s", "pair", "t", far, 1), ("en", "t", "pair", "s", far, 1)]
    assert [r[:4] for r in got if r[2] == "term"] == [("en", "s", "term", "b"), ("en", "t", "term", "a")]
    assert audited(docs.limit(0), spark) == []


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 3)
    text = "Ab cdefghé漢 x1y2z __ QQ"
    assert [t for part in divergence.pieces(text) for t in part] == divergence.TERM(text.translate(divergence.LOWER))
