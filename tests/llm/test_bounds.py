"""What must hold whatever the length of an item or the letters of a text."""

import random
import string

import numpy as np
import pyarrow.parquet as pq
import pytest

from loomline.llm import decontaminate, toxicity

SF = "/root/testdata/sf0.001"


def edited(text, share, rng):
    s = list(text)
    for _ in range(int(len(text) * share)):
        k, i = rng.choice(["sub", "ins", "del"]), rng.randrange(len(s))
        if k == "del":
            del s[i]
        else:
            s[i : i + (k == "sub")] = rng.choice(string.ascii_lowercase)
    return "".join(s)


@pytest.mark.parametrize("length", [20, 32, 47, 50, 60, 70, 80, 90, 100, 120, 150, 250, 400])
def test_recall_by_length(spark, length):
    """Items of one length, a tenth to a fifth of their letters edited in all ways."""
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect() if r.text]
    rng = random.Random(length)
    long = " ".join(decontaminate.plain(t) for t in docs)
    items = []
    for k in range(100):
        at = rng.randrange(len(long) - length - 60)
        t = long[at : at + length + 40]
        items.append((k, t[t.find(" ") + 1 :][:length].strip()))
    found = decontaminate.Items(items)
    for share in (0.1, 0.15, 0.2):
        texts, want = [], []
        for k, (_, t) in enumerate(found.rows):
            passage, host = edited(t, share, rng), rng.choice(docs)[:2000]
            at = rng.randrange(len(host) + 1)
            if decontaminate.distance(found.text(k), f" {decontaminate.plain(passage)} ", 999)[0] <= found.most[k]:
                texts.append(f"{host[:at]} {passage} {host[at:]}")
                want.append(k)
        got = {(r, k) for r, k, *_ in found.scan(texts)}
        assert len(want) > 50 and sum((r, k) in got for r, k in enumerate(want)) >= 0.9 * len(want), share


def test_automaton_stays_small(monkeypatch):
    """Words of many scripts make no more steps than states and letters of terms; what is forgotten is found again."""
    rng = random.Random(61)
    terms = {"".join(rng.choices("abcdef", k=rng.randint(3, 8))) + rng.choice(["", "", "*"]): 1.0 for _ in range(60)}
    words = ["".join(rng.choice([*"abcdef", chr(rng.randrange(0x100, 0x9FFF))]) for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    one = toxicity.Automaton(terms)
    found = [one.lookup(w) for w in words]
    assert len(one.steps) <= len(one.sets) * (len(one.letters) + 1) and any(found)
    monkeypatch.setattr(toxicity, "STATES", 20)
    small = toxicity.Automaton(terms)
    assert [small.lookup(w) for w in words] == found and len(small.sets) < 20 + max(map(len, words)) + 1


def test_automaton_in_long_texts():
    text = "word " * 200_000 + "".join(chr(0x4E00 + i % 20_000) + " " for i in range(60_000)) + "badword"
    automaton = toxicity.Automaton({"badword": 2.0})
    assert toxicity.sums(text, automaton)[3] > 0 and len(automaton.steps) < 200


def test_unlike_passages_are_dropped_before_distances(monkeypatch):
    """Passages that share an anchor only are told by their runs and by parts of the item; none within the edits is lost."""
    rng = random.Random(17)
    read = lambda name: [tuple(r) for r in pq.read_table(f"{SF}/{name}.parquet").select(["item_id" if name == "benchmark" else "doc_id", "text"]).to_pandas().itertuples(index=False)]
    items = decontaminate.Items(read("benchmark"))
    texts = [text or "" for _, text in read("documents")]
    for k, (_, text) in enumerate(items.rows[:40]):
        texts[k] += " " + edited(text, 0.1, rng)
    seen, whole = [], decontaminate.distances

    def counted(pairs):
        seen.append(len(pairs))
        return whole(pairs)

    likely, all_of = decontaminate.Items.likely, lambda self, run, spans: np.ones(len(spans), bool)
    monkeypatch.setattr(decontaminate, "distances", counted)
    monkeypatch.setattr(decontaminate.Items, "likely", all_of)
    monkeypatch.setattr(decontaminate, "hopeless", lambda pairs: set())
    want, before = items.scan(texts), sum(seen)
    seen.clear()
    monkeypatch.setattr(decontaminate.Items, "likely", likely)
    assert items.scan(texts) == want and len(want) >= 18
    assert sum(seen) < before / 2
    monkeypatch.undo()
    assert items.scan(texts) == want


def test_distances_by_parts_equal_one_by_one():
    rng = random.Random(18)
    pairs = []
    for n in (30, 64, 65, 130, 300):
        for share in (0.05, 0.15, 0.2, 0.3, 0.9):
            item = "".join(rng.choices("abcdef ", k=n))
            pairs.append((item, "".join(rng.choices("abcdef ", k=20)) + edited(item, share, rng) + "".join(rng.choices("abcdef ", k=20)), n // 5))
    assert decontaminate.distances(pairs) == [decontaminate.distance(*p) for p in pairs]
    far = decontaminate.hopeless(pairs)
    assert far and all(decontaminate.distance(*pairs[k])[0] > pairs[k][2] for k in far)
