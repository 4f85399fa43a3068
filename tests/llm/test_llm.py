"""The operators against brute force, round trips and held-out labels, and their defined results for odd rows."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from test_near_copies import brute as brute_near_copies

from loomline.llm import bpe, decontaminate, html_template, licenses, merkle, quality, queries, quotes, simhash, syncmers, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, fp string, score double, match string"
BIG = (1 << 62) + 1
LONG = "word " * 30_000 + "ende\n" * 2000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again", "x", 1.0, None),
    (1, "The quick brown fox jumps over the lazy dog again", "x", 1.0, None),
    (2, None, None, None, None),
    (3, "", "", 0.0, ""),
    (None, "a text without an id é漢🙂", "y", 2.0, "z"),
    (BIG, "a number that no double holds", "y", 2.0, "z"),
    (7, LONG, "y", 2.0, "z"),
    (8, "\x00\t \n", None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(rows):
    return sorted(((r.doc_id, tuple(r)[1:]) for r in rows), key=repr)


def test_bpe_equals_library(spark, odd, none):
    path = queries.VOCABULARY
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.codec(path, P.PATTERN)
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b", "é", "漢", "  ", "\n", "'s", "'ll", "12", "½", "the", "ing", "🙂", "!!", "\x1d", "　", "_", "ɐ"]) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    texts += [r[1] or "" for r in ROWS] + ["a" * 5000, " " * 999, "<|endoftext|>"]
    for t in texts:
        ids = library.encode_ordinary(t)
        assert c.encode(t) == ids
        assert c.decode(ids) == t.encode()
        assert c.digest(t) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    out = bpe.encode_documents(odd, path, P.PATTERN).collect()
    assert sorted(repr(r.doc_id) for r in out) == sorted(repr(r[0]) for r in ROWS)
    assert {r.doc_id: r.n_tokens for r in out}[2] == 0
    assert bpe.encode_documents(none, path, P.PATTERN).collect() == []
    assert len(bpe.token_ids(odd, path, P.PATTERN).where("doc_id = 1").collect()) == 2


def test_bpe_split_alike():
    c = bpe.codec(queries.VOCABULARY, P.PATTERN)
    assert bpe.USUAL == P.PATTERN
    rng = random.Random(6)
    alphabet = [chr(i) for i in range(0x250)] + ["‘", "’", "…"]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(20))
        if bpe.PLAIN(t):
            assert bpe.LATIN(t) == c.findall(t), repr(t)


def brute_components(rows):
    ids = {}
    for doc_id, text in rows:
        ids.setdefault(simhash.fingerprint(text), []).append(doc_id)
    left, out = set(ids), {}
    while left:
        todo, part = [left.pop()], []
        while todo:
            a = todo.pop()
            part.append(a)
            near = {b for b in left if bin(a ^ b).count("1") <= 3}
            left -= near
            todo += near
        known = [i for f in part for i in ids[f] if i is not None]
        out |= {f: min(known) if known else None for f in part}
    return out


def test_simhash_components(spark, odd, none):
    rng = random.Random(2)
    rows = [r[:2] for r in ROWS]
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) for _ in range(400)) for _ in range(6)]
    for k in range(150):
        words = base[k % 6].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(["zz", "yy"])
        rows.append((100 + k, " ".join(words)))
    want = brute_components(rows)
    assert len({v for v in want.values()}) < len(want)  # some fingerprints differ and link
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), spark).collect()
    assert sorted((repr(r.doc_id), int(r.fingerprint, 16), r.component_id) for r in got) == sorted((repr(i), simhash.fingerprint(t), want[simhash.fingerprint(t)]) for i, t in rows)
    assert simhash.near_duplicates(none, spark).collect() == []
    rows = simhash.near_duplicates(odd, spark).collect()
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(r[0]) for r in ROWS) and {r.component_id for r in rows if r.doc_id in (2, 3)} == {2}


def test_simhash_random_links(spark):
    """Every pair at three bits or fewer meets at an anchor, whichever bits differ; a chain is one component."""
    rng = random.Random(3)
    fps, chain = [], rng.getrandbits(64)
    for _ in range(300):
        x = rng.getrandbits(64)
        fps += [x, x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))]
    for _ in range(60):
        chain ^= sum(1 << b for b in rng.sample(range(64), 3))
        fps.append(chain)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in [*fps, 0, (1 << 64) - 1, 7]})
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert {tuple(r) for r in links.collect()} == want
    label = {r.node: r.label for r in simhash.components(links, spark).collect()}
    for a, b in want:
        assert label[a] == label[b] <= a


def test_simhash_fingerprint():
    import xxhash

    def slow(text):
        words = text.lower().split()
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in ("", "a", "a b", "a b c", "x y z x y z x", "Mixed CASE words Here"):
        assert simhash.fingerprint(t) == slow(t)
    assert simhash.fingerprint(None) == 0 and simhash.fingerprint("a b") != simhash.fingerprint("a b")


def edited(text, kind, rng):
    """A text at a similarity of 0.8 or a little more, by one kind of edits or all."""
    s = list(text)
    for _ in range(int(len(text) * 0.19)):
        k, i = rng.choice(["sub", "ins", "del"]) if kind == "mix" else kind, rng.randrange(len(s))
        if k == "del":
            del s[i]
        else:
            s[i : i + (k == "sub")] = rng.choice("abcdefghijklmnopqrstuvwxyz")
    return "".join(s)


def word_edits(text, every, rng):
    """A letter changed in each nth word."""
    words = text.split()
    for i in range(0, len(words), every):
        k = rng.randrange(len(words[i]))
        words[i] = words[i][:k] + rng.choice("abcdefghijklmnopqrstuvwxyz") + words[i][k + 1 :]
    return " ".join(words)


def test_decontamination_recall(spark):
    """At the stated similarity, for typos, insertions, deletions and all of them, and for letters changed in words."""
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    found = decontaminate.Items(items)
    hosts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rng = random.Random(4)
    kinds = {k: (lambda t, k=k: edited(t, k, rng)) for k in ("sub", "ins", "del", "mix")}
    kinds |= {n: (lambda t, n=n: word_edits(t, n, rng)) for n in (8, 5, 4, 3, 2, 1)}
    kinds |= {"word": lambda t: " ".join(w + " zap" * (i % 4 == 3) for i, w in enumerate(t.split())), "copy": lambda t: t}
    for kind, change in kinds.items():
        texts, want = [], []
        for k, (_, text) in enumerate(found.rows):
            passage, host = change(items[k][1]), rng.choice(hosts)
            at = rng.randrange(len(host) + 1)
            if decontaminate.distance(text, decontaminate.plain(passage), 999)[0] <= found.most[k]:
                texts.append(f"{host[:at]} {passage} {host[at:]}")
                want.append(k)
        got = {(r, k) for r, k, *_ in found.scan(texts)}
        share = sum((r, k) in got for r, k in enumerate(want)) / len(want)
        assert len(want) > 100 and share >= (1.0 if kind == "copy" else 0.9), (kind, share)


def test_decontamination_against_all_pairs(spark):
    """The result of the query, and of blocks of items, against the distance of every document and item."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: f" {decontaminate.plain(r.text)} " for r in docs.collect()}
    items = [(r.item_id, decontaminate.plain(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for i, t in texts.items():
        for k, item in items:
            most = int(0.2 * len(item) + 1e-9)
            if (d := decontaminate.distance(item, t, most)[0]) <= most:
                want.add((i, k, d))
    got = {(r.doc_id, r.item_id, r.distance) for r in queries.op3_benchmark_decontamination(spark, SF).collect()}
    assert got == want and len(want) >= 3


def test_decontamination(spark, odd, none):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    thai = "การทดสอบภาษาไทยที่ไม่มีช่องว่างระหว่างคำในประโยคยาวๆเพื่อดูว่าพบข้อความที่คัดลอกมาหรือไม่"
    extra = [(900, None), (901, ""), (902, "lone"), (903, "two words"), items[0], (904, thai), (905, "a short item of some words"), (None, items[5][1]), (906, "...")]
    benchmark = spark.createDataFrame([(*r, "x") for r in [*items, *extra]], "item_id long, text string, doc_id string")
    planted = [(50, "before " + items[3][1].upper() + " after"), (51, "a lone voice"), (52, "Two, words"), (53, "cyclones are no lonely thing"), (54, thai * 2), (55, "so a shrt item of same words it is"), (None, items[7][1]), (56, items[5][1]), (56, items[5][1])]
    long = "lorem ipsum dolor " * 120_000
    planted += [(57, long[:1_000_050] + items[9][1] + long)]
    docs = spark.createDataFrame([*[r[:2] for r in ROWS], *planted], "doc_id long, text string")
    want = [(50, 3, 0), (51, 902, 0), (52, 903, 0), (54, 904, 0), (55, 905, 2), (None, 7, 0), *[(56, 5, 0), (56, None, 0)] * 2, (57, 9, 0)]
    for chars in (decontaminate.CHARS, 3000):
        rows = decontaminate.leaks(docs, benchmark, chars=chars).collect()
        assert sorted(((r.doc_id, r.item_id, r.distance) for r in rows), key=repr) == sorted(want, key=repr)
        assert all((r.similarity == 1) == (r.distance == 0) for r in rows)
        assert decontaminate.leaks(none, benchmark, chars=chars).collect() == [] == decontaminate.leaks(docs, benchmark.limit(0), chars=chars).collect()
        kept = decontaminate.clean_filter(odd, benchmark, chars=chars)
        assert kept.columns == odd.columns and kept.count() == len(ROWS)
        assert decontaminate.clean_filter(docs, benchmark, chars=chars).count() == docs.count() - 9
        assert decontaminate.clean_filter(docs, benchmark.limit(0), chars=chars).count() == docs.count()


def test_edit_distance():
    def slow(a, p):
        row = [0] * (len(p) + 1)
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(p, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return min(row)

    rng = random.Random(8)
    for _ in range(300):
        a, p = ("".join(rng.choice("abc ") for _ in range(rng.randint(lo, hi))) for lo, hi in ((1, 90), (0, 120)))
        assert decontaminate.distance(a, p, len(a))[0] == slow(a, p)
    pairs = [("".join(rng.choice("abcé漢 ") for _ in range(rng.randint(1, 90))), "".join(rng.choice("abcé漢 ") for _ in range(rng.randint(0, 120))), rng.randint(0, 40)) for _ in range(700)]
    assert decontaminate.distances(pairs) == [decontaminate.distance(*p) for p in pairs] and decontaminate.distances([]) == []


def slow_syncmers(text):
    codes = list(text)
    inner = {}

    def h(part):
        return int(syncmers._mixed(np.array([poly(part)], np.uint64))[0])

    def poly(part):
        x = [int(v) for v in syncmers._mixed(np.array([ord(c) + 1 for c in part], np.uint64))]
        for n in (1, 2, 4, 8):
            if len(x) > n - 1 and len(x) > 1:
                x = [(a * int(syncmers._P[n]) + b) & ((1 << 64) - 1) for a, b in zip(x[:-n], x[n:], strict=True)]
        return x[0]

    out = []
    for i in range(len(codes) - syncmers.K + 1):
        parts = [inner.setdefault(j, h(codes[j : j + syncmers.S])) for j in range(i, i + syncmers.K - syncmers.S + 1)]
        if min(parts) in (parts[0], parts[-1]):
            out.append(i)
    return out


def test_syncmers(spark, odd, none):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdé ") for _ in range(300))
    at, h = syncmers.syncmers(text)
    assert at.tolist() == slow_syncmers(text)
    again, g = syncmers.syncmers("prefix " + text)  # anchors do not depend on what is around
    assert set(zip(at + 7, h, strict=True)) <= set(zip(again, g, strict=True))
    rows = syncmers.edited_fingerprints(odd, spark).collect()
    order = sorted({r[0]: r[1] or "" for r in ROWS if r[0] is not None}.items())
    after = {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}
    assert len(rows) == len(ROWS)
    for r in rows:
        t = next((x[1] or "" for x in ROWS if x[0] == r.doc_id), "")
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after.get(r.doc_id, "")[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, new = syncmers.fingerprint(t), syncmers.fingerprint(edited)
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited) == (syncmers.printed(own), syncmers.printed(new), syncmers.likeness(own, new))
        assert r.near_next == (syncmers.likeness(own, syncmers.fingerprint(after[r.doc_id])) if r.doc_id in after else 0)
    assert syncmers.edited_fingerprints(none, spark).collect() == []
    assert syncmers.anchor_rows(odd).where("doc_id = 2").count() == 0


def test_syncmers_match_positions():
    """Passages in another order are less alike; inserted text leaves the order of what is around it."""
    rng = random.Random(10)
    parts = [" ".join(rng.choice(["ab", "cde", "fg", "hij", "kl", "mno"]) + str(rng.randrange(99)) for _ in range(60)) for _ in range(5)]
    a, moved, grown = (syncmers.fingerprint(" ".join(p)) for p in (parts[:4], parts[3::-1], [*parts[:2], parts[4], *parts[2:4]]))
    assert syncmers.likeness(a, a) == 1 and syncmers.likeness(a, moved) < 0.5 < syncmers.likeness(a, grown) < 1
    assert syncmers.likeness(a, syncmers.fingerprint(parts[4])) < 0.1


def test_syncmers_over_ranges(spark):
    """Ids on many rows and in many ranges: next documents are those of the next greater id, and of the first after the last."""
    rng = random.Random(12)
    text = lambda: " ".join(str(rng.randrange(999)) for _ in range(rng.randint(0, 40)))
    rows = [(i, text()) for i in rng.sample(range(1000), 90)] + [(500, text()) for _ in range(700)] + [(501, text()) for _ in range(3)] + [(500, "same")] * 5
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        got = syncmers.edited_fingerprints(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, head string").repartition(9), spark).collect()
        one = syncmers.edited_fingerprints(spark.createDataFrame(rows[:1], "doc_id long, text string"), spark).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    first = {}
    for i, t in rows:
        first[i] = min(first.get(i, t), t, key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    ids = sorted(first)
    after = {i: first[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)}
    want = []
    for i, t in rows:
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[i][:cut]
        own = syncmers.fingerprint(t)
        want.append((i, hashlib.sha256(edited.encode()).hexdigest(), syncmers.printed(own), syncmers.likeness(own, syncmers.fingerprint(after[i]))))
    assert sorted((r.doc_id, r.edited_sha256, r.fingerprint, r.near_next) for r in got) == sorted(want)
    assert len(one) == 1 and one[0].near_next == 1


def held_out(spark, query, label, folds, fold):
    rows = query(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
    return [(r, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]


def test_toxicity(spark, odd, none):
    pairs = held_out(spark, queries.op6_toxicity, "toxic", 4, 2)
    # With 37 toxic rows to learn from, terms of the rarer languages stay unknown; no clean row may be taken for toxic.
    assert sum(r.predicted == y for r, y in pairs) >= 0.93 * len(pairs)
    assert not any(r.predicted and not y for r, y in pairs)
    a = toxicity.Automaton({"idiot": 1.0, "scum": 1.0, "worthless": 1.0, "lowei*": 1.0})

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            now = [i]
            for j, d in enumerate(y, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
            row = now
        return row[-1]

    rng = random.Random(1)
    for term in ("idiot", "scum", "worthless"):
        for _ in range(400):
            w = list(term)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "i"])
            w = "".join(w)
            near = [(edits(w, t), t) for t in ("idiot", "scum", "worthless") if edits(w, t) <= toxicity.allowed(t)]
            want = (min(near)[1], min(near)[0]) if near else None
            if not w.startswith("lowei"):
                assert a.match(w) == want, w
    assert a.match("loweischaft") == ("lowei*", 0) and a.match("lower") is None
    plain, quoted = toxicity.sums("you idiot", a), toxicity.sums('he said "what an idiot" once', a)
    assert plain[0] > 0 and quoted[0] == 0 and quoted[2] > 0
    model = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_documents(odd, model).count() == len(ROWS)
    assert toxicity.score_documents(none, model).collect() == []


def test_quality(spark, odd, none):
    pairs = held_out(spark, queries.op9_quality, "quality", 3, 1)
    assert sum(r.predicted == y for r, y in pairs) >= 0.93 * len(pairs)
    labels = spark.createDataFrame([(1, 1), (7, 0), (7, 0), (3, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    rows = quality.score_documents(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_documents(none, quality.train(none, labels)).collect() == []


def test_html():
    page = (
        '<body><header class="site-header"><h1>Site</h1></header><div id="cookieNotice">We use cookies</div><main><h2>T&eacute;st &#8212; a</h2><p>One <b>two</b><br>three &lt;x&gt; 5 < 6<p>Second'
        "<ul><li>a<li>b</ul><pre>  code\n here</pre><form><input>search</form><script>var t='</p>'</script><section class=comments><article>bad</article></section></main><aside>side</aside><footer>f</footer></body>"
    )
    assert html_template.main_text(page) == "Tést — a\n\nOne two three <x> 5 < 6\n\nSecond\n\na\n\nb\n\ncode here"
    assert html_template.main_text(None) == html_template.main_text("") == ""
    assert html_template.main_text("<p>open <b>end") == "open end"


def test_html_attributes_and_runs():
    """Words in other attributes hide nothing; unclosed tags, deep nesting and the like take linear time."""
    import time

    assert html_template.main_text('<p title="the hidden ad">kept</p><p hidden>gone</p><p data-x="class=nav">too</p>') == "kept\n\ntoo"
    for page, text in (("<a " * 350_000, None), ("<!" * 300_000, None), ("<div>" * 100_000 + "x", "x"), ("<div>" * 50_000 + "x" + "</div>" * 50_000, "x"), ('<a "<a ""' * 100_000, None), ("<ul>" + "<li>a" * 50_000, None), ("</x>" * 200_000, ""), ("word " * 200_000, ("word " * 200_000).strip())):
        start = time.process_time()
        got = html_template.main_text(page)
        assert time.process_time() - start < 3 and (text is None or got == text), page[:20]


SITE = "<html><body><div class=top>{1} daily</div><div class=z><h2>Head {0}</h2>{2}<p>Story {0} is told</p><div class=legal>All rights reserved</div></div></body></html>"


def test_html_templates(spark):
    """Constants go wherever they stand, by the broadcast and by the join."""
    rows = [(i, f"https://x.org/{i}", SITE.format(i, "Acme", "<p>More</p>" * (i % 3)), 1) for i in range(6)]
    rows += [(20 + i, f"https://z.org/{i}", f"<main><h1>Title {i}</h1><p>Text {i} of it</p><p class=tail>Write to us</p></main>", 1) for i in range(4)]
    rows += [(30 + i, f"https://two.org/{i}", SITE.format(i, "Two", ""), 1) for i in range(2)]
    near = [f"<article>{''.join(f'<p>Paragraph {k} of one article</p>' for k in range(10))}<p>Edit {i}</p></article>" for i in range(5)]
    rows += [(40 + i, f"https://near.org/{i}", h, 1) for i, h in enumerate(near)]
    rows += [(10, None, None, 1), (11, None, "", 1), (None, "https://y.org/1", "<p>one</p>", 1), (3, "https://x.org/3", rows[3][2], 1)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, host int, text int, size int")
    sent, joined = (sorted(map(tuple, html_template.extract(pages, most).collect()), key=repr) for most in (1000, -1))
    assert sent == joined and len(sent) == len(rows)
    text = {r[0]: r[2] for r in sent}
    assert text[3] == "Head 3\n\nStory 3 is told" and text[5] == "Head 5\n\nMore\n\nMore\n\nStory 5 is told"
    assert text[21] == "Title 1\n\nText 1 of it"  # a constant inside the article element
    assert text[31] == "Two daily\n\nHead 1\n\nStory 1 is told\n\nAll rights reserved"  # two pages make no template
    assert text[43].startswith("Paragraph 0 of one article") and text[43].endswith("Edit 3") and text[43].count("\n\n") == 10  # near copies
    assert (10, None, "", 0) in sent and (None, "https://y.org/1", "one", 3) in sent and [r[0] for r in sent].count(3) == 2
    assert html_template.extract(pages.limit(0)).collect() == []


def test_html_classes_against_brute_force(spark):
    """Vectors, orders and nesting of small sites, counted page by page."""
    rng = random.Random(21)
    pages = []
    for site in range(4):
        for i in range(rng.randint(3, 9)):
            body = "".join(f"<div class=item><b>x</b><h3>Name</h3><p>{rng.randrange(10**6)}</p></div>" for _ in range(rng.randint(1, 4)))
            extra = "<div class=note><p>Note</p></div>" if rng.random() < 0.7 else ""
            swapped = "<p>one</p><h4>two</h4>" if i % 2 else "<h4>two</h4><p>one</p>"
            pages.append((f"https://s{site}.org/{i}", f"<body><p>Fixed</p>{extra}<section>{body}</section>{swapped}<p>unique text number {rng.randrange(10**9)} of the page</p></body>"))
    df = spark.createDataFrame(pages, "url string, html string")
    seqs = html_template.sequences(df)
    got = {(r.host, frozenset(r.tokens), r.support) for r in html_template.classes(seqs).collect()}
    by_host = {}
    for r in seqs.collect():
        by_host.setdefault(r.host, []).append(r.tokens)
    want, chosen = set(), {}
    for host, rows in by_host.items():
        vectors = {}
        for t in {t for seq in rows for t in seq}:
            vectors.setdefault(tuple(seq.count(t) for seq in rows), []).append(t)
        ordered = []
        for v, tokens in vectors.items():
            support = sum(n > 0 for n in v)
            if support < 3 or support * 2 < len(rows) or len(tokens) < 2 or not any(t & 1 for t in tokens):
                continue
            want.add((host, frozenset(tokens), support))
            own = [[t for t in seq if t in tokens] for seq in rows]
            base = next(o for o in own if o)[: len(tokens)]
            if sorted(base) == sorted(tokens) and all(o == base * (len(o) // len(base)) for o in own):
                ordered.append((support, base))

        def spans(seq, base):
            at = [i for i, t in enumerate(seq) if t in base]
            return [at[k : k + len(base)] for k in range(0, len(at), len(base))]

        def nests(a, b):
            inside = {(x, y): set() for x, y in ((0, 1), (1, 0))}
            for seq in rows:
                both = spans(seq, a), spans(seq, b)
                for x, y in inside:
                    for p in both[x]:
                        for q in both[y]:
                            if p[0] < q[0] < p[-1]:
                                slot = sum(z < q[0] for z in p)
                                inside[x, y].add(slot if slot == sum(z < q[-1] for z in p) else -1)
            return all(len(s) < 2 and -1 not in s for s in inside.values())

        kept = []
        for _, base in sorted(ordered, key=lambda x: (-x[0], -len(x[1]))):
            if all(nests(base, o) for o in kept):
                kept.append(base)
        chosen[host] = {tuple(b) for b in kept}
    assert got == want
    for r in html_template.templates(df).collect():
        orders = {}
        for t, c, i, n in zip(r.tokens, r["class"], r.place, r["size"], strict=True):
            orders.setdefault(c, [None] * n)[i] = t
        assert {tuple(o) for o in orders.values()} == chosen[r.host]
        assert len(orders) >= 2


def oracle(name, **tables):
    """Rows of a query's SQL, or of SQL itself."""
    con = duckdb.connect()
    for t, rows in tables.items():
        con.register(t, rows.toPandas())
    r = con.execute(queries.SQL.get(name, name))
    return [c[0] for c in r.description], r.fetchall()


def same(df, name, **tables):
    cols, rows = oracle(name, **tables)
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == sorted(rows, key=key)


# Notices as they are printed.
BSD = """Copyright (c) 2020, {0}
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

{1}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
NOTICES = {
    "MIT": """MIT License

Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.""",
    "BSD-2-Clause": BSD.format("Some Body", ""),
    "BSD-2-Clause,BSD-3-Clause": BSD.format("The Such University", "3. Neither the name of The Such University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"),
    "Apache-2.0": """Copyright 2019 Some Body

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": """Copyright (c) 2018, Some Body

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL DAMAGES.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
}


def wrapped(text, width, mark):
    import textwrap

    paragraphs = text.split("\n\n")
    return f"\n{mark}\n".join("\n".join(mark + line for line in textwrap.wrap(p, width)) for p in paragraphs)


def test_licence_notices(spark):
    """Whole notices, wrapped and in comments; other versions and parts of sentences are not taken for them."""
    rows, want = [], {}
    for licence, text in NOTICES.items():
        forms = [text, *(wrapped(text, w, m) for w, m in ((72, ""), (60, "# "), (76, "// "), (70, " * "), (66, "dnl ")))]
        for form in (*forms, f"/*\n{forms[4]}\n */\nint main;"):
            want[len(rows)] = licence
            rows.append((len(rows), form))
    other = ["SPDX-License-Identifier: GPL-3.0", "# SPDX-License-Identifier: CC-BY-SA-4.0", "This project is licensed under the\nMIT License", "Released under the MIT License", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007"]
    for text, licence in zip(other, ["GPL-3.0", "CC-BY-SA-4.0", "MIT", "MIT", "GPL-3.0"], strict=True):
        want[len(rows)] = licence
        rows.append((len(rows), text))
    changed = [("MPL-2.0", "v. 2.0", "v. 9.9"), ("Apache-2.0", "Version 2.0", "Version 7.0"), ("GPL-3.0-or-later", "version 3", "version 5"), ("LGPL-2.1-or-later", "2.1", "2.7"), ("MIT", "sublicense, and/or sell", "sublicense"), ("ISC", "with or without fee", "without fee")]
    for licence, old, new in changed:
        text = NOTICES[licence].replace(old, new).replace("MIT License", "")
        want[len(rows)] = "Apache-2.0" if licence == "Apache-2.0" else ""  # its other sentences still make a rule
        rows.append((len(rows), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.recognise(docs)
    assert {r.doc_id: r.licences for r in got.collect()} == want
    same(got, "op5_license_sentences", documents=docs)


def test_licences(spark, odd, none):
    docs = spark.createDataFrame([(1, "Intro. Released under the MIT License."), (2, "Licensed under the Apache License,  Version 2.0. Thanks!"), (3, None), (4, ""), (4, ""), (5, "No licence here."), (6, "the\n" * 20_000 + "." * 50_000 + " the " * 20_000)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.recognise(docs).collect()}
    assert got[2] == ("apache-2.0-named-2", "Apache-2.0") and got[3] == ("", "")
    assert got[1][1] == "MIT" and got[5] == got[6] == ("", "")
    same(licenses.recognise(docs.where("doc_id < 6")), "op5_license_sentences", documents=docs.where("doc_id < 6"))
    assert licenses.recognise(odd).count() == len(ROWS) and licenses.recognise(none).collect() == []
    backwards = licenses.recognise(spark.createDataFrame([(1, NOTICES["MIT"])], "doc_id long, text string"), rules=[("X", ["mit-notice", "mit-grant"])])
    assert backwards.where("licences <> ''").count() == 0
    with pytest.raises(ValueError, match="more than one sentence"):
        licenses.known({"two": "One. Two"})


def test_merkle(spark):
    rng = random.Random(11)
    good = [(a, o * 5000, a * 100_000 + o, "".join(rng.choice("abc") for _ in range(20))) for a in range(3) for o in range(200)]
    schema = "archive long, rec_offset long, record_id long, payload string"
    bad = [r for r in good if r[2] not in (7, 100_150)]
    bad = [(*r[:3], "broken") if r[2] in (11, 12, 200_199) else r for r in bad] + [(5, 0, 1, "extra"), good[20]]
    odd = [(None, None, None, None), (None, None, None, None), (9, 1, 1, None)]
    got = merkle.audit(spark.createDataFrame(good + odd, schema), spark.createDataFrame(bad + odd, schema), spark)
    assert {(r.record_id, r.status) for r in got.collect()} == {(7, "missing"), (100_150, "missing"), (11, "changed"), (12, "changed"), (200_199, "changed"), (1, "extra")}
    empty = spark.createDataFrame([], schema)
    assert merkle.audit(empty, empty, spark).collect() == []
    assert merkle.audit(spark.createDataFrame(good, schema), empty, spark).count() == len(good)
    # One offset for all, and columns of clashing names; a payload of a megabyte.
    one = [(1, None if i % 2 else 7, i, "x" * 1_000_000 if i == 3 else "p") for i in range(400)]
    wide = lambda rows: spark.createDataFrame([(*r, "d", 1, 2) for r in rows], f"{schema}, digest string, node long, part long")
    got = merkle.audit(wide(one), wide([*one[:3], (*one[3][:3], one[3][3] + "y"), *one[4:]]), spark)
    assert [(r.record_id, r.status) for r in got.collect()] == [(3, "changed")]
    same(queries.op2_merkle_audit(spark, SF), "op2_merkle_audit", pages=spark.read.parquet(f"{SF}/pages.parquet"))


def test_quotes(spark):
    t = [
        (1, 0, "u", "First point here.\nSecond line of it.\n\nAnother paragraph."),
        (1, 1, "a", "On Monday u wrote:\n> First point here.\n> Second line of it.\n\nI agree."),
        (1, 2, "b", "a wrote:\n> I agree.\n>> Second line of it.\nNo.\n> unknown words\nEnd"),
        (1, 3, "u", "Something new"),
        (1, 4, "c", "> First point here. Made up sentence\nhm"),
        (1, 5, "c", "> hm\nyes"),
        (2, 0, "u", "> I agree.\nother conversation"),
        (2, 1, "u", None),
        (2, 1, "u", ""),
        (3, 1, "x", "hm"),
        (3, 1500, "x", "hm"),
        (3, 4000, "x", "> HM!"),
        (3, 4001, "x", "> hm"),
    ]
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame(t, schema)
    got = quotes.conversations(rows, spark)
    by = {(r.conv_id, r.turn): r for r in got.collect()}
    assert by[1, 1].reply_to == 0 and by[1, 1].body == "I agree."
    assert by[1, 2].reply_to == 1 and by[1, 2].depth == 2 and by[1, 2].thread == 0 and by[1, 2].quote_levels == 2
    assert by[1, 4].reply_to == 0 and by[1, 5].reply_to == 4 and by[1, 3].thread == 3
    assert by[2, 0].reply_to is None and by[3, 4000].reply_to == 1500 and by[3, 4001].reply_to == 1500
    assert [r.turn for r in got.where("conv_id = 1").orderBy("reply_order").collect()] == [0, 1, 2, 4, 5, 3]
    same(got, f"WITH RECURSIVE {quotes.LINKING_SQL}", messages=rows)
    odd = [*t, (None, 1, "u", "> hm"), (1, None, "u", "> hm"), (None, None, None, None), (None, None, None, None), t[0], t[0]]
    wide = spark.createDataFrame([(*r, "x", 1, 2) for r in odd], f"{schema}, body string, n long, thread long")
    assert quotes.conversations(wide, spark).count() == len(odd)
    again = quotes.conversations(wide, spark).where("conv_id = 1 AND turn = 0").collect()
    assert sorted(r.reply_order for r in again) == [2, 3, 4] and len({r.body for r in again}) == 1
    assert quotes.conversations(rows.limit(0), spark).collect() == []


def test_quotes_votes_and_long_runs(spark):
    t = [
        (1, 0, "u", "One thing. Another thing. A third thing."),
        (1, 1, "a", "I agree."),
        (1, 2, "b", "> One thing. I agree. Another thing.\nok"),
        (1, 3, "c", ">" * 100_000 + " I agree."),
        (1, 4, "c", "\t" * 50_000 + "> \n" + "." * 100_000 + " " * 100_000 + "end\n" + "> ok\n" * 20_000),
        (1, 5, "d", "line\n" * 30_000 + "> ok"),
    ]
    rows = spark.createDataFrame(t, "conv_id long, turn long, role string, text string")
    got = quotes.conversations(rows, spark)
    by = {r.turn: r for r in got.collect()}
    assert by[2].reply_to == 0 and by[2].linked_passages == 1  # two sentences against one
    assert by[3].quote_levels == 100_000 and by[3].reply_to == 1
    assert by[5].reply_to == 2 and by[4].quoted_passages == 2
    same(got, f"WITH RECURSIVE {quotes.LINKING_SQL}", messages=rows)


def test_quotes_of_the_tables(spark):
    """The query's quoting replies do link, and no exchange of its passages carries a row twice."""
    got = queries.op1_quotation_linking(spark, SF)
    same(got, "op1_quotation_linking", conversations=spark.read.parquet(f"{SF}/conversations.parquet"))
    assert got.where("linked_passages > 0").count() > 10 and got.where("depth > 1").count() > 0 and got.where("quote_levels = 2").count() > 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    tox = toxicity.train(read("documents"), read("labels"))
    a = toxicity.automaton_of(tox)
    left = {i: t for i, t in docs.items() if tox.score(toxicity.sums(t, a)) < toxicity.THRESHOLD}
    model = quality.train(read("documents").where(f"doc_id IN ({','.join(map(str, left))})"), read("labels"))
    left = {i: t for i, t in left.items() if model.score([t])[0] >= quality.THRESHOLD}
    left = {i: left[i] for _, i in brute_near_copies(left.items())}
    items = decontaminate.Items([(r.item_id, r.text) for r in read("benchmark").collect()])
    left = {i: t for i, t in left.items() if not items.scan([t])}
    c = bpe.codec(queries.VOCABULARY, queries.PATTERN)
    assert {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF).collect()} == {i: c.digest(t) for i, t in left.items()}
    assert 0 < len(left) < len(docs)


def test_pipeline_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and very long texts, repeats, clashing columns and empty tables in every stage."""
    import corpus_pipeline
    from loomline.llm.common import workspace

    tables = {"documents": odd, "labels": spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, "the quick brown fox jumps over a lazy dog again"), (2, None)], "item_id long, text string")}
    for n, df in tables.items():
        df.write.parquet(f"{tmp_path}/odd/{n}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/none/{n}.parquet")
    docs = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        with workspace(spark):
            stage(spark, docs, f"{tmp_path}/odd").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == odd.columns
    assert {r.doc_id for r in docs.collect()} <= {2, None, BIG, 7, 8}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_labelled_sample_is_one_row_per_id(spark):
    """An id on most rows sends one text to the driver; of several texts it is the least."""
    from loomline.llm.common import labelled_sample

    docs = spark.range(10_000).selectExpr("3L AS doc_id", "concat('text ', 99999 - id % 7) AS text").union(spark.createDataFrame([(4, None), (None, "x")], "doc_id long, text string"))
    labels = spark.createDataFrame([(3, 1), (4, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 1, 5, 100)
    assert rows.to_dict("records") == [{"doc_id": 3, "y": 1, "text": "text 99993"}, {"doc_id": 4, "y": 0, "text": ""}]


def test_shared_folder_is_asked_for(spark):
    """Without spark.checkpoint.dir only a local master gets a folder of its own."""
    from types import SimpleNamespace

    from loomline.llm.common import shared_dir

    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    for master, fine in (("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("spark://x:7077", False), ("yarn", False)):
        session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
        if fine:
            assert shared_dir(session)
        else:
            with pytest.raises(ValueError, match="checkpoint"):
                shared_dir(session)


def test_quality_against_brute_force(spark):
    """Vectors, pooling and the network, token by token and number by number."""
    rng = random.Random(31)
    words = ["alpha", "Beta", "12", "!!", "gamma", "δέλτα", "OMEGA", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    model = quality.fit(texts, [k % 2 for k in range(60)])
    v = model.vectors
    docs = [quality.TOKEN.findall(t) for t in texts]
    counts = {}
    for d in docs:
        for t in d:
            counts[t] = counts.get(t, 0) + 1
    name = lambda t: t if counts[t] >= quality.LEAST else quality.shape(t)
    total = {}
    for d in docs:
        for i, t in enumerate(d):
            row = total.setdefault(name(t), np.zeros(quality.DIM))
            for j in range(max(0, i - quality.WINDOW), min(len(d), i + quality.WINDOW + 1)):
                places, signs = quality.index_vectors([name(d[j])])
                for p, s in zip(places[0], signs[0], strict=True):
                    row[p] += s * (2 if i == j else 1)
    for t, row in total.items():
        assert np.allclose(v.rows[v.index[t]], row / np.linalg.norm(row))
    for text, d in zip(texts, docs, strict=True):
        x = np.zeros(2 * quality.DIM + 2)
        if d:
            rows = [v.rows[v.index[name(t)]] for t in d]
            x[: quality.DIM] = sum(rows) / len(d)
            kinds = {v.index[name(t)] for t in d}
            x[quality.DIM : -2] = sum(v.rows[k] for k in kinds) / len(kinds)
            x[-2:] = np.log1p(len(d)), len(set(d)) / len(d)
        z = (x - model.mean) / model.scale
        hidden = [np.tanh(sum(z[i] * model.layers[0][i, k] for i in range(len(z))) + model.layers[1][k]) for k in range(quality.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, model.layers[2], strict=True)) + model.layers[3]
        assert abs(model.score([text])[0] - 1 / (1 + np.exp(-logit / model.temperature))) < 1e-9
