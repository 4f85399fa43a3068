"""Toxicity by Levenshtein automata intersected with a lexicon trie (operator 6).

The lexicon is a trie. The automaton of all words within the allowed edits of any term is run along each word of a
text; its states are sets of (trie node, edits spent), made deterministic as they come up. A hit counts by its term's
weight, by its edits, and by the window of words around it: quotation marks and reporting words lower it, an
address ("you ...") raises it. A small logistic model, fitted on labelled rows, turns a document's sums into a score.

The lexicon is learnt: words of labelled toxic rows that are rare in the others, and stems (written with a star) that
take in many such words. Terms given as `base` are added.

Defined results: a null or empty text has no hits and gets the model's base score; repeated rows give repeated
results; with no labelled rows of both kinds the weights of BLANK are used; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import in_fold, labelled_sample, once

FOLDS, HELD_OUT = 4, 2
#: Most labelled rows that the lexicon and the model are fitted on.
SAMPLE = 4000
THRESHOLD = 0.3
WORD = re.compile(r"\w+(?:[@$*!.\-]\w+)*")
PARTS = re.compile(r"\w+")
#: Words on either side that make up a hit's window.
WINDOW = 4
# Terms known beforehand, reporting words, address words, quotation marks.
BASE = ("idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "loser", "scum", "trash", "clown")
REPORTS = frozenset("said says wrote writes called calls quote quoted quoting word term phrase slur reported dit sagte dijo".split())
ADDRESS = frozenset("you your you're youre u ur are such tu vous du ihr eres".split())
MARKS = '"“”«»„'
#: Plain swaps of characters that disguise a letter.
LEET = str.maketrans("013457@$", "oieastas")
REMEMBERED = 300_000
#: States that an automaton holds before it begins anew, and what stands for letters that no term has.
STATES, OTHER = 200_000, "\0"
#: Bias and weights of exact, misspelt and quoted sums where nothing can be learnt.
BLANK = (-4.0, 3.0, 2.0, 0.5)


def allowed(term: str) -> int:
    """Edits that a term may be off by. A stem matches the start of a word, so it is held to more letters."""
    if term.endswith("*"):
        return int(len(term) > 8)
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    def __init__(self, terms: dict[str, float]):
        self.weights = dict(sorted(terms.items()))
        self.children: list[dict[str, int]] = [{}]
        self.most = [-1]  # edits that any term below a node allows
        self.ends: dict[int, str] = {}
        self.stems: set[int] = set()
        for t in self.weights:
            node = 0
            self.most[0] = max(self.most[0], allowed(t))
            for c in t.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(-1)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed(t))
            if not t.endswith("*") or node not in self.ends:
                self.ends[node] = t
            if t.endswith("*"):
                self.stems.add(node)
        self.letters = {c for t in self.weights for c in t}
        self.known: dict[str, tuple[str, int] | None] = {}
        self._begin()

    def _begin(self) -> None:
        """No states but the first."""
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0}) if self.weights else -1

    def _state(self, spent: dict[int, int]) -> int:
        todo = list(spent.items())
        while todo:  # letters left out of the word
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and e + 1 < spent.get(child, 99):
                    spent[child] = e + 1
                    todo.append((child, e + 1))
        if not spent:
            return -1
        key = tuple(sorted(spent.items()))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            hits = [(e, self.ends[n]) for n, e in key if n in self.ends and e <= allowed(self.ends[n])]
            self.accepts.append((min(hits)[1], min(hits)[0]) if hits else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for node, e in self.sets[state]:
            if node in self.stems:  # any ending
                after[node] = min(after.get(node, 99), e)
            elif e + 1 <= self.most[node]:  # a letter too many
                after[node] = min(after.get(node, 99), e + 1)
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child]:
                    after[child] = min(after.get(child, 99), cost)
        found = self.steps[state, c] = self._state(after)
        return found

    def match(self, word: str) -> tuple[str, int] | None:
        """The term within its allowed edits of a lower-case word, nearest first, and the edits."""
        state, steps = self.start, self.steps
        for c in word:
            if state < 0:
                return None
            after = steps.get((state, c))
            if after is None:  # letters that no term has are alike, so there are no more steps than states and letters of terms
                c = c if c in self.letters else OTHER
                after = steps.get((state, c))
                if after is None:
                    after = self._step(state, c)
            state = after
        return self.accepts[state] if state >= 0 else None

    def lookup(self, word: str) -> tuple[str, int] | None:
        if word in self.known:
            return self.known[word]
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(self.sets) >= STATES:
            self._begin()
        found = self.match(word)
        if found is None and not word.isalpha():
            plain = self.match(re.sub(r"[^\w]|_", "", word.translate(LEET)))
            found = plain and (plain[0], max(plain[1], 1))
        self.known[word] = found
        return found


def sums(text: str | None, automaton: Automaton) -> tuple[float, float, float, int]:
    """Weights of a text's exact, misspelt and quoted hits by context, and the number of hits."""
    low = (text or "").lower()
    hit_words = {w for w in set(WORD.findall(low)) if automaton.lookup(w)}
    if not hit_words:
        return 0.0, 0.0, 0.0, 0
    found = list(WORD.finditer(low))
    words = [m[0] for m in found]
    marks = [m.start() for m in re.finditer(f"[{MARKS}]", low)]
    at = np.searchsorted(marks, [m.start() for m in found]) if marks else None
    exact = misspelt = quoted = 0.0
    n = 0
    for i, m in enumerate(found):
        if m[0] not in hit_words:
            continue
        term, edits = automaton.lookup(m[0])
        around = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        weight = automaton.weights[term] * (1.3 if ADDRESS.intersection(around) else 1.0)
        line = low.rfind("\n", 0, m.start()) + 1
        # An odd number of marks before it, and one soon after: it stands inside a quotation.
        inside = at is not None and at[i] % 2 == 1 and at[i] < len(marks) and marks[at[i]] - m.end() < 200
        n += 1
        if inside or low[line : line + 3].lstrip().startswith(">"):
            quoted += weight * (0.5 if REPORTS.intersection(around) else 1.0)
        elif edits:
            misspelt += weight / edits
        else:
            exact += weight * (0.7 if REPORTS.intersection(around) else 1.0)
    return exact, misspelt, quoted, n


def features(found: tuple[float, float, float, int]) -> list[float]:
    return [math.log1p(x) for x in found[:3]]


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = BLANK

    def score(self, found: tuple[float, float, float, int]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features(found), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _distinct(texts: Iterable[str]) -> Iterator[set[str]]:
    """The words of each text, without texts that look like copies of an earlier one (by two min-hashes)."""
    seen = set()
    for t in texts:
        words = set(PARTS.findall((t or "").lower()))
        key = tuple(min((xxh64_intdigest(w, s) for w in words if len(w) > 5), default=0) for s in (1, 2))
        if key == (0, 0) or key not in seen:
            seen.add(key)
            yield words


def learn_lexicon(texts: list[str], labels: list[int], base: tuple[str, ...] = BASE) -> dict[str, float]:
    """Words and stems of six toxic rows at least that are far more common there than elsewhere.

    A stem has 4 to 8 letters and stands for its words if none of them alone has two thirds of its rows; of nested
    stems with nearly the same rows the longest is taken.
    """
    rows, words, stems = [0, 0], [Counter(), Counter()], [Counter(), Counter()]
    for kind in (False, True):
        # One text's words at a time: all of them would be many times the texts, in the driver.
        for d in _distinct(t for t, y in zip(texts, labels, strict=True) if bool(y) == kind):
            rows[kind] += 1
            words[kind].update(d)
            stems[kind].update({w[:n] for w in d for n in range(4, 9) if len(w) > n})
    rest, toxic = rows

    def marked(found: list[Counter]) -> dict[str, float]:
        ratio = {w: n * (rest + 1) / ((found[0][w] + 1) * toxic) for w, n in found[1].items() if n >= 6 and len(w) > 2}
        return {w: max(1.0, min(3.0, math.log(r) / 2)) for w, r in ratio.items() if r >= 15}

    terms = dict.fromkeys(base, 1.0) | marked(words)
    good = marked(stems)
    top: Counter = Counter()
    for w, n in words[1].items():
        for k in range(4, min(9, len(w) + 1)):
            top[w[:k]] = max(top[w[:k]], n)
    for p in sorted(good, key=lambda p: (len(p), p)):
        if top[p] * 3 >= stems[1][p] * 2:
            continue
        longer = [q for q in good if len(q) == len(p) + 1 and q.startswith(p) and stems[1][q] >= 0.9 * stems[1][p]]
        if not longer and not any(p[:k] + "*" in terms for k in range(4, len(p))):
            terms[p + "*"] = good[p]
    return terms


def fit(texts: list[str], labels: list[int], base: tuple[str, ...] = BASE) -> Model:
    """The lexicon, then logistic weights by Newton steps with a ridge. Weights of hits are never negative."""
    if len(set(map(bool, labels))) < 2:
        return Model(dict.fromkeys(base, 1.0))
    terms = learn_lexicon(texts, labels, base)
    automaton = Automaton(terms)
    x = np.array([[1.0, *features(sums(t, automaton))] for t in texts])
    y = np.array(labels, float)
    w = np.array(BLANK)
    prior = np.array(BLANK)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.5 * np.eye(4), x.T @ (y - p) - 0.5 * (w - prior))
        w = w + np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0.0)
    return Model(terms, tuple(map(float, w)))


def train(docs: DataFrame, labels: DataFrame, base: tuple[str, ...] = BASE, bound: int = SAMPLE) -> Model:
    rows = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, bound)
    return fit(list(rows["text"]), [int(v) for v in rows["y"]], base)


def automaton_of(model: Model) -> Automaton:
    """One per worker and lexicon, so that its states and known words last over tasks."""
    return once("toxicity", tuple(model.terms.items()), lambda: Automaton(model.terms))


def scorer(model: Model):
    """A column function: the score of a text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        a = automaton_of(model)
        return pd.Series([model.score(sums(t, a)) for t in texts], dtype="float64")

    return score


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and hits. No shuffle."""

    @F.pandas_udf("score double, hits int")
    def run(texts: pd.Series) -> pd.DataFrame:
        a = automaton_of(model)
        found = [sums(t, a) for t in texts]
        return pd.DataFrame({"score": [model.score(f) for f in found], "hits": [f[3] for f in found]})

    scored = docs.select("doc_id", run("text").alias("r")).select("doc_id", "r.*")
    return scored.select("doc_id", in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")
