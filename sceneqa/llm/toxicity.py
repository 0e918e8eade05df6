"""Toxicity: Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled texts: words, and beginnings of words, that stand in toxic texts far more often than
in clean ones. A word that is no term is matched as a misspelling: its Levenshtein automaton, a nondeterministic one whose
states are bits, reads the letters along the lexicon's trie, and a branch ends as soon as no state is left. So exact
terms, misspelt terms and words that begin like terms are caught. A word that several clean labelled texts hold is no
misspelling. The automaton runs only for words that share with a term what is left of each after dropping a letter at
most, as any two words do that one edit separates, and a worker remembers the words it has walked.

Each hit is weighed by the words around it: less between quotation marks or near a verb of saying, more near a word of
address. A logistic model over these sums gives the score. It is fitted by the driver on at most LABELLED texts (those
with the smallest hash of doc_id), which bound the lexicon and the words of clean texts too; every text is scored over its
whole length.

Null and empty texts have no hits and get the score of a text without hits. Repeated rows are scored each. Without
labels of both kinds every score is 0. An empty table gives no rows. Further columns (labels, lang and source as well)
are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneqa.llm.common import Workspace, text_array

#: Labelled texts that fitting reads at most.
LABELLED = 20_000
#: A term stands in so many toxic texts at least, and so many times more often than in clean ones; its log likelihood
#: ratio exceeds the logarithm of the number of words by SURE, so that chance makes no terms.
SUPPORT, RATIO, SURE = 3, 8.0, 1.0
#: Letters of a word's beginning that may be a term of its own.
STEM = 5
#: Shortest term that may be misspelt, and the shortest whose misspellings weigh like others; words on either side that
#: make the context; clean texts that hold a word which is no misspelling.
SHORTEST, FUZZY, CONTEXT, CLEAN = 3, 5, 6, 2
CACHE = 300_000

#: Words around a hit (fixed values).
SAYING = frozenset("said says say quoted quote quotes wrote writes called term word words phrase dit dites écrit mot sagte sagt schrieb wort dijo dice escribió palabra".split())
ADDRESS = frozenset("you your you're youre u tu toi vous ton votre du dich dein ihr sie tú usted vosotros eres".split())

_WORD = re.compile(r"[^\s\"“”„«»‹›,;:!?()\[\]{}|<>/\\]+|[\"“”„«»]")
_QUOTES = frozenset('"“”„«»')
_PAIRS = (('"', '"'), ("“", "”"), ("„", "“"), ("„", "”"), ("«", "»"), ("»", "«"))
_STRIP = ".'’‘`*_#$%&-+=~^"


def words_of(text: str) -> list[str]:
    """Lower-cased words, and quotation marks as words of their own."""
    return [w.strip(_STRIP) or w for w in _WORD.findall(text.lower())]


def quoted_places(words: list[str]) -> list[bool]:
    """Whether each word stands between two marks of a pair; straight marks open and close in turn, others by their form."""
    out = [False] * len(words)
    if _QUOTES.isdisjoint(words):
        return out
    opened: dict[str, int] = {}
    for i, w in enumerate(words):
        if w not in _QUOTES:
            continue
        for first, last in _PAIRS:
            if w == last and first in opened:
                a = opened.pop(first)
                out[a + 1 : i] = [True] * (i - a - 1)
                break
        else:
            opened[w] = i
    return out


class Automaton:
    """The Levenshtein automaton of a word for so many edits; an exchange of neighbours is one.

    A state has for each number of edits the set of lengths of the word's parts that what was read may stand for, as bits.
    """

    def __init__(self, word: str, most: int):
        self.masks: dict[str, int] = {}
        for i, c in enumerate(word):
            self.masks[c] = self.masks.get(c, 0) | 2 << i
        self.full, self.end, self.most = (2 << len(word)) - 1, 1 << len(word), most
        sets = [1]
        for _ in range(most):
            sets.append((sets[-1] | sets[-1] << 1) & self.full)
        #: The sets, those before the last letter, and that letter.
        self.start = (tuple(sets), None, "")

    def step(self, state: tuple, c: str) -> tuple | None:
        """The state after a letter; None if nothing can be accepted any more."""
        sets, before, last = state
        mask, swapped, out = self.masks.get(c, 0), self.masks.get(last, 0) & self.masks.get(c, 0) << 1, []
        for k, s in enumerate(sets):
            new = s << 1 & mask
            if k:
                below = sets[k - 1]
                new |= below | below << 1 | out[-1] << 1  # a letter more, another letter, a letter less
                if before is not None:
                    new |= before[k - 1] << 2 & swapped
            out.append(new & self.full)
        return (tuple(out), sets, c) if any(out) else None

    def edits(self, state: tuple) -> int | None:
        """With how many edits what was read is the word."""
        return next((k for k, s in enumerate(state[0]) if s & self.end), None)


class Trie:
    """Terms with a number each; `*` at a term's end lets it match the beginning of a word."""

    def __init__(self, terms: list[str], plain: frozenset[str] = frozenset()):
        self.root: dict = {}
        self.exact: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        self.dropped: set[str] = set()
        self.terms, self.plain, self.longest = terms, plain, 0
        for i, t in enumerate(terms):
            if t.endswith("*"):
                self.stems[t[:-1]] = i
                continue
            self.exact[t] = i
            if len(t) < SHORTEST:
                continue
            self.longest = max(self.longest, len(t))
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = i
            self.dropped.update(t[:k] + t[k + 1 :] for k in range(len(t)))
            self.dropped.add(t)

    def misspelt(self, word: str, most: int = 1) -> int:
        """The number of a term within so many edits, the nearest and of these the first; -1: none."""
        automaton = Automaton(word, most)
        best, stack = (most + 1, -1), [(self.root, automaton.start)]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    if (n := automaton.edits(state)) is not None and (n, child) < best:
                        best = (n, child)
                elif (new := automaton.step(state, c)) is not None:
                    stack.append((child, new))
        return best[1]

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, 0 exact, 1 beginning, 2 misspelt, 3 misspelt and short)."""
        if (t := self.exact.get(word)) is not None:
            return t, 0
        if len(word) > STEM and (t := self.stems.get(word[:STEM])) is not None:
            return t, 1
        if not SHORTEST - 1 <= len(word) <= self.longest + 1 or word in self.plain:
            return None
        near = self.dropped
        if word in near or any(word[:k] + word[k + 1 :] in near for k in range(len(word))):
            if (t := self.misspelt(word)) >= 0:
                return t, 2 if len(self.terms[t]) >= FUZZY else 3
        return None


FEATURES = 9
#: What a hit of each kind weighs of its term; misspellings of short terms have a feature of their own alone.
KINDS = (1.0, 0.9, 0.8, 0.0)


@dataclass
class Model:
    terms: list[str]
    weights: list[float]
    bias: float = -20.0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    #: Words of clean texts, which are no misspellings.
    plain: frozenset[str] = frozenset()

    def start(self) -> None:
        self.trie, self.known = Trie(self.terms, self.plain), {}

    def hits(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(place, term, how) of each word that matches."""
        known = self.known
        try:
            found = list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for w in set(words).difference(known):
                known[w] = self.trie.match(w)
            found = list(map(known.__getitem__, words))
        return [(i, *m) for i, m in enumerate(found) if m is not None] if any(found) else []

    def features(self, text: str) -> list[float]:
        words = words_of(text)
        found = self.hits(words)
        if not found:
            return [0.0] * FEATURES
        inside = quoted_places(words)
        direct = quoted = addressed = most = 0.0
        kinds = [0] * len(KINDS)
        for i, term, how in found:
            kinds[how] += 1
            weight = self.weights[term] * KINDS[how]
            around = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
            most = max(most, weight)
            if inside[i] or not SAYING.isdisjoint(around):
                quoted += weight
            else:
                direct += weight
                addressed += weight > 0 and not ADDRESS.isdisjoint(around)
        n = max(1, len(words))
        return [math.log1p(direct), math.log1p(quoted), math.log1p(addressed), most, *(math.log1p(k) for k in kinds), min(1.0, 10 * sum(kinds[:3]) / n)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients + self.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, ws: Workspace, most: int = LABELLED) -> Model:
    """From the labelled rows given alone (doc_id, toxic)."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = ws.table(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled")
    known = ws.table(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic"), "texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = Counter(), Counter()
            for text, toxic in zip(text_array(batch).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = {w for w in words_of(text) if any(map(str.isalpha, w))}
                words |= {w[:STEM] + "*" for w in words if len(w) > STEM}
                words.add("")
                sums[toxic == 1].update(words)
            both = list({*sums[0], *sums[1]})
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([sums[1][w] for w in both], pa.int64()), pa.array([sums[0][w] for w in both], pa.int64())], names=["word", "toxic", "clean"])

    counts = known.mapInArrow(count, "word string, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = ws.table(counts, "counts")
    words = counts.where((F.col("toxic") >= SUPPORT) | (F.col("word") == "")).count()
    total = counts.where("word = ''").first()
    if total is None or not total.toxic or not total.clean:
        return Model([], [])
    odds = F.log((F.col("toxic") + 0.5) / (total.toxic + 1)) - F.log((F.col("clean") + 0.5) / (total.clean + 1))
    t, c, base = F.col("toxic"), F.col("clean"), total.toxic / (total.toxic + total.clean)
    gain = t * F.log(t / ((t + c) * base)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - base)))).otherwise(0.0)
    terms = counts.where("word <> ''").where(F.col("toxic") >= SUPPORT).withColumn("odds", odds).where((F.col("odds") >= math.log(RATIO)) & (gain >= math.log(words) + SURE))
    found = terms.orderBy(F.col("toxic").desc(), "word").collect()  # words of at most `most` texts, and so are the next
    longest = max((len(r.word) for r in found), default=0)
    plain = counts.where((F.col("clean") >= CLEAN) & F.length("word").between(SHORTEST - 1, longest + 1) & ~F.col("word").endswith("*")).select("word").collect()
    model = Model([r.word for r in found], [min(1.0, r.odds / 6) for r in found], plain=frozenset(r.word for r in plain))
    rows_ = features(known, model).select("f", "toxic").collect()  # `most` rows at most
    x, y = np.array([r.f for r in rows_]).reshape(-1, FEATURES), np.array([r.toxic == 1 for r in rows_], float)
    model.bias, model.coefficients = logistic(x, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, np.ndarray]:
    """Newton's method with a ridge."""
    z, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[-1]), w[:-1]


def features(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, f, and toxic if docs has it as its third column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.start()
        for batch in batches:
            f = [model.features(t) for t in text_array(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.list_(pa.float64())), *batch.columns[2:]], names=["doc_id", "f", *batch.schema.names[2:]])

    extra = ", toxic int" if "toxic" in docs.columns else ""
    return docs.mapInArrow(run, f"doc_id bigint, f array<double>{extra}")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, hits (words that match the lexicon)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.start()
        for batch in batches:
            f = np.array([model.features(t) for t in text_array(batch).to_pylist()]).reshape(-1, FEATURES)
            hits = np.rint(np.expm1(f[:, 4:8]).sum(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(f)), pa.array(hits)], names=["doc_id", "score", "hits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, hits bigint")
