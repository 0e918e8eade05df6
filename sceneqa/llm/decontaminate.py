"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are lower-cased runs of digits, letters and non-ASCII characters. Each document's words run through the
automaton, which keeps the longest match that ends at each word; a match of WINDOW words or more covers windows of
items, and a whole item of fewer words counts as one window. Only runs of words that items hold at all are walked;
those are found by hashes of whole batches and looked up by the words themselves.

The automaton is built by the driver from at most BLOCK bytes of item texts and broadcast; a larger benchmark is taken
in blocks of that size, each of which adds its spans and items to those found before.

Null texts have no words. A null or empty item has no window. Items that repeat count once by their id; an item
without an id hits words but isn't listed. Empty tables give no rows, or no hits. Further columns are ignored by
find() and kept by remove().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneqa.llm.common import ALNUM, LOWER, Workspace, byte_view, groups, hash_spans, per_value, spans, text_array

WINDOW = 10
#: Bytes of item texts in one automaton.
BLOCK = 8 << 20


def item_words(text: str | None) -> list[bytes]:
    if not text:
        return []
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    raw = data.tobytes()
    starts, ends = spans(data, np.array([0, len(data)]), ALNUM)
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Automaton:
    """A suffix automaton of all items' words; states know the items of the window that ends in them."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.least = window
        marks: list[set[str]] = [set()]
        whole: dict[int, set[str]] = {}
        for name, words in items:
            if not words:
                continue
            self.least = min(self.least, len(words))
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                while len(marks) < len(self.next):
                    marks.append(set())
        for name, words in items:
            state, names = 0, {name} - {None}
            for w in words:
                state = self.next[state][self.vocabulary[w]]
                marks[state] |= names
            if 0 < len(words) < window:
                whole.setdefault(state, set()).update(names)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in reversed(order):
            if self.length[up := self.link[s]] >= window:
                marks[up] |= marks[s]
        #: For each state that holds a match of a window: the state of that window alone.
        self.holder = [-1] * len(self.next)
        #: For each state the whole short items that end in it: (words, their names).
        self.short: list[list[tuple[int, frozenset[str]]]] = [[] for _ in self.next]
        for s in order:
            up = self.link[s]
            if self.length[s] >= window:
                self.holder[s] = self.holder[up] if self.length[up] >= window else s
            self.short[s] = self.short[up] + [(self.length[s], frozenset(whole[s]))] if s in whole else self.short[up]
        self.items = {s: frozenset(marks[s]) for s in set(self.holder) - {-1}}
        known = list(self.vocabulary)
        data = np.frombuffer(b"".join(known), np.uint8)
        ends = np.cumsum([len(w) for w in known]).astype(np.int64) if known else np.zeros(0, np.int64)
        self.hashes = np.sort(hash_spans(data, np.r_[0, ends[:-1]] if known else ends, ends))

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        state = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return state

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def walk(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """The merged ranges of words that are hit, and the items of the windows."""
        ranges: list[list[int]] = []
        found: set[str] = set()
        state = length = 0
        nexts, links, lengths, window = self.next, self.link, self.length, self.window
        for i, w in enumerate(words):
            c = self.vocabulary.get(w, -1)
            while state and c not in nexts[state]:
                state = links[state]
                length = lengths[state]
            state = nexts[state].get(c, 0)
            length = length + 1 if state else 0
            cover = 0
            if length >= window:
                cover = length
                found |= self.items[self.holder[state]]
            for n, names in self.short[state]:
                if n <= length:
                    cover = max(cover, n)
                    found |= names
            if cover:
                lo = i - cover + 1
                while ranges and ranges[-1][1] >= lo:
                    lo = min(lo, ranges.pop()[0])
                ranges.append([lo, i + 1])
        return ranges, found


def scan(automaton: Automaton, texts: pa.Array) -> Iterator[tuple[int, list[dict[str, int]], set[str]]]:
    """For each text: its number of words, the spans hit (in words and in bytes), the items."""
    raw, offsets = byte_view(texts)
    least = automaton.least
    for i, j in groups(offsets):
        data = LOWER[raw[offsets[i] : offsets[j]]]
        bounds = offsets[i : j + 1] - offsets[i]
        starts, ends = spans(data, bounds, ALNUM)
        first = per_value(starts, bounds)
        results: list[tuple[int, list, set]] = [(int(n), [], set()) for n in np.diff(first)]
        if len(starts) and len(automaton.hashes):
            h = hash_spans(data, starts, ends)
            at = np.minimum(np.searchsorted(automaton.hashes, h), len(automaton.hashes) - 1)
            known = automaton.hashes[at] == h
            edge = np.empty(len(known) + 1, bool)
            edge[0] = edge[-1] = True
            edge[1:-1] = known[1:] != known[:-1]
            edge[first] = True
            cut = np.flatnonzero(edge)
            keep = known[cut[:-1]] & (np.diff(cut) >= least)
            lo, hi = cut[:-1][keep], cut[1:][keep]
            docs = np.searchsorted(first, lo, "right") - 1
            for doc, a, b in zip(docs.tolist(), lo.tolist(), hi.tolist(), strict=True):
                s, e = starts[a:b].tolist(), ends[a:b].tolist()
                text = data[s[0] : e[-1]].tobytes()
                ranges, found = automaton.walk([text[x - s[0] : y - s[0]] for x, y in zip(s, e, strict=True)])
                before, origin = int(first[doc]), int(bounds[doc])
                results[doc][1].extend({"word": a - before + x, "words": y - x, "byte": s[x] - origin, "bytes": e[y - 1] - s[x]} for x, y in ranges)
                results[doc][2].update(found)
        yield from results


SPAN = "array<struct<word:bigint,words:bigint,byte:bigint,bytes:bigint>>"
_SPANS = pa.list_(pa.struct([(k, pa.int64()) for k in ("word", "words", "byte", "bytes")]))


def merged(spans_: list[dict[str, int]]) -> list[dict[str, int]]:
    """Spans of several automata as disjoint ones."""
    out: list[dict[str, int]] = []
    for s in sorted(spans_, key=lambda s: (s["word"], s["words"])):
        if out and s["word"] <= out[-1]["word"] + out[-1]["words"]:
            o = out[-1]
            o["words"] = max(o["words"], s["word"] + s["words"] - o["word"])
            o["bytes"] = max(o["bytes"], s["byte"] + s["bytes"] - o["byte"])
        else:
            out.append(dict(s))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items, so many bytes at a time; the driver holds one block."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").where("length(text) > 0").toLocalIterator():
        held.append((row[0], item_words(row[1])))
        size += len(row[1]) * 4
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans, items for each row."""
    return _find(docs.select("doc_id", "text"), benchmark, window)[0].drop("text")


def _find(docs: DataFrame, benchmark: DataFrame, window: int, cut: tuple[int, float] | None = None) -> tuple[DataFrame, list[str]]:
    """The columns of docs and n_words, spans, items (under names that docs doesn't have, which are returned too).

    cut: in the pass over the last block, removes what remove() says and drops documents of which nothing is left.
    """
    ws = Workspace(docs.sparkSession, "decontaminate")
    names = []
    for name in ("n_words", "spans", "items"):
        while name in (*docs.columns, *names):
            name += "_"
        names.append(name)
    k, at = len(docs.columns), docs.columns.index("text")
    now = docs.select("*", F.lit(0).cast("bigint").alias(names[0]), F.expr(f"cast(array() as {SPAN})").alias(names[1]), F.expr("cast(array() as array<string>)").alias(names[2]))
    schema = now.schema
    blocks = _blocks(benchmark)
    items, number = next(blocks, []), 0
    while items is not None:
        following = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(items, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=following is None) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, hit, found = [], [], []
                for (n, s, own), s0, own0 in zip(scan(shared.value, text_array(batch)), batch.column(k + 1).to_pylist(), batch.column(k + 2).to_pylist(), strict=True):
                    n_words.append(n)
                    hit.append(merged([*s0, *s]) if s or s0 else [])
                    found.append(sorted({*own0, *own}))
                cols = [*batch.columns[:k], pa.array(n_words, pa.int64()), pa.array(hit, _SPANS), pa.array(found, pa.list_(pa.string()))]
                gone = np.zeros(batch.num_rows, bool)
                if cut and last and any(hit):
                    out = cols[at].to_pylist()
                    for i in [i for i, h in enumerate(hit) if h]:
                        out[i], gone[i] = cleaned(out[i], n_words[i], hit[i], *cut)
                    cols[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names).filter(pa.array(~gone))

        now = now.mapInArrow(run, schema)
        if following is not None:
            now = ws.table(now, f"block-{number}")
        items, number = following, number + 1
    return now, names


def cleaned(text: str, n: int, hit: list[dict[str, int]], longest: int, coverage: float) -> tuple[str, bool]:
    """The text without the spans that exceed a limit, and whether that was all of its words."""
    whole = sum(s["words"] for s in hit) > coverage * n
    gone = [s for s in hit if whole or s["words"] >= longest]
    raw, at, parts = text.encode(), 0, []
    for s in gone:
        parts.append(raw[at : s["byte"]])
        at = s["byte"] + s["bytes"]
    return b"".join([*parts, raw[at:]]).decode(), sum(s["words"] for s in gone) == n


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, longest: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """The documents without the spans of so many words or more; also without shorter ones if spans cover more than
    that part of the document's words. A document of which no word is left goes; one that had none stays.
    """
    return _find(docs, benchmark, window, (longest, coverage))[0].select(*[F.col(f"`{c}`") for c in docs.columns])
