"""Periodic runs of words: heavy and light lag counting, island scans of the lags that can hold a run.

A run is a stretch of words with smallest period q, at least LEAST and TIMES * q long, that neither neighbour extends. Words q apart
are identical throughout it, so lag q has at least max(LEAST - q, (TIMES - 1) * q) matches. The number of matches at every lag up
to n / TIMES is counted exactly: for words that occur often in a document as the autocorrelation of their places, summed over these words
before one inverse FFT; for the others by the differences of their places, for all documents of a slice at once. A word is heavy
above sqrt(n log n) occurrences, which bounds both parts by n ** 1.5 sqrt(log n). Only lags with enough matches are scanned for islands of matches, and
these first at every fourth place of a run's least length. An island at lag q is a stretch with period q; of stretches with the same
ends the smallest period stays, as a stretch of three periods or more has its smallest period at a divisor.

Words are told apart by their bytes, not by hashes. A document is scanned whole, in one task, whatever its length.

Null and empty texts have no words and no runs, null stays null. Repeated rows and ties are each row's own. An empty table gives no rows. Further
columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sceneqa.llm.common import byte_view, groups, texts

#: The least length of a run in words and in periods.
LEAST, TIMES = 24, 3
RUN = "struct<start: bigint, length: bigint, period: bigint>"
FOUND = f"doc_id bigint, n_words bigint, runs array<{RUN}>, best {RUN}, n_dropped bigint, collapsed string"


def least_matches(q: np.ndarray | int) -> np.ndarray:
    """Consecutive matches at lag q that a run needs."""
    return np.maximum(LEAST - q, (TIMES - 1) * q)


def lag_counts(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches at each lag from 0 to n // TIMES of each document (words ids, one document after another), and where its counts start."""
    limit = sizes // TIMES
    first = np.concatenate(([0], np.cumsum(limit + 1)))
    counts = np.zeros(first[-1], np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(doc * (int(ids.max(initial=0)) + 1) + ids, kind="stable")  # by document and word, then place
    word = ids[order]
    edge = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (doc[order][1:] != doc[order][:-1]), [True])))
    often = np.diff(edge)
    heavy = often > np.ceil(np.sqrt(sizes * np.log2(np.maximum(sizes, 2))))[doc[order[edge[:-1]]]]

    # light words: differences of places k apart in a word's list, while any lie within the limit
    end = np.repeat(edge[1:], often)
    at = np.flatnonzero(np.repeat(~heavy & (often > 1), often))
    k, held, waiting = 1, [], 0
    while len(at):
        at = at[at + k < end[at]]
        gap = order[at + k] - order[at]
        near = gap <= limit[doc[order[at]]]  # places rise, so later ones are further
        at, gap = at[near], gap[near]
        held.append(first[doc[order[at]]] + gap)
        waiting += len(gap)
        k += 1
        if waiting > len(counts) or not len(at):
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, waiting = [], 0

    # heavy words: one spectrum a document
    which = np.flatnonzero(heavy)
    owner = doc[order[edge[which]]]
    start = np.concatenate(([0], np.cumsum(sizes)))
    for d in np.unique(owner).tolist():
        n, lim = int(sizes[d]), int(limit[d])
        size = 1 << (n + lim).bit_length()
        power = np.zeros(size // 2 + 1)
        for g in which[owner == d].tolist():
            x = np.zeros(size)
            x[order[edge[g] : edge[g + 1]] - start[d]] = 1
            f = np.fft.rfft(x)
            power += f.real**2 + f.imag**2
        counts[first[d] : first[d] + lim + 1] += np.rint(np.fft.irfft(power, size)[: lim + 1]).astype(np.int64)
    return counts, first


def islands(ids: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """Starts and ends of stretches of period q with so many consecutive matches or more."""
    a, b = ids[:-q], ids[q:]
    step = least // 4
    if step > 1:  # an island holds four places of every `step`
        hit = a[::step] == b[::step]
        if len(hit) < 4 or not (hit[:-3] & hit[1:-2] & hit[2:-1] & hit[3:]).any():
            return []
    turn = np.flatnonzero(np.diff(np.concatenate(([False], a == b, [False])).astype(np.int8)))
    begin, stop = turn[::2], turn[1::2]
    return [(int(s), int(e) + q) for s, e in zip(begin, stop, strict=True) if e - s >= least]


def find_runs(ids: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """start, length, period of the runs of each document, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    if not len(ids):
        return out
    counts, first = lag_counts(ids, sizes)
    q = np.arange(len(counts)) - np.repeat(first[:-1], np.diff(first))
    ready = np.flatnonzero((q > 0) & (counts >= least_matches(q)))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    seen: dict[tuple[int, int, int], None] = {}
    for d, lag in zip((np.searchsorted(first, ready, "right") - 1).tolist(), q[ready].tolist(), strict=True):  # lags rise within a document
        for s, e in islands(ids[starts[d] : starts[d + 1]], lag, int(least_matches(lag))):
            if (d, s, e) not in seen:
                seen[d, s, e] = None
                out[d].append((s, e - s, lag))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, exactly; ties go to the smallest start, then period."""
    best = None
    for r in runs:  # by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs, best, n_dropped, collapsed: the text without the words that repeat a run's first period, joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ("doc_id", "n_words", "runs", "best", "n_dropped", "collapsed")]
        run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        kinds = [pa.int64(), pa.int64(), pa.list_(run_type), run_type, pa.int64(), pa.string()]
        as_row = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
        for batch in batches:
            whole = batch.column(1)
            for i, j in groups(byte_view(whole)[1]):
                part = whole.slice(i, j - i)
                data, at = byte_view(part)
                words = [data[at[k] : at[k + 1]].tobytes().split() for k in range(j - i)]
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for doc in words for w in doc), np.int64)
                sizes = np.array([len(w) for w in words], np.int64)
                cols: list[list] = [[] for _ in names]
                for k, runs in enumerate(find_runs(ids, sizes)):
                    kept = words[k]
                    if runs:
                        stays = np.ones(len(kept), bool)
                        for s, length, period in runs:
                            stays[s + period : s + length] = False
                        kept = [kept[x] for x in np.flatnonzero(stays).tolist()]
                    text = b" ".join(kept).decode() if part[k].is_valid else None
                    for c, v in zip(cols, (None, len(words[k]), list(map(as_row, runs)), as_row(best_run(runs)), len(words[k]) - len(kept), text), strict=True):
                        c.append(v)
                arrays = [batch.column(0).slice(i, j - i), *[pa.array(c, t) for c, t in zip(cols[1:], kinds[1:], strict=True)]]
                yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, kinds, strict=True)], names=names)

    return texts(docs).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, FOUND)
