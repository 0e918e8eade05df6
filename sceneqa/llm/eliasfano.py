"""Elias-Fano sequences and an n-gram trie made of them, in one buffer that can be mapped.

A sequence of n ascending numbers below u keeps the low bits of each, about log2(u / n), in packed words, and the high
bits in unary: one set bit per number, one clear bit per step. Numbers from a place on (successor search) are found by
the position of a clear bit, with one directory entry in 16 clear bits, and a search among the few numbers that share
their high bits. All queries run on arrays.

The trie has a level per order. Level one holds the hashes of words. A higher level holds, context by context, the places of
the last words in level one; context c adds c times the number of words, which makes the level ascending, so the
children of a context are searched relative to it. Pointers, ascending too, say where the children of each entry
begin. Log probabilities and back-off weights are quantised to 16 bits.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

_HEAD = struct.Struct("<QQQQQQ")
#: Steps of the quantised logarithms (base 10).
STEP = 1 / 4096


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of so many bits each, one after another, with a word of room at the end."""
    n = len(values)
    out = np.zeros(n * bits // 64 + 2, np.uint64)
    if not bits:
        return out
    at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    np.bitwise_or.at(out, word, values << shift)
    over = shift + np.uint64(bits) > 64
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


class Sequence:
    """Ascending numbers (equal ones allowed)."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, skip: np.ndarray):
        self.n, self.bits, self.low, self.high, self.skip = n, bits, low, high, skip

    @classmethod
    def of(cls, values: np.ndarray, below: int) -> Sequence:
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, (below // max(n, 1)).bit_length() - 1)
        top = values >> np.uint64(bits)
        steps = int(below - 1 >> bits) + 1 if below else 1
        at = top.astype(np.int64) + np.arange(n)
        high = np.zeros((n + steps) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        # the numbers before every 16th clear bit
        marks = np.arange(0, steps + 1, 16)
        return cls(n, bits, _packed(values & np.uint64((1 << bits) - 1), bits), high, np.searchsorted(top, marks).astype(np.uint32))

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.skip.tobytes() + b"\0" * (-4 * len(self.skip) % 8)]
        return _HEAD.pack(self.n, self.bits, len(self.low), len(self.high), len(self.skip), 0) + b"".join(parts)

    @classmethod
    def at(cls, buffer, place: int) -> tuple[Sequence, int]:
        """The sequence that begins at a place of a buffer, and the place after it."""
        n, bits, low, high, skip, _ = _HEAD.unpack_from(buffer, place)
        place += _HEAD.size
        out = []
        for kind, k in ((np.uint64, low), (np.uint64, high), (np.uint32, skip)):
            out.append(np.frombuffer(buffer, kind, k, place))
            place += (out[-1].nbytes + 7) // 8 * 8
        return cls(n, bits, *out), place

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        first = self.low[word] >> shift
        rest = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | rest) & np.uint64((1 << self.bits) - 1)

    def _before(self, top: np.ndarray) -> np.ndarray:
        """How many numbers have high bits below `top`: those before its clear bit."""
        block = top >> 4
        n = self.skip[block].astype(np.int64)
        at = n + (block << 4)  # the place in the unary part where the block begins
        left = top & 15  # clear bits still to pass
        word = at >> 6
        bits = ~self.high[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) << (at & 63).astype(np.uint64))
        go = np.flatnonzero(left > 0)
        out = at.copy()
        w, b, k = word[go], bits[go], left[go]
        while len(go):
            here = np.bitwise_count(b).astype(np.int64)
            done = here >= k
            if done.any():
                out[go[done]] = (w[done] << 6) + _select(b[done], k[done]) + 1
            go, w, k = go[~done], w[~done] + 1, (k - here)[~done]
            b = ~self.high[w] if len(go) else b
        return out - top

    def _ones(self, at: np.ndarray) -> np.ndarray:
        """How many set bits stand in a row from each place of the unary part."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        clear = ~(self.high[word] >> shift)
        # the bits below the lowest clear one
        out = np.bitwise_count(~clear & (clear - np.uint64(1))).astype(np.int64)
        go = np.flatnonzero(out + (at & 63) >= 64)
        out[go] = 64 - (at[go] & 63)
        word = word[go] + 1
        while len(go):
            bits = ~self.high[word]
            n = np.where(bits == 0, 64, np.bitwise_count(~bits & (bits - np.uint64(1)))).astype(np.int64)
            out[go] += n
            go, word = go[n == 64], word[n == 64] + 1
        return out

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first number that is not smaller than each value, and whether it equals it."""
        values = values.astype(np.uint64)
        top, want = (values >> np.uint64(self.bits)).astype(np.int64), values & np.uint64((1 << self.bits) - 1)
        lo = self._before(top)
        end = lo + self._ones(lo + top)
        hi = end.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.lows(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        hit = lo < end
        hit[hit] = self.lows(lo[hit]) == want[hit]
        return lo, hit

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at some places, by halving over the directory's counts."""
        block = np.searchsorted(self.skip, i, "right") - 1
        lo, hi = block << 4, np.minimum((block + 1) << 4, (64 * len(self.high) - self.n - 1))
        while True:  # the largest top of which at most i numbers have smaller high bits
            open_ = np.flatnonzero(hi - lo > 1)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            below = self._before(mid) <= i[open_]
            lo[open_] = np.where(below, mid, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        return (lo.astype(np.uint64) << np.uint64(self.bits)) | self.lows(i)


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit (from 1) of each word."""
    at, left, w = np.zeros(len(words), np.int64), k.copy(), words
    for width in (32, 16, 8, 4, 2, 1):
        part = np.bitwise_count(w & np.uint64((1 << width) - 1)).astype(np.int64)
        right = left > part
        left = np.where(right, left - part, left)
        at += np.where(right, width, 0)
        w = np.where(right, w >> np.uint64(width), w)
    return at


def quantise(x: np.ndarray) -> np.ndarray:
    """Logarithms from -15.99 to 0 in 16 bits."""
    return np.clip(np.rint(-x / STEP), 0, 65_535).astype(np.uint16)


class Trie:
    """Levels over one buffer: words, then for each further order the children of the level before."""

    def __init__(self, buffer):
        self.buffer = buffer
        orders, place = struct.unpack_from("<Q", buffer)[0], 8
        self.levels, self.pointers, self.prob, self.back = [], [None], [], []
        for k in range(orders):
            if k:
                seq, place = Sequence.at(buffer, place)
                self.pointers.append(seq)
            seq, place = Sequence.at(buffer, place)
            self.levels.append(seq)
            for out in (self.prob, self.back):
                out.append(np.frombuffer(buffer, np.uint16, seq.n, place))
                place += (2 * seq.n + 7) // 8 * 8
        self.words = self.levels[0].n

    @staticmethod
    def build(words: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], probs: list[np.ndarray], backs: list[np.ndarray]) -> bytes:
        """words: ascending distinct hashes; levels: for each further order the place of the context in the level before
        (ascending) and of the last word in level one (ascending within a context).
        """
        out = [struct.pack("<Q", 1 + len(levels))]
        below = len(words)
        for k, (p, b) in enumerate(zip(probs, backs, strict=True)):
            if k:
                context, word = levels[k - 1]
                begin = np.searchsorted(context, np.arange(below + 1))
                out.append(Sequence.of(begin, len(context) + 1).to_bytes())
                out.append(Sequence.of(context.astype(np.uint64) * np.uint64(len(words)) + word.astype(np.uint64), max(1, below * len(words))).to_bytes())
                below = len(context)
            else:
                out.append(Sequence.of(words, 1 << 64).to_bytes())
            for x in (p, b):
                raw = quantise(x).tobytes()
                out.append(raw + b"\0" * (-len(raw) % 8))
        return b"".join(out)

    @classmethod
    def map(cls, image: bytes) -> Trie:
        """The trie in memory pages of its own that the system can take back, not on the heap."""
        area = mmap.mmap(-1, max(1, len(image)))
        area.write(image)
        return cls(area)

    def word(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word in level one, -1 if it is not there."""
        at, hit = self.levels[0].successor(hashes)
        return np.where(hit, at, -1)

    def child(self, order: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place, in the level of an order, of a word behind a context of the level before; -1 if it is not there."""
        out = np.full(len(context), -1, np.int64)
        ok = np.flatnonzero((context >= 0) & (word >= 0))
        if len(ok) and self.levels[order - 1].n:
            at, hit = self.levels[order - 1].successor(context[ok].astype(np.uint64) * np.uint64(self.words) + word[ok].astype(np.uint64))
            out[ok[hit]] = at[hit]
        return out

    def children(self, order: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the children of some contexts begin and end in the level of an order."""
        return self.pointers[order - 1].get(context).astype(np.int64), self.pointers[order - 1].get(context + 1).astype(np.int64)

    def log_prob(self, order: int, place: np.ndarray) -> np.ndarray:
        return self.prob[order - 1][place] * -STEP

    def log_back(self, order: int, place: np.ndarray) -> np.ndarray:
        return self.back[order - 1][place] * -STEP
