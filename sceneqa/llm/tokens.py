"""Whole-text tokenisation by the tokenizers library with a bounded table of pieces.

Both vocabularies split texts before they merge, and never across the place between a character that is not white space
and a space after it (one of them: never across any space or line feed). So the ids of a text are those of its pieces
in order. Pieces are looked up by hashes, slice by slice, and every hit is held against the bytes of the piece that the
table has; the library encodes each distinct piece once for as long as the table holds it. The vocabulary that keeps spaces merges white space of any kind, so a run of it
is never cut: it goes with the word after it, and with the one before it unless it starts with a space.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa

from sceneqa.llm.common import byte_view, groups, hash_spans, per_value, single_thread, spans, table

#: Pieces that a worker's table holds (some 40 bytes each); beyond it those stay that several slices had.
PIECES = 1_500_000
#: Pieces that the library encodes at a time; its results take about a kilobyte each until their ids are copied.
BATCH = 4_096

_LINES = table(" \n")
#: The last UTF-8 bytes of white space beyond ASCII, as ranges (some neighbours that are not white space are held for it).
_WHITE = ((0xC285, 0xC285), (0xC2A0, 0xC2A0), (0xE19A80, 0xE19A80), (0xE1A08E, 0xE1A08E), (0xE28080, 0xE2808F), (0xE280A8, 0xE280AF), (0xE2819F, 0xE281A0), (0xE38080, 0xE38080), (0xEFBBBF, 0xEFBBBF))
_loaded: dict[tuple[str, bool, int], Encoder] = {}


def _after_blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space may end right before each place; what stands before a text's first byte does not matter."""
    out = data[at - 1] <= 32
    wide = np.flatnonzero(data[at - 1] >= 128)
    if len(wide):
        two = data[at[wide] - 2].astype(np.uint32) << 8 | data[at[wide] - 1]
        three = data[at[wide] - 3].astype(np.uint32) << 16 | two
        for low, high in _WHITE:
            last = two if high <= 0xFFFF else three
            out[wide] |= (low <= last) & (last <= high)
    return out


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The elements of some ranges, one range after another."""
    starts, done = starts.astype(np.int64), np.cumsum(sizes, dtype=np.int64)
    return data[np.repeat(starts - done + sizes, sizes) + np.arange(int(done[-1]) if len(done) else 0)]


def _longer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([a, b.astype(a.dtype)])


class Encoder:
    """Texts to ids of 2 bytes, each text with an end id after it."""

    def __init__(self, path: str, keeps_blanks: bool, end_id: int):
        single_thread()
        from tokenizers import Tokenizer

        self.tok, self.keeps, self.end_id = Tokenizer.from_file(path), keeps_blanks, end_id
        if max(self.tok.get_vocab_size(), end_id) > 1 << 16:
            raise ValueError("the vocabulary needs wider ids")
        none = np.zeros(0, np.uint32)
        #: Ascending hashes and the entry of each; an entry has ids, bytes, and the slices that had it.
        self.hashes, self.entry = np.zeros(0, np.uint64), none
        self.at, self.size, self.text_at, self.text_size, self.used = none, none, none, none, np.zeros(0, np.uint8)
        self.pool, self.text = np.array([end_id], np.uint16), np.zeros(0, np.uint8)

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.keeps:
            return spans(data, bounds, _LINES)
        n = len(data)
        edge = np.zeros(n + 1, bool)
        at = np.flatnonzero(data == 32)
        edge[at[~_after_blank(data, at)]] = True
        edge[bounds] = True
        edge[[0, n]] = True
        cut = np.flatnonzero(edge)
        return cut[:-1], cut[1:]

    def _encode(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """How many ids each text has, and all ids, in parts."""
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)]
        for i in range(0, len(words), BATCH):
            found = [e.ids for e in self.tok.encode_batch_fast(words[i : i + BATCH], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint16, int(sizes[-1].sum())))
        return sizes, ids

    def _learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> None:
        """hashes: of the pieces, ascending."""
        raw = data.tobytes()
        counts, ids = self._encode([raw[a : a + n].decode() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        count, first = np.concatenate(counts), len(self.at)
        to = np.searchsorted(self.hashes, hashes)
        self.hashes, self.entry = np.insert(self.hashes, to, hashes), np.insert(self.entry, to, first + np.arange(len(to)))
        self.at = _longer(self.at, len(self.pool) + np.cumsum(count) - count)
        self.text_at = _longer(self.text_at, len(self.text) + np.cumsum(sizes) - sizes)
        self.size, self.text_size, self.used = _longer(self.size, count), _longer(self.text_size, sizes), _longer(self.used, np.zeros(len(to)))
        self.pool, self.text = np.concatenate([self.pool, *ids]), np.concatenate([self.text, _gather(data, starts, sizes)])

    def _shrink(self) -> None:
        """Leaves the entries that several slices had, if that is half of the table at most."""
        keep = self.used[self.entry] > 1
        if 2 * keep.sum() > PIECES:
            keep[:] = False
        kept = self.entry[keep]
        self.hashes, self.entry = self.hashes[keep], np.arange(len(kept), dtype=np.uint32)
        self.pool = np.r_[self.pool[:1], _gather(self.pool, self.at[kept], self.size[kept])]
        self.text = _gather(self.text, self.text_at[kept], self.text_size[kept])
        self.size, self.text_size, self.used = self.size[kept], self.text_size[kept], np.zeros(len(kept), np.uint8)
        self.at, self.text_at = (b + np.cumsum(n, dtype=np.uint32) - n for b, n in ((np.uint32(1), self.size), (np.uint32(0), self.text_size)))

    def _step(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts in a row, and how many each has."""
        starts, ends = self._pieces(data, bounds)
        sizes, first = ends - starts, per_value(starts, bounds)
        if len(self.hashes) > PIECES:
            self._shrink()
        kinds, where, back = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, kinds)
        known = np.zeros(len(kinds), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == kinds[inside]
        if not known.all():
            new = where[~known]
            self._learn(data, starts[new], sizes[new], kinds[~known])
            at = np.searchsorted(self.hashes, kinds)
        entry = self.entry[at]
        self.used[entry] = np.minimum(self.used[entry], 1) + 1
        # each piece of these texts is held against the bytes of its entry
        mine = entry[back]
        if not np.array_equal(self.text_size[mine], sizes) or not np.array_equal(_gather(self.text, self.text_at[mine], sizes), _gather(data, starts, sizes)):
            raw = data.tobytes()
            counts, ids = self._encode([raw[a:b].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
            n = np.concatenate(counts)
            return np.insert(np.concatenate(ids), np.cumsum(n), self.end_id), n + 1
        # the end id stands in the pool's first place; one goes behind each text's pieces
        begin, size = np.insert(self.at[mine], first[1:], 0), np.insert(self.size[mine], first[1:], 1)
        upto = np.cumsum(size, dtype=np.int64)[first[1:] + np.arange(len(bounds) - 1)]
        return _gather(self.pool, begin, size), np.diff(upto, prepend=0)

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of each text as a binary value, and how many they are."""
        raw, offsets = byte_view(texts)
        ids, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for i, j in groups(offsets):
            a, b = self._step(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids.append(a)
            sizes.append(b)
        flat, n = np.concatenate(ids), np.concatenate(sizes)
        at = np.zeros(len(n) + 1, np.int64)
        np.cumsum(2 * n, out=at[1:])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(flat)]).cast(pa.binary()), n


def encoder(path: str, keeps_blanks: bool, end_id: int) -> Encoder:
    """One encoder a worker. keeps_blanks: the vocabulary encodes a space with what follows it."""
    key = (path, keeps_blanks, end_id)
    if key not in _loaded:
        _loaded[key] = Encoder(path, keeps_blanks, end_id)
    return _loaded[key]
