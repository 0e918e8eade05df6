"""LM scoring with an Elias-Fano n-gram trie whose slices meet the texts that need them.

The model has order ORDER: p(w | h) = (c(hw) + M p(w | h')) / (c(h) + M), where h' is h without its first word and the
lowest order is the smoothed share of a token, with one more type for unknown words. In back-off form an n-gram that
was seen has its own probability, and one that wasn't has that of the shorter one times the context's M / (c(h) + M).

Texts are cut into chunks of bounded size. A chunk asks the shards for the counts of its distinct n-grams: sorted keys
with its own training counts, dealt by leading bits. A shard adds the counts of all chunks that hold a key and answers
in the same order. So counts cover the whole corpus, no n-gram is ever gathered by occurrences, and a frequent one costs each chunk one
key. With the answers a chunk builds its slice of the trie, maps it, and looks up the n-gram that ends in each token, order
by order, each by a successor search relative to its context. A slice is as large as its chunk, however
large the corpus is.

Keys of n-grams have 20 bits more than their number needs, keys of words all 64 bits of their hashes.

train() stores a model: the distinct n-grams of training texts with their counts, shard by shard. score() with such a model
learns nothing from its documents; the model's shards answer their requests as the chunks of a corpus would.

Null and empty texts consist of the end token. Repeated rows are scored, and counted if they are for training, each time they
stand. A row without doc_id is not for training. Without any training text all counts are 0. An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneqa.llm.common import BLANK, LOWER, Workspace, byte_view, hash_spans, mix, per_value, spans, text_array
from sceneqa.llm.eliasfano import Trie
from sceneqa.llm.substrings import pack_sorted, unpack_sorted

ORDER = 3
#: The weight of the shorter context, in observations, for orders 2 and 3 (best of a few on a part of training texts).
WEIGHTS = (3000.0, 5.0)
#: Bytes of text in a chunk, and keys in a shard, about.
CHUNK_BYTES, SHARD_KEYS = 4 << 20, 4_000_000
#: The end token's hash.
END = np.uint64(0x8E51A2C3D4B69707)

CHUNKS = "chunk bigint, n_tokens bigint, train_tokens bigint, doc_ids array<bigint>, held array<boolean>, sizes array<int>, words binary, ids binary"


def _squeeze(raw: bytes) -> bytes:
    """Bytes behind their number, entropy-coded: shuffles compress repeats alone."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _open(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def _planes(ids: np.ndarray) -> bytes:
    return _squeeze(np.ascontiguousarray(ids.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def _ids(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_open(raw), np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def chunks(docs: DataFrame, held_out) -> DataFrame:
    """Rows of whole documents as token ids into the chunk's own words; to be written before use. held_out: a Column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        hashes, sizes, doc_ids, held = [], [], [], []

        def close() -> pa.RecordBatch:
            words, ids = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.concatenate(sizes)
            train = int(n[~np.array(held, bool)].sum())
            row = [(part << 24) + number, int(n.sum()), train, doc_ids, held, n.tolist(), pack_sorted(words), _planes(ids)]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in CHUNKS.split(", ")])

        size = 0
        for batch in batches:
            data, bounds = byte_view(text_array(batch))
            ids, out = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            i = 0
            while i < len(ids):
                j = min(len(ids), max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK_BYTES - size, "right")) - 1))
                part_, b = LOWER[data[bounds[i] : bounds[j]]], bounds[i : j + 1] - bounds[i]
                starts, ends = spans(part_, b, BLANK)
                first = per_value(starts, b)
                hashes.append(np.insert(hash_spans(part_, starts, ends), first[1:], END))
                sizes.append(np.diff(first) + 1)
                doc_ids += ids[i:j]
                held += out[i:j]
                size += int(b[-1]) + 8 * (j - i)
                i = j
                if size >= CHUNK_BYTES:
                    yield close()
                    number, size = number + 1, 0
                    hashes, sizes, doc_ids, held = [], [], [], []
        if doc_ids:
            yield close()

    return docs.select("doc_id", "text", F.coalesce(held_out, F.lit(True)).alias("held")).mapInArrow(run, CHUNKS)


class Grams:
    """The distinct n-grams of a chunk: for each order their word places, their keys and their training counts."""

    def __init__(self, words: np.ndarray, ids: np.ndarray, sizes: np.ndarray, held: np.ndarray, key_bits: int):
        self.words, self.ids = words, ids
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        train = ~np.repeat(held, sizes)
        v = len(words)
        self.grams, self.keys, self.counts, self.order, self.places = [], [], [], [], []
        mixed = mix(words, 9)
        low = np.uint64(64 - key_bits)
        context = None
        for n in range(1, ORDER + 1):
            if n == 1:
                self.grams.append((None, np.arange(v)))
                keys = words
                counts = np.bincount(ids[train], minlength=v)
                place = ids
            else:
                inside = self.doc[n - 1 :] == self.doc[: len(ids) - n + 1] if len(ids) >= n else np.zeros(0, bool)
                at = np.flatnonzero(inside) + n - 1
                # the gram before this word, in the level below, and the word
                pair = context[at - 1].astype(np.uint64) * np.uint64(v) + ids[at].astype(np.uint64)
                kinds, back = np.unique(pair, return_inverse=True)
                c, w = (kinds // np.uint64(v)).astype(np.int64), (kinds % np.uint64(v)).astype(np.int64)
                self.grams.append((c, w))
                keys = mix(self.hash[c] * np.uint64(0x9E3779B97F4A7C15) + mixed[w], n) >> low
                counts = np.bincount(back[train[at]], minlength=len(kinds))
                place = np.full(len(ids), -1)
                place[at] = back
            self.hash = mixed if n == 1 else mix(self.hash[c] * np.uint64(0x9E3779B97F4A7C15) + mixed[w], n)
            context = place
            self.places.append(place)
            order = np.argsort(keys, kind="stable") if n > 1 else np.arange(v)
            self.keys.append(keys[order])
            self.counts.append(counts[order])
            self.order.append(order)

    def shards(self, n: int, bits: int, key_bits: int) -> np.ndarray:
        width = 64 if n == 1 else key_bits
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits)
        return np.r_[0, np.searchsorted(self.keys[n - 1], edges), len(self.keys[n - 1])]


def _grams(row: dict, key_bits: int) -> Grams:
    return Grams(unpack_sorted(row["words"]), _ids(row["ids"]), np.array(row["sizes"], np.int64), np.array(row["held"], bool), key_bits)


def _counts(x: np.ndarray) -> bytes:
    """Counts as a byte each, and those of 255 and more behind them."""
    large = x[x >= 255].astype(np.uint64)
    return _squeeze(np.minimum(x, 255).astype(np.uint8).tobytes() + large.tobytes())


def _uncounted(raw: bytes, n: int) -> np.ndarray:
    raw = _open(raw)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.uint64, offset=n).astype(np.int64)
    return out


REQUESTS = "shard bigint, n bigint, chunk bigint, keys binary, counts binary"


def requests(table: DataFrame, bits: int, key_bits: int) -> DataFrame:
    """shard, n (order), chunk, keys, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g, out = _grams(row, key_bits), []
                for n in range(1, ORDER + 1):
                    edges = g.shards(n, bits, key_bits)
                    out += [(s, n, row["chunk"], pack_sorted(g.keys[n - 1][a:b]), _counts(g.counts[n - 1][a:b])) for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["shard", "n", "chunk", "keys", "counts"])

    return table.mapInArrow(run, REQUESTS)


def answers(asked: DataFrame) -> DataFrame:
    """chunk, n, shard, counts over all chunks; and for each shard of words a row with chunk -1 and the known words."""

    def run(table: pa.Table) -> pa.Table:
        n, shard = table["n"][0].as_py(), table["shard"][0].as_py()
        keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        sizes = [len(k) for k in keys]
        counts = np.concatenate([_uncounted(x, k) for x, k in zip(table["counts"].to_pylist(), sizes, strict=True)])
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        new = np.ones(len(flat), bool)
        new[1:] = flat[order[1:]] != flat[order[:-1]]
        first = np.flatnonzero(new)
        sums = np.add.reduceat(counts[order], first)
        total = np.empty(len(flat), np.int64)
        total[order] = np.repeat(sums, np.diff(np.r_[first, len(flat)]))
        ends = np.cumsum(sizes)
        out = [(c, n, shard, _counts(total[e - k : e]), 0) for c, k, e in zip(table["chunk"].to_pylist(), sizes, ends.tolist(), strict=True) if c >= 0]
        if n == 1:
            out.append((-1, n, shard, b"", int((sums > 0).sum())))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["chunk", "n", "shard", "counts", "known"])

    return asked.groupBy("n", "shard").applyInArrow(run, "chunk bigint, n bigint, shard bigint, counts binary, known bigint")


def slice_of(g: Grams, counts: list[np.ndarray], total: int, types: int, weights: tuple[float, ...]) -> Trie:
    """The trie of the chunk's n-grams that training texts hold. counts: in the order of the grams."""
    floor = total + 0.5 * (types + 1)
    have = counts[0] > 0
    place = np.full(len(have), -1)
    place[have] = np.arange(have.sum())
    c1 = counts[0][have]
    p = np.full(len(have), 0.5 / floor)
    p[have] = (c1 + 0.5) / floor
    levels, probs, backs = [], [np.log10(p[have])], [np.log10(weights[0] / (c1 + weights[0]))]
    at, full = place, [p]  # at: the place of each gram of the level below in its level, or -1
    below_counts = counts[0]
    for n in range(2, ORDER + 1):
        context, word = g.grams[n - 1]
        c, m = counts[n - 1], weights[n - 2]
        # p(w | h') is that of the gram without its first word
        shorter = full[0][word] if n == 2 else full[n - 2][_tails(g)]
        h = below_counts[context]
        q = (c + m * shorter) / (h + m)
        seen = (c > 0) & (at[context] >= 0)
        order = np.flatnonzero(seen)
        levels.append((at[context[order]], place[word[order]]))
        probs.append(np.log10(q[order]))
        backs.append(np.log10(weights[n - 1] / (c[order] + weights[n - 1])) if n < ORDER else np.zeros(len(order)))
        nxt = np.full(len(c), -1)
        nxt[order] = np.arange(len(order))
        at, below_counts = nxt, c
        full.append(q)
    return Trie.map(Trie.build(g.words[have], levels, probs, backs))


def _tails(g: Grams) -> np.ndarray:
    """For each trigram the place of its last two words among the bigrams, found once for a chunk."""
    if hasattr(g, "tail"):
        return g.tail
    v = np.uint64(len(g.words))
    (c2, w2), (c3, w3) = g.grams[1], g.grams[2]
    pairs = c2.astype(np.uint64) * v + w2.astype(np.uint64)  # ascending
    g.tail = np.searchsorted(pairs, w2[c3].astype(np.uint64) * v + w3.astype(np.uint64))
    return g.tail


def log_probs(trie: Trie, g: Grams, unknown: float) -> np.ndarray:
    """The model's log10 probability of each token. unknown: that of an unknown word.

    Each distinct n-gram is looked up once, behind the place of its context.
    """
    word = trie.word(g.words)
    known = word >= 0
    p = np.full(len(word), unknown)
    p[known] = trie.log_prob(1, word[known])
    out = p[g.ids]
    context, shorter = word, p
    for n in range(2, ORDER + 1):
        c, w = g.grams[n - 1]
        before = context[c]
        here = trie.child(n, before, word[w])
        p = shorter[w] if n == 2 else shorter[_tails(g)]
        seen = before >= 0
        p[seen] += trie.log_back(n - 1, before[seen])
        p[here >= 0] = trie.log_prob(n, here[here >= 0])
        at = g.places[n - 1]
        out[at >= 0] = p[at[at >= 0]]
        context, shorter = here, p
    return out


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scored(table: DataFrame, told: DataFrame, bits: int, key_bits: int, total: int, types: int, weights: tuple[float, ...]) -> DataFrame:
    floor = total + 0.5 * (types + 1)

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in chunk.to_pylist():
            g = _grams(row, key_bits)
            counts = []
            for n in range(1, ORDER + 1):
                edges, got = g.shards(n, bits, key_bits), np.zeros(len(g.keys[n - 1]), np.int64)
                mine = replies.filter(pa.compute.equal(replies["n"], n))
                for s, raw in zip(mine["shard"].to_pylist(), mine["counts"].to_pylist(), strict=True):
                    a, b = int(edges[s]), int(edges[s + 1])
                    got[a:b] = _uncounted(raw, b - a)
                back = np.empty(len(got), np.int64)
                back[g.order[n - 1]] = got
                counts.append(back)
            trie = slice_of(g, counts, total, types, weights)
            sizes = np.array(row["sizes"], np.int64)
            starts = np.cumsum(sizes) - sizes
            c = counts[0][g.ids]
            base = np.add.reduceat(np.log10((c + 0.5) / floor), starts)
            model = np.add.reduceat(log_probs(trie, g, np.log10(0.5 / floor)), starts)
            known = np.add.reduceat((c > 0).astype(np.int64), starts)
            cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), total)), pa.array(base), pa.array(model)]
            out.append(pa.table(cols, names=[x.split()[0] for x in RESULT.split(", ")]))
        return pa.concat_tables(out) if out else pa.schema([(n, {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in (x.split() for x in RESULT.split(", "))]).empty_table()

    return table.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, RESULT)


#: The chunk that a stored model's rows have.
MODEL = -2


def train(docs: DataFrame, path: str, held_out=None, bits: int = 8, key_bits: int = 60) -> None:
    """Stores the model of the rows that aren't held out under a folder that all executors share: grams (the shards' distinct
    n-grams and their counts) and totals, one row. bits: of the number of shards.
    """
    ws = Workspace(docs.sparkSession, "ngrams-train")
    table = ws.table(chunks(docs, F.lit(False) if held_out is None else held_out), "chunks")

    def run(table: pa.Table) -> pa.Table:
        n, shard = table["n"][0].as_py(), table["shard"][0].as_py()
        keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        counts = np.concatenate([_uncounted(x, len(k)) for x, k in zip(table["counts"].to_pylist(), keys, strict=True)])
        kinds, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(back, counts, len(kinds)).astype(np.int64)
        row = {"shard": shard, "n": n, "chunk": MODEL, "keys": pack_sorted(kinds[sums > 0]), "counts": _counts(sums[sums > 0]), "distinct": int((sums > 0).sum())}
        return pa.Table.from_pylist([row], pa.schema([(k, pa.binary() if k in ("keys", "counts") else pa.int64()) for k in row]))

    merged = requests(table, bits, key_bits).groupBy("n", "shard").applyInArrow(run, f"{REQUESTS}, distinct bigint")
    merged.write.option("compression", "zstd").parquet(f"{path}/grams")
    grams = docs.sparkSession.read.schema(f"{REQUESTS}, distinct bigint").parquet(f"{path}/grams")
    types = grams.where("n = 1").agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("types"))
    total = table.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)).alias("tokens"))
    total.join(F.broadcast(types)).withColumns({"bits": F.lit(bits), "key_bits": F.lit(key_bits)}).write.parquet(f"{path}/totals")


def score(docs: DataFrame, held_out, weights: tuple[float, ...] = WEIGHTS, model: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row. held_out: a boolean Column.

    model: the folder of a stored model, which then is all there is to learn from; every row counts as held out.
    """
    ws = Workspace(docs.sparkSession, "ngrams")
    if model:
        known = docs.sparkSession.read.parquet(f"{model}/totals").first()
        grams = docs.sparkSession.read.schema(REQUESTS).parquet(f"{model}/grams")
        table = ws.table(chunks(docs, F.lit(True)), "chunks")
        told = ws.table(answers(requests(table, known.bits, known.key_bits).union(grams)).where("chunk >= 0"), "told")
        ws.release()
        return scored(table, told, known.bits, known.key_bits, known.tokens, known.types, weights)
    table = ws.table(chunks(docs, held_out), "chunks")
    sums = table.agg(F.sum("n_tokens").alias("n"), F.sum("train_tokens").alias("train")).first()
    n = max(1, sums.n or 0)
    bits = max(3, (2 * n // SHARD_KEYS).bit_length())
    key_bits = min(64, max(bits + 8, (2 * n).bit_length() + 20))
    told = ws.table(answers(requests(table, bits, key_bits)), "told")
    ws.release()
    types = told.where("chunk = -1").agg(F.sum("known")).first()[0] or 0
    return scored(table, told.where("chunk >= 0"), bits, key_bits, sums.train or 0, types, weights)
