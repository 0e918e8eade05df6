"""Substring dedup with a log-structured index of window fingerprints.

Documents are sorted by doc_id over range partitions, and each partition is cut into parts of bounded bytes, wherever
documents end. Each part gives one immutable run: the
sorted distinct fingerprints of its windows, dealt to shards by their leading bits. A shard merge-joins the runs of all
parts (and those of earlier batches) in order and tells each part which of its fingerprints an earlier run holds: one
bit each. A part then removes the words of windows that an earlier run or an earlier window of its own has.

A fingerprint has 20 bits more than the number of windows needs (60 at most), by which runs are sorted and merged, and a
second hash of 4 to 8 bytes, which other functions make from the words' bytes, that verifies a meeting before it counts. Both together
have 20 bits more than the number of pairs of windows needs (check_bytes()), so that any two different windows of all are taken for one with a probability of
2**-20 at most, up to 2**50 windows. An index, which grows, uses 60 and 64 bits throughout.

Parts are written once, so both passes see the same ones. Index keeps runs of earlier batches for incremental work: dedup()
with an index compares a new batch with them, appends the batch's runs and merges runs when they are many.

Null and empty texts have no words. Repeated rows are documents of their own in the order of their texts' hashes, so
every one after the first loses all of its words that windows cover; a null doc_id comes before all others. Fewer words than
a window are never removed. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneqa.llm.common import BLANK, Workspace, byte_view, hash_spans, per_value, rolling, spans, text_array

WINDOW = 20
#: Bytes of text in a part, and fingerprints in a shard, about.
PART_BYTES, SHARD_KEYS = 6 << 20, 4_000_000
#: Runs in an index beyond which they are merged.
RUNS = 8
#: Bits of an index's fingerprints, and bytes of its second hash.
INDEX_BITS, INDEX_BYTES = 60, 8
_MULTIPLIERS = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte: high bytes, mostly zero, lie together."""
    if not len(keys):
        return b""
    step = np.diff(keys, prepend=np.uint64(0))
    step[0] = keys[0]
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return np.cumsum(out.view(np.uint64).ravel())


def _pack(high: np.ndarray, low: np.ndarray, low_bytes: int) -> bytes:
    body = pack_sorted(high)
    return bytes([low_bytes]) + len(body).to_bytes(4, "little") + body + np.ascontiguousarray(low.view(np.uint8).reshape(len(low), low.itemsize)[:, :low_bytes].T).tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    low_bytes, k = raw[0], int.from_bytes(raw[1:5], "little")
    high = unpack_sorted(raw[5 : 5 + k])
    kind = _low_type(low_bytes)
    out = np.zeros((len(high), kind.itemsize), np.uint8)
    out[:, :low_bytes] = np.frombuffer(raw, np.uint8, offset=5 + k).reshape(low_bytes, len(high)).T
    return high, out.view(kind).ravel()


def _low_type(low_bytes: int) -> np.dtype:
    return np.dtype(np.uint32 if low_bytes <= 4 else np.uint64)


class Part:
    """The words and windows of some documents in order."""

    def __init__(self, texts: pa.Array, window: int, key_bits: int, low_bytes: int):
        self.key_bits = key_bits
        self.data, self.bounds = byte_view(texts)
        self.starts, self.ends = spans(self.data, self.bounds, BLANK)
        self.first = per_value(self.starts, self.bounds)
        n = len(self.starts)
        doc = np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))
        word = hash_spans(self.data, self.starts, self.ends)
        whole = doc[window - 1 :] == doc[: max(0, n - window + 1)]
        self.at = np.flatnonzero(whole)
        high = rolling(word, window, _MULTIPLIERS[0])[whole] >> np.uint64(64 - key_bits)
        low = (rolling(hash_spans(self.data, self.starts, self.ends, 1), window, _MULTIPLIERS[1])[whole] >> np.uint64(64 - 8 * low_bytes)).astype(_low_type(low_bytes))
        order = np.lexsort((low, high)) if len(high) else np.zeros(0, np.int64)  # stable: equal ones stay in order
        high, low = high[order], low[order]
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        self.order, self.new = order, new
        self.high, self.low = high[new], low[new]

    def shards(self, bits: int) -> np.ndarray:
        """The first fingerprint of each shard, and at the end their number."""
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(self.key_bits - bits)
        return np.r_[0, np.searchsorted(self.high, edges), len(self.high)]

    def covered(self, seen: np.ndarray, window: int) -> np.ndarray:
        """For each word whether a window that starts earlier too covers it; seen: whether an earlier run has a fingerprint."""
        gone = ~self.new | seen[np.cumsum(self.new) - 1] if len(self.new) else self.new
        at = self.at[self.order[gone]]
        step = np.bincount(at, minlength=len(self.starts) + 1) - np.bincount(at + window, minlength=len(self.starts) + 1)
        return np.cumsum(step[: len(self.starts)]) > 0


PARTS = "part bigint, docs binary"


def parts(docs: DataFrame, ws: Workspace, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """part (ascending in the order of documents) and docs, its doc_id and text in compressed form; and the windows there are at most (a word has a byte and a blank).

    Null doc_ids come first; rows that repeat one stand in the order of their texts' hashes.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")

        def close() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "docs"])

        for batch in batches:
            bounds = byte_view(batch.column(1))[1]
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + part_bytes - size, "right")) - 1)
                j = min(j, batch.num_rows)
                held.append(batch.slice(i, j - i))
                size += int(bounds[j] - bounds[i]) + 16 * (j - i)
                i = j
                if size >= part_bytes or i < batch.num_rows:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    many = max(1, -(-size // (8 * part_bytes)), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.repartitionByRange(many, *order).sortWithinPartitions(*order)
    out = ws.table(dealt.mapInArrow(pack, PARTS), "parts")
    ws.release()
    return out, size // 2


def _opened(raw: bytes) -> tuple[pa.Array, pa.Array]:
    """The doc_ids and texts of a part."""
    docs = pa.Table.from_batches(list(pa.ipc.open_stream(raw))).combine_chunks()
    return docs["doc_id"].chunk(0), docs["text"].chunk(0)


def runs(numbered: DataFrame, bits: int, key_bits: int, low_bytes: int, window: int, before: int = 0) -> DataFrame:
    """shard, run, n, keys: each part's run, numbered after `before`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, docs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = Part(_opened(docs.as_buffer())[1], window, key_bits, low_bytes)
                edges = part.shards(bits)
                rows = [(s, number + before, int(b - a), _pack(part.high[a:b], part.low[a:b], low_bytes)) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["shard", "run", "n", "keys"])

    return numbered.mapInArrow(run, "shard bigint, run bigint, n bigint, keys binary")


def _merge(table: pa.Table) -> tuple[list[int], list[int], np.ndarray]:
    """The runs in order, their sizes, and for each fingerprint whether an earlier run has it."""
    table = table.sort_by("run")
    keys = [_unpack(x) for x in table["keys"].to_pylist()]
    high, low = np.concatenate([k[0] for k in keys]), np.concatenate([k[1] for k in keys])
    order = np.argsort(high, kind="stable")  # runs are sorted: merging them is what is left to do
    sorted_ = high[order]
    same = np.zeros(len(high) + 1, bool)
    same[1:-1] = sorted_[1:] == sorted_[:-1]
    some = order[same[1:] | same[:-1]]  # fingerprints that meet another
    some = some[np.lexsort((some, low[some], high[some]))]
    seen = np.zeros(len(high), bool)
    seen[some[1:]] = (high[some[1:]] == high[some[:-1]]) & (low[some[1:]] == low[some[:-1]])
    return table["run"].to_pylist(), [len(k[0]) for k in keys], seen


def seen_before(all_runs: DataFrame, before: int = 0) -> DataFrame:
    """run, shard, bits: of each run from number `before` on, which fingerprints an earlier run has."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        numbers, sizes, seen = _merge(table)
        out, at = [], 0
        for r, n in zip(numbers, sizes, strict=True):
            if r >= before:
                out.append((r, shard, np.packbits(seen[at : at + n]).tobytes() if seen[at : at + n].any() else b""))
            at += n
        kinds = [pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["run", "shard", "bits"])

    return all_runs.groupBy("shard").applyInArrow(run, "run bigint, shard bigint, bits binary")


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def removed(numbered: DataFrame, told: DataFrame, bits: int, key_bits: int, low_bytes: int, window: int, before: int, with_text: bool) -> DataFrame:
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts = _opened(docs["docs"][0].as_py())
        part = Part(texts, window, key_bits, low_bytes)
        seen, edges = np.zeros(len(part.high), bool), part.shards(bits)
        for shard, raw in zip(replies["shard"].to_pylist(), replies["bits"].to_pylist(), strict=True):
            if raw:
                a, b = int(edges[shard]), int(edges[shard + 1])
                seen[a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a).astype(bool)
        gone = part.covered(seen, window)
        removed_, first, raw = np.diff(np.r_[0, np.cumsum(gone)][part.first]), part.first.tolist(), part.data.tobytes()
        shas, kept = [], []
        for i, n in enumerate(removed_.tolist()):
            words = raw[part.bounds[i] : part.bounds[i + 1]].split()
            text = b" ".join(compress(words, (~gone[first[i] : first[i + 1]]).tolist()) if n else words)
            shas.append(hashlib.sha256(text).hexdigest())
            kept.append(text.decode() if with_text else None)
        return pa.table([ids, pa.array(np.diff(part.first)), pa.array(removed_), pa.array(shas, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    told = told.withColumn("part", F.col("run") - F.lit(before))
    return numbered.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(run, RESULT)


def shard_bits(windows: int) -> int:
    return max(3, (max(1, windows // SHARD_KEYS) - 1).bit_length())


def check_bytes(windows: int, key_bits: int) -> int:
    """Bytes of the second hash with which the pairs of so many windows meet falsely with a probability of 2**-20 at most."""
    return min(8, max(4, -(-(2 * windows.bit_length() + 20 - key_bits) // 8)))


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False, index: Index | None = None, key_bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, null unless with_text), one row per document.

    With an index, windows of earlier batches count as earlier, and the batch's run is appended to it. key_bits: bits by which
    runs are sorted and merged, instead of those that the number of windows asks for; fewer of them make the second hash longer.
    """
    ws = Workspace(docs.sparkSession, "substrings")
    numbered, windows = parts(docs, ws)
    bits = index.bits if index else shard_bits(windows // 3)  # six bytes a word, about
    key_bits = INDEX_BITS if index else max(bits, key_bits or min(60, windows.bit_length() + 20))
    low_bytes = INDEX_BYTES if index else check_bytes(windows, key_bits)
    before = index.next_run() if index else 0
    own = runs(numbered, bits, key_bits, low_bytes, window, before)
    if index:  # the index keeps them; else they only travel
        own = ws.table(own, "runs")
    known = index.runs().union(own) if index and before else own
    told = ws.table(seen_before(known, before), "told")
    if index:
        index.append(own)
        ws.drop("runs")
    ws.release()
    return removed(numbered, told, bits, key_bits, low_bytes, window, before, with_text)


class Index:
    """Runs of all batches so far, in immutable tables under one folder: one table a batch, merged when they are many."""

    def __init__(self, spark: SparkSession, path: str, bits: int = 8):
        self.spark, self.path, self.bits = spark, path.rstrip("/"), bits

    def _levels(self) -> list[str]:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        return [n for n in names if n.startswith("level-") and fs.exists(sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def runs(self) -> DataFrame:
        levels = self._levels()
        newest = max((n for n in levels if n.endswith("-merged")), default="")  # what stands before it is in it
        return self.spark.read.schema("shard bigint, run bigint, n bigint, keys binary").parquet(*[f"{self.path}/{n}" for n in levels if n >= newest])

    def next_run(self) -> int:
        return (self.runs().agg(F.max("run")).first()[0] + 1 if self._levels() else 0) or 0

    def append(self, own: DataFrame) -> None:
        number = max((int(n.split("-")[1]) for n in self._levels()), default=-1) + 1
        own.write.option("compression", "zstd").parquet(f"{self.path}/level-{number:06d}")
        levels = self._levels()
        newest = max((n for n in levels if n.endswith("-merged")), default="")
        if sum(n >= newest for n in levels) > RUNS:
            self.compact(number + 1)

    def compact(self, number: int) -> None:
        """One run a shard: the distinct fingerprints of all runs. The old tables stay for readers that hold them."""

        def run(table: pa.Table) -> pa.Table:
            _, _, seen = _merge(table)
            table = table.sort_by("run")
            keys = [_unpack(x) for x in table["keys"].to_pylist()]
            high, low = (np.concatenate([k[i] for k in keys])[~seen] for i in (0, 1))
            order = np.lexsort((low, high))
            row = {"shard": table["shard"][0].as_py(), "run": max(table["run"].to_pylist()), "n": len(high), "keys": _pack(high[order], low[order], INDEX_BYTES)}
            return pa.Table.from_pylist([row], pa.schema([(k, pa.binary() if k == "keys" else pa.int64()) for k in row]))

        merged = self.runs().groupBy("shard").applyInArrow(run, "shard bigint, run bigint, n bigint, keys binary")
        merged.write.option("compression", "zstd").parquet(f"{self.path}/level-{number:06d}-merged")

