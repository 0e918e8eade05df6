"""Token ids in binary shards with a minimal perfect hash index.

A shard is one binary value: a header, the ids of its documents (2 bytes each, 4 if an id needs them), their lengths
and an index. The index is a minimal perfect hash of the distinct document keys: levels of bit vectors, in which a key
that meets another on one level goes to the next; the rank of a key's bit is its slot. A slot holds a 16-bit
fingerprint of the key, by which most foreign keys are refused at once, and the key's first row; the stored key
decides. Looking up a key takes constant time on average and reads nothing else of the shard.

Shards are rows of a table that Spark writes, so they reach any store that Spark reaches. Rows are dealt by ranges of
doc_id, so shard numbers follow doc_id; the driver keeps one total for each range. read_store() returns every document,
each fetched by its key through its shard's index; lookup() finds the shards of any keys by the ranges of their doc_ids and
asks each for its keys alone.

Null and empty texts consist of the end id alone. Rows that repeat a doc_id stand next to each other in the order of
their ids' bytes; a lookup finds all of them. Rows without a doc_id stand before all others, in the order of a hash of
their ids; a shard counts those it holds, its index has none of them, and they may fill several shards. An empty table
gives no shards. Further columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneqa.llm.common import Workspace, mix, sum_to_base, text_array, texts
from sceneqa.llm.tokens import encoder

MAGIC = b"TIDS2\0\0\0"
_HEAD = struct.Struct("<8sIIQQIIII")
#: Bytes of ids after which a shard is closed.
SHARD_BYTES = 4 << 20


def _words(bits: int) -> int:
    return (bits + 63) // 64


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Levels' sizes in words, their bits, the rank before each word, and the slot of each key (distinct, unsigned 64-bit)."""
    sizes, bits, slots = [], [], np.zeros(len(keys), np.int64)
    left, base, level = np.arange(len(keys)), 0, 0
    while len(left):
        width = _words(max(64, 2 * len(left)))
        at = (mix(keys[left], level + 1) % np.uint64(64 * width)).astype(np.int64)
        alone = np.bincount(at, minlength=64 * width)[at] == 1
        words = np.zeros(width, np.uint64)
        np.bitwise_or.at(words, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
        sizes.append(width)
        bits.append(words)
        left, level = left[~alone], level + 1
        base += width
    words = np.concatenate(bits) if bits else np.zeros(0, np.uint64)
    ones = np.bitwise_count(words).astype(np.int64)
    rank = (np.cumsum(ones) - ones).astype(np.uint32)
    found, slots = find_slots(np.array(sizes, np.uint32), words, rank, keys)
    assert found.all()
    return np.array(sizes, np.uint32), words, rank, slots


def find_slots(sizes: np.ndarray, words: np.ndarray, rank: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key hits a set bit, and its slot; a foreign key may hit one too."""
    slot, found, base = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), 0
    for level, width in enumerate(sizes.tolist()):
        left = np.flatnonzero(~found)
        if not len(left):
            break
        at = (mix(keys[left], level + 1) % np.uint64(64 * width)).astype(np.int64)
        word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
        hit = (words[word] >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        slot[left[hit]] = (rank[word] + below)[hit]
        found[left[hit]] = True
        base += width
    return found, slot


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 77) >> np.uint64(48)).astype(np.uint16)


def first_rows(keys: np.ndarray) -> np.ndarray:
    """The first row of each of the keys, which stand in groups."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def write_shard(doc_ids: list[int | None], ids: list[bytes], start: int, width: int = 2) -> bytes:
    """doc_ids ascending, None before all; ids: little-endian integers of so many bytes; start: the ids before this shard in its range."""
    none = doc_ids.count(None)
    keys = np.array([0] * none + doc_ids[none:], np.int64).view(np.uint64)
    first = none + first_rows(keys[none:])
    sizes, words, rank, slots = build_index(keys[first])
    prints, rows = np.zeros(len(first), np.uint16), np.zeros(len(first), np.uint32)
    prints[slots], rows[slots] = fingerprints(keys[first]), first
    lengths = np.array([len(x) // width for x in ids], np.uint64)
    ends = np.cumsum(lengths, dtype=np.uint64)
    payload = b"".join(ids)
    parts = [sizes, words, rank, prints, rows, keys, ends]
    return b"".join([_HEAD.pack(MAGIC, width, len(ids), start, len(payload), len(sizes), len(words), len(first), none), *(p.tobytes() for p in parts), payload])


class Shard:
    """A shard opened over its bytes; nothing is copied."""

    def __init__(self, image: bytes | memoryview):
        magic, self.width, n, self.start, size, levels, words, distinct, self.none = _HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at, parts = _HEAD.size, []
        for kind, k in ((np.uint32, levels), (np.uint64, words), (np.uint32, words), (np.uint16, distinct), (np.uint32, distinct), (np.int64, n), (np.uint64, n)):
            parts.append(np.frombuffer(image, kind, k, at))
            at += parts[-1].nbytes
        self.sizes, self.words, self.rank, self.prints, self.rows, self.keys, self.ends = parts
        self.payload = np.frombuffer(image, f"<u{self.width}", size // self.width, at)

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, -1 where the shard lacks it."""
        k = np.asarray(keys, np.int64)
        found, slot = find_slots(self.sizes, self.words, self.rank, k.view(np.uint64))
        found &= self.prints[slot] == fingerprints(k.view(np.uint64)) if len(self.prints) else False
        row = np.where(found, self.rows[slot] if len(self.rows) else 0, 0).astype(np.int64)
        return np.where(found & (self.keys[row] == k if len(self.keys) else False), row, -1)

    def ids(self, row: int) -> np.ndarray:
        return self.payload[int(self.ends[row - 1]) if row else 0 : int(self.ends[row])]

    def before(self, row: int) -> int:
        return self.start + (int(self.ends[row - 1]) if row else 0)

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every row of a key; of the rows without one for None."""
        if key is None:
            return [self.ids(row) for row in range(self.none)]
        row, out = int(self.rows_of(np.array([key]))[0]), []
        while 0 <= row < len(self.keys) and self.keys[row] == key:
            out.append(self.ids(row))
            row += 1
        return out


def write_store(docs: DataFrame, ws: Workspace, path: str, keeps_blanks: bool, end_id: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The table of shards: part, shard, first_id, last_id, n_tokens, image."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, keeps_blanks, end_id)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), enc(text_array(batch))[0]], names=["doc_id", "ids"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start = TaskContext.get().partitionId(), 0, 0
        keys: list[int] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            n = sum(map(len, held)) // 2
            row = {"part": part, "shard": number, "first_id": keys[0], "last_id": keys[-1], "n_tokens": n, "image": write_shard(keys, held, start)}
            return pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.binary() if c == "image" else pa.int64()) for c in row]))

        size = 0
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if size >= shard_bytes and (key is None or key != keys[-1]):
                    yield close()
                    number, start = number + 1, start + size // 2
                    keys.clear()
                    held.clear()
                    size = 0
                keys.append(key)
                held.append(ids)
                size += len(ids)
        if keys:
            yield close()

    spark = docs.sparkSession
    encoded = ws.table(texts(docs).mapInArrow(encode, "doc_id bigint, ids binary"), "encoded")
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), encoded.rdd.getNumPartitions())
    # rows of one doc_id stay together; those without one need not, and have an order over all partitions
    order = [F.col("doc_id").asc_nulls_first(), F.when(F.col("doc_id").isNull(), F.xxhash64("ids")).asc_nulls_first()]
    dealt = encoded.repartitionByRange(many, *order).sortWithinPartitions(*order, "ids")
    out = ws.table(dealt.mapInArrow(shards, "part bigint, shard bigint, first_id bigint, last_id bigint, n_tokens bigint, image binary"), "shards")
    ws.drop("encoded")
    return out


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
FOUND = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def _bases(shards: DataFrame) -> dict[int, int]:
    """The ids before each range: one number for each."""
    return sum_to_base({r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()})


def _rows(shard: Shard, keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(key, row) of every row of the keys that the shard has."""
    for key, row in zip(keys.tolist(), shard.rows_of(keys).tolist(), strict=True):
        while 0 <= row < len(shard.keys) and shard.keys[row] == key:
            yield key, row
            row += 1


def read_store(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, each fetched by its key through the index."""
    base = _bases(shards)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(image.as_buffer())
                keys = shard.keys[shard.none :]
                out = []
                for key, row in (*((None, row) for row in range(shard.none)), *_rows(shard, keys[first_rows(keys)])):
                    ids = shard.ids(row)
                    out.append((key, base[part] + shard.before(row), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[c.split()[0] for c in READ.split(", ")])

    return shards.select("part", "image").mapInArrow(read, READ)


def lookup(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian, as wide as the shard stores them) of every row of the keys (column doc_id);
    keys that the store lacks give no row, repeated ones count once, and a null key stands for the rows without a doc_id.

    A key is led to the range, then to the shards, whose doc_ids span it, by a join on the range; only these shards' images
    are read. The driver keeps two numbers for each range.
    """
    base = _bases(shards)
    spans_ = shards.where("last_id is not null").groupBy("part").agg(F.min(F.coalesce("first_id", F.lit(-(2**63)))).alias("low"), F.max("last_id").alias("high")).collect()
    spans_ = sorted((r.low, r.high, r.part) for r in spans_)
    lows, highs, parts = (np.array([s[i] for s in spans_], np.int64) for i in range(3))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_numpy()
            at = np.searchsorted(lows, wanted, "right") - 1
            ok = (at >= 0) & (wanted <= highs[at] if len(highs) else False)
            yield pa.RecordBatch.from_arrays([pa.array(parts[at[ok]]), pa.array(wanted[ok])], names=["part", "key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, image, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                shard = Shard(image.as_buffer())
                known = wanted.values.drop_null().to_numpy() if wanted.is_valid else np.zeros(0, np.int64)
                none = range(shard.none) if wanted.is_valid and wanted.values.null_count else ()
                out = [(key, base[part] + shard.before(row), int(shard.ids(row).size), shard.ids(row).tobytes()) for key, row in (*((None, row) for row in none), *_rows(shard, known))]
                kinds = [pa.int64()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in FOUND.split(", ")])

    asked = keys.select("doc_id").distinct()
    routed = asked.where("doc_id is not null").mapInArrow(route, "part bigint, key bigint")
    bounds = shards.select("part", "shard", F.coalesce("first_id", F.lit(-(2**63))).alias("first"), "last_id")
    of = routed.join(bounds, "part").where(F.col("key").between(F.col("first"), F.col("last_id"))).select("part", "shard", "key")
    if not asked.where("doc_id is null").isEmpty():
        of = of.union(shards.where("first_id is null").select("part", "shard", F.lit(None).cast("bigint").alias("key")))
    wanted = of.groupBy("part", "shard").agg(F.collect_list(F.struct("key")).alias("k")).select("part", "shard", F.transform("k", lambda x: x["key"]).alias("keys"))
    return shards.join(wanted, ["part", "shard"]).select("part", "image", "keys").mapInArrow(read, FOUND)
