"""Shared run folders, Arrow text access and vectorised word hashing.

Word hashing works on whole Arrow buffers with numpy: a prefix sum of byte times a power of a base in a prime field, of
which the difference between two places, divided by the power at the first, depends on the bytes between them alone.
A hash joins two fields of 31 bits; two different words of L bytes share it with a probability of (L / 2**31)**2 over
the choice of the bases. Words of over LONG bytes are hashed one by one with XXH3. No Python code runs per shorter word.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches to Python workers hold at most so many rows or bytes, if the session sets nothing else.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20
ROW_GROUP = 32 << 20
#: Bytes of text that numpy sees at once; temporaries are about 40 times this.
SLICE = 1 << 20
#: Bytes that word hashing sees at once, and those of words that it leaves to XXH3.
BLOCK, LONG = 1 << 18, 1 << 16

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one where that is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="sceneqa-"))
    return f"file://{_local[0]}"


class Workspace:
    """Tables that cut lineage: each is written once to the shared folder, so a lost executor costs no earlier stage.

    They go at the end of the driver, as results read them lazily; drop() removes what no result reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
            key = f"spark.sql.execution.arrow.{key}"
            if spark.conf.get(key) in ("10000", "-1", str(2**63 - 1), str(2**31 - 1), "67108864", "64MB"):
                spark.conf.set(key, str(value))
        atexit.register(self._remove, "")

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        # small row groups: a writer holds one in memory
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets the shuffle files of tables that are written go; Spark keeps them until the driver collects its garbage."""
        for _ in range(2):  # Python's handles go first, then what they held; both ends work on their own threads
            gc.collect()
            time.sleep(0.5)
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)

    def drop(self, name: str) -> None:
        self._remove(f"/{name}")

    def _remove(self, name: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        try:
            path = sc._jvm.org.apache.hadoop.fs.Path(self.root + name)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except (ConnectionError, OSError):  # the JVM has ended
            return


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at its end the memory that it freed goes back to the system: a worker is used again by the next stage."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def texts(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text and the columns named, in this order; whatever else the input has stays out."""
    return df.select("doc_id", "text", *extra)


def text_array(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A column of strings; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col, "") if col.null_count else col


def byte_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offset of each value (one more than values), without a copy."""
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, offsets, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of whole values with at most so many bytes, or of one value."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def table(separators: str) -> np.ndarray:
    """Class 1 for each byte but those named, which are class 0."""
    out = np.ones(256, np.uint8)
    out[[ord(c) for c in separators]] = 0
    return out


#: Words of most contracts: anything between blanks.
BLANK = table(" \t\n\x0b\x0c\r")
#: Benchmark words: digits, small letters and whatever is not ASCII.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)], np.uint8)
#: Words as class 1, runs of punctuation as class 2.
WORDS_AND_MARKS = np.array([0 if b <= 32 or b == 127 else 1 if chr(b).isalnum() or b >= 128 or b == 95 else 2 for b in range(256)], np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64 and their inverses."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE + 4096)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ np.uint64((salt * 0xD6E8FEB86659FD93) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of a class other than 0; runs end at each bound."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = classes[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(cls[1:], cls[:-1], out=edge[1:-1])
    edge[bounds] = True
    cut = np.flatnonzero(edge)
    keep = cls[cut[:-1]] > 0
    return cut[:-1][keep], cut[1:][keep]


#: Prime fields of the word hashes (fixed values); bases are drawn from the salt.
_PRIMES = (2**31 - 1, 2**31 - 19)


@cache
def _fields(salt: int) -> list[tuple[np.uint64, np.ndarray, np.ndarray]]:
    """For each field its prime, the powers of its base, and their inverses."""
    out = []
    for k, prime in enumerate(_PRIMES):
        base = int.from_bytes(hashlib.blake2b(b"word hash %d %d" % (salt, k), digest_size=8).digest(), "big") % (prime - 3) + 2
        both = []
        for b in (base, pow(base, -1, prime)):
            p = np.ones(BLOCK + LONG + 1, np.uint64)
            n = 1
            while n < len(p):
                m = min(n, len(p) - n)
                p[n : n + m] = p[:m] * np.uint64(pow(b, n, prime)) % np.uint64(prime)
                n += m
            both.append(p.astype(np.uint32))
        out.append((np.uint64(prime), *both))
    return out


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever they stand; each salt has functions of its own."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        hi = int(ends[j - 1])
        if hi - lo > BLOCK + LONG:
            out[i] = xxhash.xxh3_64_intdigest(data[lo:hi].tobytes(), salt)
            i += 1
            continue
        values = data[lo:hi].astype(np.uint64) + np.uint64(1)
        s, e = starts[i:j] - lo, ends[i:j] - lo
        pre = np.zeros(hi - lo + 1, np.uint64)
        both = np.zeros(j - i, np.uint64)
        for prime, power, inverse in _fields(salt):
            np.cumsum(values * power[: hi - lo], out=pre[1:])  # below 2**59
            between = (pre[e] - pre[s]) % prime
            both = both << np.uint64(31) | between * inverse[s] % prime
        out[i:j] = both
        for k in np.flatnonzero(e - s > LONG).tolist():
            out[i + k] = xxhash.xxh3_64_intdigest(data[starts[i + k] : ends[i + k]].tobytes(), salt)
        i = j
    return mix(out, salt)


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each run of width values: len(h) - width + 1 of them."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    out = np.empty(n - width + 1, np.uint64)
    for lo in range(0, len(out), SLICE):
        part = h[lo : lo + SLICE + width - 1]
        p, inv = powers(len(part) + 1, base)
        pre = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * p[:-1], out=pre[1:])
        k = len(part) - width + 1
        out[lo : lo + k] = (pre[width:] - pre[:k]) * inv[:k]
    return mix(out)


def per_value(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The index of the first span of each value, and at the end their number."""
    return np.searchsorted(starts, bounds)


def crc_column(doc_id: str = "doc_id"):
    """Unsigned crc32 of an id as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def sum_to_base(totals: dict[int, int]) -> dict[int, int]:
    """What stands before each partition, given its total; there are as many entries as partitions."""
    out, before = {}, 0
    for k in sorted(totals):
        out[k] = before
        before += totals[k]
    return out


def single_thread() -> None:
    """Keeps a tokenizer in a Python worker from starting threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
