"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits falls into segments of 23, 23 and 18 bits. Fingerprints that differ in two bits at most agree
on one segment at least (pigeonhole), and the segment after it differs in two bits at most. The perfect Golay code
turns a segment of 23 bits into the 12-bit indices of the codewords within four bits: one if a codeword lies within
two bits, else the nearest and five at four bits. Two words that differ in two bits at most share one of these indices
(through three errors and one more position goes exactly one block of seven, by the Steiner system of the code's
words). So the keys (segment, its bits, index of the next segment), about 16 a fingerprint, bring all partners
together; the join on them is verified bit by bit.

Documents with equal fingerprints are one node. A key that more than BUCKET fingerprints share gives no pairs: its
fingerprints go by their 65 words at one bit or none instead, of which two fingerprints within two bits always share
one, and no word is shared by more than 65. So all links are kept and nothing grows with the square of a group.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and repeated doc_ids stay rows
of their own. A row whose doc_id is null takes part, but gives its component no name. An empty table gives no rows.
Further columns of the input are kept by dedup() and ignored by the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneqa.llm.common import Workspace, text_array, texts
from sceneqa.llm.components import components

#: The Golay code's generator polynomial (a fixed value).
GENERATOR = 0xC75
#: Fingerprints under one key that are compared pair by pair.
BUCKET = 64
SEED = 42


def shingle_hashes(text: str, width: int = 3) -> np.ndarray:
    """XXH64 of each run of width words, repeats included; of the whole text if it has fewer words."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII blanks split
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)], np.uint64)


def fingerprint(text: str) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in text_array(batch).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id bigint, fp bigint")


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each 12-bit head, and for each syndrome the six error patterns (repeated where there is one)."""

    def rest(v: int) -> int:
        for k in range(22, 10, -1):
            if v >> k & 1:
                v ^= GENERATOR << (k - 11)
        return v

    heads = np.array([rest(h << 11) for h in range(4096)], np.uint32)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for at in combinations(range(23), weight):
            e = sum(1 << k for k in at)
            s = int(heads[e >> 11]) ^ (e & 0x7FF)
            if weight < 4 or found[s][0].bit_count() == 3:
                found[s].append(e)
    return heads, np.array([(f * 6)[:6] if len(f) == 1 else f for f in found], np.uint32)


def codewords(v: np.ndarray) -> np.ndarray:
    """The 12-bit indices (six columns, repeated where there is one) of the codewords near each 23-bit word."""
    heads, patterns = golay()
    v = v.astype(np.uint32)
    near = patterns[heads[v >> 11] ^ (v & 0x7FF)]
    return (v[:, None] ^ near) >> 11


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each fingerprint, and the position of the fingerprint for each key."""
    x = fp.view(np.uint64)
    seg = [(x >> np.uint64(s)) & np.uint64(m) for s, m in ((0, 0x7FFFFF), (23, 0x7FFFFF), (46, 0x3FFFF))]
    keys, rows = [], []
    for i in range(3):
        near = codewords(seg[(i + 1) % 3])
        keep = np.ones(near.shape, bool)
        keep[:, 1:] = (near[:, 1:] != near[:, :1])
        key = (np.uint64(i) << np.uint64(35)) | (seg[i][:, None] << np.uint64(12)) | near.astype(np.uint64)
        keys.append(key[keep])
        rows.append(np.nonzero(keep)[0])
    return np.concatenate(keys).view(np.int64), np.concatenate(rows)


def _near_keys(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            keys, rows = golay_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], names=["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key bigint, fp bigint")


def _verified(buckets: DataFrame, most: int) -> DataFrame:
    """u, v: the fingerprints of a bucket (bounded by BUCKET) that differ in so many bits at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            col = batch.column(0)
            flat, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            sizes = np.diff(at)
            for n in np.unique(sizes):
                if n < 2:
                    continue
                block = flat[at[:-1][sizes == n][:, None] + np.arange(n)]
                a, b = np.triu_indices(n, 1)
                for k in range(0, len(block), 2048):
                    x, y = block[k : k + 2048, a], block[k : k + 2048, b]
                    hit = np.bitwise_count((x ^ y).view(np.uint64)) <= most
                    us.append(x[hit])
                    vs.append(y[hit])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return buckets.select("members").mapInArrow(run, "u bigint, v bigint")


def _balls(hot: DataFrame) -> DataFrame:
    """u, v through the words at one bit or none: stars of at most 65 fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            word = (fp.view(np.uint64)[:, None] ^ flips).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.ravel()), pa.array(np.repeat(fp, 65))], names=["word", "fp"])

    shared = hot.mapInArrow(run, "word bigint, fp bigint").groupBy("word").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("members"))
    return shared.where("size(members) > 1").select("u", F.explode("members").alias("v")).where("u <> v")


def links(nodes: DataFrame, ws: Workspace, most: int = 2) -> DataFrame:
    """u, v: pairs that connect every two distinct fingerprints (column fp) within two bits."""
    if most > 2:
        raise ValueError("the keys hold for two differing bits at most")
    keys = ws.table(_near_keys(nodes), "keys")
    sizes = ws.table(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    marked = ws.table(keys.join(sizes, "key"), "marked")
    ws.drop("keys")
    ws.drop("sizes")
    buckets = marked.where(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list("fp").alias("members"))
    hot = marked.where(F.col("n") > BUCKET).select("fp").distinct()
    return ws.table(_verified(buckets, most).union(_balls(hot)), "links")


def cluster(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that links reach), one row per document."""
    ws = ws or Workspace(docs.sparkSession, "simhash")
    fps = ws.table(fingerprints(docs), "fingerprints")
    nodes = ws.table(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = ws.table(components(links(nodes, ws), ws), "roots")
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = ws.table(named, "named")
    names = ws.table(named.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    ids = ws.table(named.join(names, "root").select("fp", "component_id"), "ids")
    return fps.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of which the doc_id names their component: of each group the smallest doc_id stays, of its repeats one row.

    A row whose doc_id is null stays.
    """
    ws = Workspace(docs.sparkSession, "simhash-dedup")
    keep = ws.table(cluster(docs, ws).where("doc_id = component_id").select("doc_id").distinct(), "keep")
    return docs.where("doc_id is not null").dropDuplicates(["doc_id"]).join(keep, "doc_id", "left_semi").select(docs.columns).union(docs.where("doc_id is null"))
