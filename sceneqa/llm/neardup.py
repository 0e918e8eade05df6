"""Near-duplicates by similarity of word shingles: candidates from SimHash with Golay keys and from MinHash bands, each verified on the whole sets.

Two documents are linked if the Jaccard similarity of their sets of WIDTH-word shingles is SIMILARITY at least. SimHash fingerprints of the
sets bring together, by simhash.links(), those that differ in two bits at most. Fingerprints of 64 bits cannot do so with all
pairs (at 0.8 they differ in some ten bits, some in twice as many), so bands find the rest.
A band is ROWS minimum hashes: of BANDS bands a pair of similarity 0.8 shares none with probability 1.2e-7.

Documents with equal sets are one node. Every node is first held against those that Golay keys name (of nodes with one fingerprint the
smallest stands for all, and they are held against it), and against the smallest of the smallest members of its buckets. Then, STARS times, a node that this leaves in another component than the smallest members of some of its buckets
is held against one of each such component. So a group of near copies gives rows in proportion to its members. Pairs of a
bucket that are still in different components are found by the prefixes of their sets: shingles in one order, those that
many sets have last, of which each set sends the first fifth; similar sets share one of these for certain, and early enough. Texts that
share a passage, or near copies of one text that differ too much from each other, fill buckets, but share nothing early in their prefixes. In the first rounds sketches turn pairs away: a sketch has two bits of each of SKETCH minimum hashes, and
those of a pair of similarity 0.8 differ for more than FAR of them with a probability of 1e-6; such a pair is met again at the end.

Texts don't travel: sets are made where the texts are read, of those rows alone whose hash a bitmap of fixed size holds,
and rows that no such bitmap puts in doubt are kept where they stand.

Words are those of op1. A text of fewer than WIDTH words is one shingle; null and empty texts have none and are copies
of each other. Sets, rows and shingles are identified by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneqa.llm import simhash
from sceneqa.llm.common import BLANK, LOWER, Workspace, byte_view, groups, hash_spans, mix, per_value, rolling, spans, text_array, tidy
from sceneqa.llm.components import components

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 5
#: Minimum hashes of a sketch, and those for which sketches of a pair differ at most.
SKETCH, FAR = 192, 54
#: Rounds in which nodes are held against smallest members of other components.
STARS = 2
#: A shingle of more sets than this comes last in the order of prefixes.
COMMON = 8
#: Bits of the bitmap of rows (4 MB), and of one row of it as Spark makes them.
BITMAP, BITMAP_ROW = 1 << 25, 1 << 15
_SALTS = mix(np.arange(2 * BANDS * ROWS, dtype=np.uint64), 5).astype(np.uint32).reshape(2, -1)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some texts at a time their sorted distinct shingles in a row, and the bounds of each text's."""
    raw, offsets = byte_view(texts)
    for i, j in groups(offsets):
        data, bounds = LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends = spans(data, bounds, BLANK)
        first = per_value(starts, bounds)
        words, n = hash_spans(data, starts, ends), np.diff(first)
        out, at = [], np.zeros(len(n) + 1, np.int64)
        runs = rolling(words, width, 0xD1B54A32D192ED03)
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if b - a >= width:
                part = np.unique(runs[a : b - width + 1])
            else:
                part = rolling(words[a:b], b - a, 0xD1B54A32D192ED03) ^ np.uint64(b - a) if b > a else words[:0]
            out.append(part)
            at[k + 1] = at[k] + len(part)
        yield (np.concatenate(out) if out else words[:0]), at


def signatures(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(flat, 9), dtype=np.uint64)]
    return mix((sums[at[1:]] - sums[at[:-1]]) ^ np.diff(at).astype(np.uint64), 11).view(np.int64)


def fingerprints(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A SimHash fingerprint of each set: a bit is 1 if more than half of the shingles' hashes have it; 0 for an empty set."""
    some = np.flatnonzero(np.diff(at))
    out = np.zeros(len(at) - 1, np.uint64)
    if len(some):
        h, half = mix(flat, 17), np.diff(at)[some] / 2
        for bit in range(64):
            ones = np.add.reduceat((h >> np.uint64(bit) & np.uint64(1)).astype(np.uint32), at[some])
            out[some] |= (ones > half).astype(np.uint64) << np.uint64(bit)
    return out.view(np.int64)


def band_keys(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BANDS keys for each set, in a row, and its sketch as numbers of 64 bits; empty sets share theirs."""
    some = np.flatnonzero(np.diff(at))
    keys = np.zeros((len(at) - 1, BANDS), np.uint64)
    bits = np.zeros((2, len(at) - 1, BANDS * ROWS), bool)
    if len(some):
        x, begin = (flat >> np.uint64(32)).astype(np.uint32), at[some]
        for band in range(BANDS):
            key = np.full(len(some), band + 1, np.uint64)
            for row in range(band * ROWS, (band + 1) * ROWS):
                least = np.minimum.reduceat((x ^ _SALTS[0, row]) * (_SALTS[1, row] | np.uint32(1)), begin)
                mixed = mix(least.astype(np.uint64), 15)
                bits[0, some, row], bits[1, some, row] = mixed & np.uint64(1), mixed & np.uint64(2)
                key = mix(key ^ least.astype(np.uint64), 13)
            keys[some, band] = key
    return keys.view(np.int64), np.concatenate([np.packbits(plane[:, :SKETCH], axis=1).view(np.int64) for plane in bits], 1)


def _marks(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row (a hash of the whole row), sig, size, fp, sketch, bands."""

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, sizes, fps, bands, sketches = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, BANDS), np.int64)], [np.zeros((0, SKETCH // 32), np.int64)]
            for flat, at in shingle_sets(text_array(batch), width):
                sigs.append(signatures(flat, at))
                sizes.append(np.diff(at))
                fps.append(fingerprints(flat, at))
                keys, sketch = band_keys(flat, at)
                bands.append(keys)
                sketches.append(sketch)
            columns = [pa.array(np.concatenate(sigs)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(fps)), lists(np.concatenate(sketches)), lists(np.concatenate(bands))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "row", "sig", "size", "fp", "sketch", "bands"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _row(docs).alias("row"), "text").mapInArrow(run, "doc_id bigint, row bigint, sig bigint, size bigint, fp bigint, sketch array<bigint>, bands array<bigint>")


def _row(docs: DataFrame):
    """A hash of all columns: rows that share it are repeats."""
    others = sorted(c for c in docs.columns if c not in ("doc_id", "text"))
    return F.xxhash64("doc_id", F.col("text").isNull(), "text", *([F.to_json(F.struct(*others))] if others else []))


def _bitmap(rows: DataFrame) -> Broadcast:
    """A bit for each of the hashes in the column row, modulo BITMAP."""
    place = F.pmod("row", F.lit(BITMAP))
    parts = rows.groupBy(F.floor(place / BITMAP_ROW).alias("part")).agg(F.bitmap_construct_agg(place % BITMAP_ROW).alias("bits")).collect()  # BITMAP / BITMAP_ROW rows
    out = np.zeros(BITMAP // 8, np.uint8)
    for r in parts:
        out[r.part * (BITMAP_ROW // 8) :][: BITMAP_ROW // 8] = np.frombuffer(r.bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out)


def _in_bitmap(bits: np.ndarray, rows: pa.Array) -> np.ndarray:
    place = rows.to_numpy() & np.int64(BITMAP - 1)
    return bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1


def _sets(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """sig, members: the shingles of the rows chosen (row, sig)."""
    shared = _bitmap(chosen)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_in_bitmap(shared.value, batch.column(0))))
            members: list[bytes] = []
            for flat, at in shingle_sets(text_array(batch), width):
                members += [flat[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(members, pa.binary())], names=["row", "members"])

    rows = docs.select(_row(docs).alias("row"), "text").mapInArrow(run, "row bigint, members binary")
    return rows.join(chosen, "row").dropDuplicates(["row"]).select("sig", "members")


def _similar(pairs: DataFrame, similarity: float) -> DataFrame:
    """u, v of the rows u, v, a, b whose sets a and b are similar."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                hit.append(both >= similarity * (len(x) + len(y) - both))
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["u", "v"])

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, ws: Workspace, name: str, width: int, similarity: float) -> DataFrame:
    """Those of the pairs u, v (written) that are similar."""
    ids = pairs.select(F.col("u").alias("sig")).union(pairs.select(F.col("v").alias("sig"))).distinct()
    chosen = ws.table(nodes.select("sig", "row").join(ids, "sig"), f"{name}-chosen")
    sets = ws.table(_sets(docs, chosen, width), f"{name}-sets")
    a, b = sets.select(F.col("sig").alias("u"), F.col("members").alias("a")), sets.select(F.col("sig").alias("v"), F.col("members").alias("b"))
    out = ws.table(_similar(pairs.join(a, "u").join(b, "v"), similarity), f"{name}-links")
    ws.drop(f"{name}-sets")
    ws.drop(f"{name}-chosen")
    return out


def _named(nodes: DataFrame, links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """sig, root for every node."""
    roots = ws.table(components(links, ws, name), f"{name}-roots")
    return ws.table(nodes.select("sig").join(roots, nodes.sig == roots.node, "left").select("sig", F.coalesce("root", "sig").alias("root")), f"{name}-named")


def _fits(a: str, b: str, similarity: float):
    """Sets of such sizes and sketches (a, b: what their columns' names begin with) can be similar."""
    words = SKETCH // 64
    differ = [F.get(f"{a}sketch", k).bitwiseXOR(F.get(f"{b}sketch", k)) for k in range(2 * words)]
    far = sum((F.bit_count(differ[k].bitwiseOR(differ[words + k])) for k in range(words)), F.lit(0))
    return (F.least(f"{a}size", f"{b}size") >= similarity * F.greatest(f"{a}size", f"{b}size")) & (far <= FAR)


def _golay(nodes: DataFrame, ws: Workspace) -> DataFrame:
    """u, v: pairs of nodes whose fingerprints are equal, or differ in two bits at most, with one node of each fingerprint in the latter."""
    heads = ws.table(nodes.groupBy("fp").agg(F.min("sig").alias("head")), "heads")
    same = nodes.select("fp", "sig").join(heads, "fp").where("sig <> head").select(F.col("head").alias("u"), F.col("sig").alias("v"))
    of = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    close = simhash.links(heads, ws).join(of("u"), "u").join(of("v"), "v")
    return ws.table(same.union(close.select(F.least("u_head", "v_head"), F.greatest("u_head", "v_head"))).distinct(), "golay")


def _mixed(marked: DataFrame, named: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """The rows of marked, with their roots, in buckets that hold several components; head: the bucket's smallest member and its root."""
    parts = ws.table(marked.select("key", "sig", "size", "sketch").join(named, "sig"), f"{name}-parts")
    heads = parts.groupBy("key").agg(F.min(F.struct("sig", "size", "sketch", "root")).alias("head"), F.min("root").alias("low"), F.max("root").alias("high"))
    heads = ws.table(heads.where("low < high").select("key", "head"), f"{name}-heads")
    out = ws.table(parts.join(heads, "key"), f"{name}-mixed")
    ws.drop(f"{name}-parts")
    return out


def _common(sets: DataFrame) -> Broadcast:
    """The bitmap of the shingles that more than COMMON of the sets have."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles, n = np.unique(byte_view(batch.column(0))[0].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingles), pa.array(n)], names=["row", "n"])

    counts = sets.select("members").mapInArrow(run, "row bigint, n bigint")
    return _bitmap(counts.groupBy("row").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON).select("row"))


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """sig, root, size, pos, shingle: of each set, in one order of all shingles, the first of which similar sets share one at least.

    Two sets of n and m with a similarity of s share ceil(s * n) shingles or more, so one of the first n - ceil(s * n) + 1 of either in
    any order that both follow; and if the first that they share stands at i and j (from 0), they share min(n - i, m - j) at most. Here shingles
    that many sets have come last: texts that have a passage in common, and little else, then share none or share it late.
    """
    common = _common(sets)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, sizes = [np.zeros(0, np.int64)], []
            for members in batch.column(2):
                x = np.frombuffer(members.as_buffer(), np.int64)
                late = _in_bitmap(common.value, pa.array(x))
                n = len(x) - math.ceil(similarity * len(x) - 1e-9) + 1 if len(x) else 0
                firsts.append(np.r_[x[~late], x[late]][:n])  # members are sorted
                sizes.append((len(x), n))
            many = np.array([n for _, n in sizes], np.int64)
            columns = [batch.column(k).take(pa.array(np.repeat(np.arange(len(many)), many))) for k in (0, 1)]
            pos = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            columns += [pa.array(np.repeat([n for n, _ in sizes], many), pa.int64()), pa.array(pos, pa.int64()), pa.array(np.concatenate(firsts))]
            yield pa.RecordBatch.from_arrays(columns, names=["sig", "root", "size", "pos", "shingle"])

    return sets.select("sig", "root", "members").mapInArrow(run, "sig bigint, root bigint, size bigint, pos bigint, shingle bigint")


def _across(docs: DataFrame, nodes: DataFrame, left: DataFrame, ws: Workspace, width: int, similarity: float) -> DataFrame:
    """u, v of the similar pairs of different components among the nodes left (sig, root)."""
    chosen = ws.table(nodes.select("sig", "row").join(left, "sig"), "across-chosen")
    sets = ws.table(_sets(docs, chosen.select("row", "sig"), width).join(left, "sig"), "across-sets")
    firsts = ws.table(_prefixes(sets, similarity), "across-firsts")
    u, v = (firsts.select("shingle", *(F.col(c).alias(f"{s}_{c}") for c in ("sig", "root", "size", "pos"))) for s in "uv")
    most = F.least(F.col("u_size") - F.col("u_pos"), F.col("v_size") - F.col("v_pos"))  # that they share, if none before
    fits = most >= similarity / (1 + similarity) * (F.col("u_size") + F.col("v_size")) - 1e-9
    met = u.join(v, (u.shingle == v.shingle) & (F.col("u_sig") < F.col("v_sig")) & (F.col("u_root") != F.col("v_root")) & fits)
    pairs = met.select(F.col("u_sig").alias("u"), F.col("v_sig").alias("v")).distinct()
    a, b = sets.select(F.col("sig").alias("u"), F.col("members").alias("a")), sets.select(F.col("sig").alias("v"), F.col("members").alias("b"))
    out = ws.table(_similar(pairs.join(a, "u").join(b, "v"), similarity), "across-links")
    for name in ("chosen", "sets", "firsts"):
        ws.drop(f"across-{name}")
    return out


def cluster(docs: DataFrame, ws: Workspace, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, row, sig, root: rows with one root reach each other by links."""
    if similarity < SIMILARITY:
        raise ValueError("the bands hold for similarities of 0.8 and more")
    marks = ws.table(_marks(docs, width), "marks")
    nodes = ws.table(marks.groupBy("sig").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "nodes")
    keys = nodes.select(F.explode("bands").alias("key"), "sig")
    shared = ws.table(keys.groupBy("key").agg(F.min("sig").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head"), "shared")
    met = ws.table(keys.join(shared, "key").select("key", "sig", "head"), "met")
    sizes = nodes.select("sig", "size", "sketch")
    marked = ws.table(met.select("key", "sig").join(sizes, "sig"), "marked")
    tried = met.where("sig <> head").groupBy("sig").agg(F.min("head").alias("head"))
    tried = tried.unionByName(_golay(nodes, Workspace(docs.sparkSession, "neardup-golay")).select(F.col("u").alias("head"), F.col("v").alias("sig"))).distinct()
    tried = tried.join(sizes, "sig").join(sizes.select(F.col("sig").alias("head"), F.struct("size", "sketch").alias("h")), "head")
    tried = tried.select(F.col("head").alias("u"), F.col("sig").alias("v"), "size", "sketch", "h").where(_fits("", "h.", similarity)).select("u", "v")
    tried = ws.table(tried, "first")
    links = _verified(docs, nodes, tried, ws, "first", width, similarity)
    named = _named(nodes, links, ws, "first")
    left = _mixed(marked, named, ws, "mixed")
    for k in range(STARS):
        name = f"star-{k}"
        more = left.where("root <> head.root").where(_fits("", "head.", similarity)).select(F.col("head.sig").alias("u"), F.col("sig").alias("v"), F.col("head.root").alias("other"))
        more = more.join(tried, ["u", "v"], "left_anti").groupBy("v", "other").agg(F.min("u").alias("u")).select("u", "v")
        more = ws.table(more, name)
        if more.isEmpty():
            break
        links = links.union(_verified(docs, nodes, more, ws, name, width, similarity))
        named = _named(nodes, links, ws, name)
        tried = tried.union(more)
        left = _mixed(marked, named, ws, f"mixed-{k}")
    across = _across(docs, nodes, left.select("sig", "root").distinct(), ws, width, similarity)
    if not across.isEmpty():
        named = _named(nodes, links.union(across), ws, "last")
    return marks.select("doc_id", "row", "sig").join(named, "sig")


def dedup(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Of each group of near copies one row stays: that with the smallest doc_id, then set, then row; a null doc_id comes last."""
    ws = Workspace(docs.sparkSession, "neardup")
    rows = cluster(docs, ws, width, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig", "row")
    keep = ws.table(rows.groupBy("root").agg(F.min(order).alias("first")).select("first.row"), "keep")
    # rows that go, or that stand several times, and whatever shares their bits
    counts = rows.groupBy("row").agg(F.count("*").alias("n"))
    doubted = _bitmap(counts.join(keep.withColumn("kept", F.lit(True)), "row", "left").where("kept is null or n > 1"))
    row = "row"
    while row in docs.columns:  # whatever the documents' columns are called
        row += "_"
    marked = docs.withColumn(row, _row(docs))
    at = len(docs.columns)

    def part(sure: bool) -> DataFrame:
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_in_bitmap(doubted.value, batch.column(at)) != sure))

        return marked.mapInArrow(run, marked.schema)

    checked = part(False).join(keep.withColumnRenamed("row", row), row, "left_semi").dropDuplicates([row])
    return part(True).select(docs.columns).union(checked.select(docs.columns))
