"""Embedding near-duplicates on a robust-pruned flat graph.

Equal vectors are one class. Classes are dealt to overlapping cluster shards: the nearest centre and others hardly
further away. A shard that is too large falls into pieces by hash, and every two of its pieces meet in a cell of
bounded size. Each cell builds a flat graph: a vertex's candidates are its nearest neighbours in the cell and some
random ones, robust pruning keeps those that no kept one makes needless. The adjacency lists of a vertex from all its
cells are united. A cell then searches for each of its vectors from its medoid, greedily with a beam, and from all found within
the range goes on to their neighbours until no new one lies within. Pairs are verified in double precision.

A pair that several cells find counts in one of them, and a pair that is found from one side counts on both. Groups leave
a cell as stars, and components are joined from these. A sample of the vectors whose id is divisible by 50 is held against
all classes: recall is the lesser of the share of their links that were found and of the mean share of each vector. If it
falls short, everything is repeated with more overlap, and after the last try all pieces of all vectors meet each other
and are compared in full, block by block, so the result is then exact. cluster() reports the recall that it measured.

The centres are fitted by the driver on at most SAMPLE classes, in single precision; every vector is indexed and
searched for.

Null or zero vectors and those with null or non-finite components link with nothing; nor does a row without vec_id,
whose component is null. Vectors of different lengths don't link. Repeated rows are linked like other equal vectors. An empty table
gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneqa.llm.common import Workspace
from sceneqa.llm.components import components, local_components

log = logging.getLogger(__name__)

THRESHOLD = 0.95
#: Classes that the centres are fitted on at most, and for each centre; classes per centre; centres at most.
SAMPLE, PER_SAMPLE, PER_CENTRE, CENTRES = 200_000, 40, 100, 10_000
#: Vectors in a piece; a cell holds two pieces at most.
PIECE = 1_500
#: Neighbours that pruning starts from and keeps, its slack, random neighbours that stay besides, and the beam.
CANDIDATES, DEGREE, ALPHA, RANDOM, BEAM = 40, 20, 1.2, 4, 40
#: Shards of a vector at most, and degrees by which they may lie further than the nearest, try by try.
OVERLAP = ((4, 10.0), (8, 20.0), (16, 40.0))
#: Vectors of the audit, the ids that they come from, and the recall that ends it.
AUDIT, EVERY, RECALL = 1_000, 50, 0.99


def _rows(table: DataFrame) -> DataFrame:
    """vec_id, key (16 bytes, null if the vector links with nothing), vec (its numbers as bytes, and one byte with their size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = None
                if i is not None and v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    x = x if np.isfinite(x).all() and x.any() else None
                narrow = pa.types.is_float32(v.type.value_type)
                raw = None if x is None else x.astype(np.float32).tobytes() + b"\4" if narrow else x.tobytes() + b"\x08"
                keys.append(None if raw is None else hashlib.md5(raw).digest())
                vecs.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "key", "vec"])

    return table.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, key binary, vec binary")


def unit(raws: list[bytes]) -> np.ndarray:
    """The vectors, all of one length and size, in double precision and of length one."""
    kind = np.float32 if raws[0][-1] == 4 else np.float64
    x = np.frombuffer(b"".join(r[:-1] for r in raws), kind).reshape(len(raws), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from a start that strides through the sample."""
    c = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[k : k + 2048] @ c.T, 1) for k in range(0, len(sample), 2048)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def assign(classes: DataFrame, centre: dict[int, np.ndarray], most: int, degrees: float) -> DataFrame:
    """rep, n, vec, shards: the shards of each class; shard numbers begin with the vectors' length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, shards = batch.column(2).to_pylist(), [None] * batch.num_rows
            for width in {len(r) for r in raws}:
                at = [i for i, r in enumerate(raws) if len(r) == width]
                x = unit([raws[i] for i in at])
                c = centre.get(width, np.zeros((1, x.shape[1])))
                for lo in range(0, len(at), 256):
                    cosine = x[lo : lo + 256] @ c.T
                    k = min(most, cosine.shape[1])
                    order = np.argpartition(-cosine, k - 1, 1)[:, :k]
                    angle = np.degrees(np.arccos(np.clip(np.take_along_axis(cosine, order, 1), -1, 1)))
                    for i, o, a in zip(at[lo : lo + 256], order, angle, strict=True):
                        shards[i] = sorted((width << 20) + int(s) for s in o[a <= a.min() + degrees])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.list_(pa.int64()))], names=["rep", "n", "vec", "shards"])

    return classes.select("rep", "n", "vec").mapInArrow(run, "rep bigint, n bigint, vec binary, shards array<bigint>")


def cells(assigned: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """One row per class and cell: cell (shard, piece, piece), rep, n, vec, shards, pieces."""
    many = {s: -(-n // PIECE) for s, n in sizes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rep, n, vec, shards in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces = [int.from_bytes(hashlib.blake2b(b"%d" % rep, digest_size=8).digest(), "big") % max(1, many.get(s, 1)) for s in shards]
                for s, p in zip(shards, pieces, strict=True):
                    for q in range(max(1, many.get(s, 1))):
                        out.append((s, min(p, q), max(p, q), rep, n, vec, shards, pieces))
            kinds = [pa.int64()] * 5 + [pa.binary()] + [pa.list_(pa.int64())] * 2
            names = ["shard", "a", "b", "rep", "n", "vec", "shards", "pieces"]
            for k in range(0, max(1, len(out)), 4096):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out[k : k + 4096]], t) for i, t in enumerate(kinds)], names=names)

    return assigned.mapInArrow(run, "shard bigint, a bigint, b bigint, rep bigint, n bigint, vec binary, shards array<bigint>, pieces array<bigint>")


def robust_prune(x: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """The kept candidates of each vector (rows; -1 fills up). A candidate goes once a kept one is nearer to it, by a
    factor of alpha, than the vector itself is.
    """
    n, k = candidates.shape
    out = np.full((n, degree), -1, np.int64)
    for lo in range(0, n, 512):
        cand = candidates[lo : lo + 512]
        y = x[cand]
        d = 1 - np.einsum("nkd,nd->nk", y, x[lo : lo + 512])
        between = 1 - np.einsum("nkd,njd->nkj", y, y)
        alive = cand != np.arange(lo, lo + len(cand))[:, None]
        rows = np.arange(len(cand))
        for j in range(degree):
            pick = np.argmin(np.where(alive, d, np.inf), 1)
            ok = alive[rows, pick]
            out[lo : lo + len(cand), j] = np.where(ok, cand[rows, pick], -1)
            alive &= ~(ok[:, None] & (alpha * between[rows, pick] <= d))
            alive[rows, pick] = False
    return out


def build(x: np.ndarray) -> np.ndarray:
    """The graph of a cell: pruned lists and a few random neighbours, and in the room left the edges' opposites."""
    n = len(x)
    k = min(n - 1, CANDIDATES)
    if k < 1:
        return np.full((n, 1), -1, np.int64)
    cand = np.empty((n, k), np.int64)
    for lo in range(0, n, 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        cand[lo : lo + 512] = np.argpartition(-s, k - 1, 1)[:, :k]
    stray = np.random.default_rng(n).integers(0, n, (n, RANDOM))
    kept = np.concatenate([stray, robust_prune(x, cand)], 1)
    to, at = np.nonzero(kept >= 0)
    src, dst = kept[to, at], to  # the opposites, those of random edges first
    order = np.lexsort((at, src))
    src, dst = src[order], dst[order]
    rank = np.arange(len(src)) - np.searchsorted(src, src)
    back = np.full((n, DEGREE + RANDOM), -1, np.int64)
    fits = rank < DEGREE + RANDOM
    back[src[fits], rank[fits]] = dst[fits]
    return np.concatenate([kept, back], 1)


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, threshold: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) within the range: greedily from the medoid with a beam, then on from whatever lies within."""
    n, m = len(x), len(queries)
    medoid = int(np.argmax(x @ x.mean(0)))
    seen = np.zeros((m, n), bool)
    within = np.zeros((m, n), bool)
    rows = np.arange(m)
    beam = min(beam, n)
    ids = np.full((m, beam), -1, np.int64)
    sims = np.full((m, beam), -np.inf)
    fresh = np.zeros((m, beam), bool)
    ids[:, 0], sims[:, 0], fresh[:, 0] = medoid, x[queries] @ x[medoid], True
    seen[:, medoid] = True
    within[rows, medoid] = sims[:, 0] >= threshold
    active = rows
    while len(active):
        pick = np.argmax(np.where(fresh[active], sims[active], -np.inf), 1)
        node = ids[active, pick]
        fresh[active, pick] = False
        nxt = graph[node]
        ok = (nxt >= 0) & ~seen[active[:, None], nxt]
        s = np.where(ok, np.einsum("qkd,qd->qk", x[nxt], x[queries[active]]), -np.inf)
        r, c = np.nonzero(ok)
        seen[active[r], nxt[r, c]] = True
        hit = s[r, c] >= threshold
        within[active[r[hit]], nxt[r[hit], c[hit]]] = True
        all_s, all_i = np.concatenate([sims[active], s], 1), np.concatenate([ids[active], nxt], 1)
        all_f = np.concatenate([fresh[active], ok], 1)
        # a vector that stands twice among a vertex's neighbours may enter twice, which costs a place but no result
        top = np.argpartition(-all_s, beam - 1, 1)[:, :beam] if all_s.shape[1] > beam else np.argsort(-all_s, 1)
        sims[active], ids[active], fresh[active] = (np.take_along_axis(a, top, 1) for a in (all_s, all_i, all_f & np.isfinite(all_s)))
        active = active[fresh[active].any(1)]
    done = np.zeros((m, n), bool)
    while True:
        q, v = np.nonzero(within & ~done)
        if not len(q):
            break
        q, v = q[:200_000], v[:200_000]
        done[q, v] = True
        nxt = graph[v]
        flat = (q[:, None] * n + nxt)[nxt >= 0]
        flat = np.unique(flat[~seen.ravel()[flat]])
        seen.ravel()[flat] = True
        for k in range(0, len(flat), 100_000):
            a, b = np.divmod(flat[k : k + 100_000], n)
            hit = np.einsum("kd,kd->k", x[queries[a]], x[b]) >= threshold
            within[a[hit], b[hit]] = True
    return np.nonzero(within)


def _graphs(dealt: DataFrame) -> DataFrame:
    """rep, near: the adjacency list of each vertex in each cell."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        reps = table["rep"].to_numpy()
        graph = build(unit(table["vec"].to_pylist()).astype(np.float32))
        lists = [np.unique(reps[g[g >= 0]]).tolist() for g in graph]
        return pa.table([pa.array(reps), pa.array(lists, pa.list_(pa.int64()))], names=["rep", "near"])

    return dealt.select("shard", "a", "b", "rep", "vec").groupBy("shard", "a", "b").applyInArrow(run, "rep bigint, near array<bigint>")


FOUND = "u bigint, v bigint, links bigint"


def _in_full(x: np.ndarray, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """What search() finds, by comparing all pairs."""
    return np.nonzero(x[queries] @ x.T >= threshold)


def _found(dealt: DataFrame, threshold: float, exact: bool = False) -> DataFrame:
    """u, links: the vectors that cells count for a class; u, v: stars of the groups in a cell (links 0)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        reps, n = table["rep"].to_numpy(), table["n"].to_numpy()
        cell = tuple(table[c][0].as_py() for c in ("shard", "a", "b"))
        x = unit(table["vec"].to_pylist())
        fast = x.astype(np.float32)
        near = [np.searchsorted(reps, r) for r in table["near"].to_pylist()]
        near = [np.unique(p[(p < len(reps)) & (reps[np.minimum(p, len(reps) - 1)] == r)]) for p, r in zip(near, table["near"].to_pylist(), strict=True)]
        graph = np.full((len(reps), max(1, *map(len, near))) if near else (0, 1), -1, np.int64)
        for i, p in enumerate(near):
            graph[i, : len(p)] = p
        width = max(map(len, table["shards"].to_pylist()))
        shards, pieces = np.full((len(reps), width), -1), np.full((len(reps), width), -1)
        for i, (s, p) in enumerate(zip(table["shards"].to_pylist(), table["pieces"].to_pylist(), strict=True)):
            shards[i, : len(s)], pieces[i, : len(s)] = s, p
        links = np.zeros(len(reps), np.int64)
        label = np.arange(len(reps))

        def count(q: np.ndarray, v: np.ndarray) -> None:
            nonlocal label
            good = np.concatenate([np.einsum("kd,kd->k", x[q[k : k + 100_000]], x[v[k : k + 100_000]]) >= threshold for k in range(0, len(q), 100_000)] or [np.zeros(0, bool)])
            q, v = q[good], v[good]
            for k in range(0, len(q), 200_000):
                a, b = q[k : k + 200_000], v[k : k + 200_000]
                # the smallest shard that both share, and there the cell of both pieces, counts the pair
                both = (shards[a][:, :, None] == shards[b][:, None, :]) & (shards[a][:, :, None] >= 0)
                at = np.argmax(both.reshape(len(a), -1), 1)
                i, j = np.divmod(at, width)
                rows = np.arange(len(a))
                p, r = pieces[a, i], pieces[b, j]
                own = (shards[a, i] == cell[0]) & (np.minimum(p, r) == cell[1]) & (np.maximum(p, r) == cell[2]) & both.reshape(len(a), -1)[rows, at]
                np.add.at(links, a[own], n[b[own]])
            label = np.minimum(label, local_components(len(reps), np.r_[q, np.arange(len(reps))], np.r_[v, label]))

        seen = np.zeros((len(reps), len(reps)), bool)  # a cell holds two pieces at most
        for lo in range(0, len(reps), 256):
            queries = np.arange(lo, min(lo + 256, len(reps)))
            q, v = _in_full(fast, queries, threshold - 1e-4) if exact else search(fast, graph, queries, threshold - 1e-4)
            seen[queries[q], v] = True
        seen |= seen.T
        np.fill_diagonal(seen, False)
        for lo in range(0, len(reps), 256):
            q, v = np.nonzero(seen[lo : lo + 256])
            count(q + lo, v)
        other = label != np.arange(len(reps))
        u = np.concatenate([reps, reps[other]])
        v = np.concatenate([reps, reps[label[other]]])
        return pa.table([pa.array(u), pa.array(v), pa.array(np.concatenate([links, np.zeros(other.sum(), np.int64)]))], names=["u", "v", "links"])

    return dealt.groupBy("shard", "a", "b").applyInArrow(run, FOUND)


def _audit(classes: DataFrame, queries: list[tuple[int, bytes]], threshold: float) -> dict[int, int]:
    """The true number of links of some vectors to other classes, counted over all classes in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(queries), np.int64)
        for batch in batches:
            raws, n, reps = batch.column(2).to_pylist(), batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for width in {len(r) for r in raws}:
                at = np.array([i for i, r in enumerate(raws) if len(r) == width])
                mine = [k for k, (_, r) in enumerate(queries) if len(r) == width]
                if mine:
                    hit = unit([queries[k][1] for k in mine]) @ unit([raws[i] for i in at]).T >= threshold
                    hit &= np.array([queries[k][0] for k in mine])[:, None] != reps[at]
                    sums[mine] += hit @ n[at]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in queries]), pa.array(sums)], names=["rep", "links"])

    out = classes.select("rep", "n", "vec").mapInArrow(run, "rep bigint, links bigint").groupBy("rep").agg(F.sum("links").alias("links"))
    return {r.rep: r.links for r in out.collect()}  # AUDIT rows


def _searched(assigned: DataFrame, ws: Workspace, threshold: float, name: str, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """What cells find (u, v, links), and u, links summed."""
    # one number for each shard, of which there are CENTRES at most for each length
    sizes = {r.s: r["count"] for r in assigned.select(F.explode("shards").alias("s")).groupBy("s").count().collect()}
    dealt = cells(assigned, sizes)
    if exact:
        united = assigned.select("rep", F.expr("cast(array() as array<bigint>)").alias("near"))
    else:
        united = _graphs(dealt).groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    united = ws.table(united, f"graph-{name}")
    found = ws.table(_found(dealt.join(united, "rep"), threshold, exact), f"found-{name}")
    return found, ws.table(found.groupBy("u").agg(F.sum("links").alias("links")), f"links-{name}")


def _recall(true: dict[int, int], got: dict[int, int]) -> float:
    """The lesser of the share of all links and the mean share of each vector that has any."""
    each = [min(got.get(q, 0), k) / k for q, k in true.items() if k]
    return min(sum(min(got.get(q, 0), k) for q, k in true.items()) / sum(true.values()), sum(each) / len(each)) if each else 1.0


def cluster(table: DataFrame, threshold: float = THRESHOLD, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vec_id, embedding. report: gets the audit's recall of each try, the
    number of its vectors and links, and whether the result is exact.
    """
    report = {} if report is None else report
    ws = Workspace(table.sparkSession, "vectors")
    rows = ws.table(_rows(table), "rows")
    classes = ws.table(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")), "classes")
    count = classes.count()
    many = max(1, min(CENTRES, count // PER_CENTRE))
    sample = classes.orderBy(F.xxhash64("key")).limit(min(SAMPLE, PER_SAMPLE * many)).select("rep", "vec").collect()
    widths = {len(r.vec) for r in sample}
    centre = {w: centres(unit([r.vec for r in sample if len(r.vec) == w]).astype(np.float32), many) for w in widths}
    audited = classes.where(F.col("rep") % EVERY == 0).orderBy(F.xxhash64("key")).limit(AUDIT).select("rep", "vec").collect()
    queries = [(r.rep, bytes(r.vec)) for r in audited]
    true = _audit(classes, queries, threshold) if queries else {}
    report |= {"vectors": len(queries), "links": sum(true.values()), "recall": [], "exact": False}
    for attempt, (most, degrees) in enumerate(OVERLAP):
        assigned = ws.table(assign(classes, centre, most, degrees), f"assigned-{attempt}")
        found, links = _searched(assigned, ws, threshold, str(attempt))
        got = {r.u: r.links for r in links.where(F.col("u").isin([q for q, _ in queries])).collect()} if queries else {}
        report["recall"].append(_recall(true, got))
        if report["recall"][-1] >= RECALL:
            break
    else:
        report["exact"] = True
        whole = classes.select("rep", "n", "vec", F.array(F.length("vec").cast("bigint") * (1 << 20)).alias("shards"))
        found, links = _searched(ws.table(whole, "assigned-all"), ws, threshold, "all", exact=True)
    log.info("audit of %d vectors with %d links: recall %s%s", report["vectors"], report["links"], report["recall"], ", then compared in full" if report["exact"] else "")
    roots = ws.table(components(found.where("u <> v"), ws), "roots")
    named = classes.join(links, classes.rep == links.u, "left").select("key", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    named = named.join(roots, named.rep == roots.node, "left").select("key", "n_links", F.coalesce("root", "rep").alias("component"))
    named = ws.table(named, "named")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
