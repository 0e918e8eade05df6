"""Connected components by alternating large-star and small-star steps, on DataFrames.

Each partition first contracts its own edges to stars, so a dense group counts once per partition and member. Each
step groups with partial aggregation and joins the minimum back as a plain join of two written tables, which Spark
splits where a node has many edges. The driver sees one count and one checksum a round. Once SMALL edges or fewer are left,
one task joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneqa.llm.common import Workspace


class Forest:
    """Union by smaller root, for 64-bit names."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, r = self.up, x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x], x = r, p
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> tuple[list[int], list[int]]:
        nodes = list(self.up)
        return nodes, [self.root(x) for x in nodes]


#: Edges that a task contracts at once, and those that one task joins to the end.
FOREST, SMALL = 1_000_000, 250_000


def contract(edges: DataFrame) -> DataFrame:
    """u, v with u > v: a forest of stars with the components that each partition's edges have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, seen = Forest(), 0

        def close() -> pa.RecordBatch:
            u, v = forest.stars()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
            seen += batch.num_rows
            if seen >= FOREST:
                yield close()
                forest, seen = Forest(), 0
        yield close()

    return edges.select("u", "v").where("u <> v").mapInArrow(run, "u bigint, v bigint").where("u <> v")


def _with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    return pairs.join(least, "u")


def components(edges: DataFrame, ws: Workspace, name: str = "components") -> DataFrame:
    """node, root for every node of the edges u, v (bigint, not null); root is the smallest node of the component."""
    now = ws.table(contract(edges).distinct(), f"{name}-0")
    check: tuple = ()
    for k in range(1, 64):
        if now.count() <= SMALL:
            now = ws.table(contract(now.coalesce(1)), f"{name}-last")
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ws.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-{k}-a")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is larger than its least neighbour also keeps its own edge to it
        own = least.where("m < u").select("u", F.col("m").alias("v"))
        large = ws.table(large.union(own).distinct(), f"{name}-{k}-b")
        low = ws.table(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{k}-c")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v")))
        following = ws.table(small.distinct(), f"{name}-{k}")
        got = tuple(following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        for old in (f"{name}-{k - 1}", f"{name}-{k}-a", f"{name}-{k}-b", f"{name}-{k}-c"):
            ws.drop(old)
        now = following
        if got == check:
            break
        check = got
    else:
        raise RuntimeError("components have not settled")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components, given edges between them."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low
