"""Filter interaction audit by a trie of permutations.

Every order of the filters is a path of the trie. The survivors of a path depend on the set of its filters alone, so a state is that
set: the trie is walked depth first, each state is made once, from the persisted survivors of the state above it, and orders that reach it
again take the counts that were made the first time. With k filters that is 2 ** k states for k! orders, of which k at most are persisted at any
time. At each state one aggregation counts, for every filter still to come, the rows that it removes from the survivors: the edges of the trie.
Counts of an edge are rows of a table, one for each part that has survivors, so neither parts nor counts pass through the driver.

Failing a filter is decided once, on the whole table, before the walk. Nulls are decided by the caller's conditions: a null condition
doesn't fail. An empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneqa.llm.common import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: A text with over 1 / HEAVY of all rows is a heavy one; there are fewer than HEAVY of them.
HEAVY = 1000
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures() -> dict[str, Column]:
    """Failure of each filter on `text` (not null) and `words`: short, repetitive, shouting, with marks."""
    n, text = F.size("words"), F.col("text")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct("words")) < 80 * n,
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, ws: Workspace, part: str = "lang") -> DataFrame:
    """part, A to E, good, toxic for each document. E: a smaller doc_id has the same text (by SHA-256), in the whole table.

    A null text is empty, a null part the empty string. A null doc_id is no smaller one and has no label; of several labels of a
    document any counts. Rows with the same doc_id are no copies of each other.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), 0))
    rows = ws.table(read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(f) for f, c in text_failures().items()]), "rows")
    border = max(1, rows.count() // HEAVY)
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    heavy = first.where(F.col("n") > border).select("digest", F.col("first").alias("heavy"))
    light = first.where(F.col("n") <= border).select(F.col("digest").alias("key"), "first")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("marked")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    # rows of heavy texts find theirs in a broadcast and are then dealt by a key of their own that no digest equals
    near = rows.join(F.broadcast(heavy), "digest", "left")
    near = near.withColumn("key", F.when(F.col("heavy").isNull(), F.col("digest")).otherwise(F.monotonically_increasing_id().cast("string").cast("binary")))
    both = near.join(light, "key", "left").withColumn("first", F.coalesce("heavy", "first")).join(marks, F.col("doc_id") == F.col("marked"), "left")
    fails = {**{f: F.col(f) for f in text_failures()}, "E": F.col("doc_id") > F.col("first"), "good": F.col("good"), "toxic": F.col("toxic")}
    return both.select("part", *[F.coalesce(c, F.lit(False)).alias(f) for f, c in fails.items()])


def edges(rows: DataFrame, filters: Sequence[str], losses: Sequence[str], ws: Workspace) -> DataFrame:
    """state (its filters, in order), filter, part, n (survivors of the state), removed, and of these <loss>_lost: a row for each
    part with survivors.
    """
    path, seen = f"{ws.root}/edges-{uuid.uuid4().hex}", set()

    def visit(survivors: DataFrame, state: frozenset[str]) -> None:
        if state in seen or len(state) == len(filters):
            return  # shared with an order that came here before, or the end of a path
        seen.add(state)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        rest = [f for f in filters if f not in state]
        counts = [F.count_if(f).alias(f"{f}_removed") for f in rest] + [F.count_if(F.col(f) & F.col(x)).alias(f"{f}_{x}") for f in rest for x in losses]
        found = survivors.groupBy("part").agg(F.count("*").alias("n"), *counts)
        each = F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f"{f}_removed").alias("removed"), *[F.col(f"{f}_{x}").alias(f"{x}_lost") for x in losses]) for f in rest])
        name = "".join(f for f in filters if f in state)
        found.select(F.lit(name).alias("state"), "part", "n", F.explode(each).alias("e")).select("state", "part", "n", "e.*").write.mode("append").parquet(path)
        for f in rest:
            visit(survivors.where(~F.col(f)), state | {f})
        survivors.unpersist()

    visit(rows.select("part", *filters, *losses), frozenset())
    schema = "state string, part string, n bigint, filter string, removed bigint, " + ", ".join(f"{x}_lost bigint" for x in losses)
    return rows.sparkSession.read.schema(schema).parquet(path)


def audit(rows: DataFrame, filters: Sequence[str], losses: Sequence[str], ws: Workspace) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, <loss>_lost, shapley: a row for each part, order of the filters
    (single letters) and step.

    rows: part, and a boolean (never null) for each filter (fails) and each loss. Removed: survivors of the steps before that fail. Redundant: rows
    that fail and were removed before. unique_fails: rows that fail this filter alone. shapley: removed by this filter, summed over all orders.
    """
    k, spark = len(filters), rows.sparkSession
    if k > 6 or any(len(f) != 1 for f in filters):
        raise ValueError("at most six filters, each a letter")
    made = edges(ws.table(rows, "flags"), filters, losses, ws)
    named = lambda done: "".join(f for f in filters if f in done)
    pairs = sorted({(named(order[:i]), order[i]) for order in permutations(filters) for i in range(k)})
    plan = spark.createDataFrame([("".join(o), i + 1, named(o[:i]), o[i]) for o in permutations(filters) for i in range(k)], "filter_order string, step int, state string, filter string")
    every = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter")) for s, f in pairs]))
    counts = [c for c in made.columns if c not in ("state", "part", "filter")]
    full = made.select("part").distinct().select("part", every.alias("e")).select("part", "e.*").join(made, ["part", "state", "filter"], "left").fillna(0, counts)
    alone = F.concat(*[F.when(F.col("filter") != f, F.lit(f)).otherwise("") for f in filters])
    size = F.length("state")
    orders = F.element_at(F.array(*[F.lit(math.factorial(i) * math.factorial(k - 1 - i)) for i in range(k)]), size + 1)
    sums = full.groupBy("part", "filter").agg(F.sum(F.when(size == 0, F.col("removed"))).alias("fails"), F.sum(F.when(F.col("state") == alone, F.col("removed"))).alias("unique_fails"), F.sum(orders * F.col("removed")).alias("shapley"))
    told = full.join(sums, ["part", "filter"]).join(F.broadcast(plan), ["state", "filter"])  # k * k! rows
    return told.select("part", "filter_order", "step", (F.col("n") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *[f"{x}_lost" for x in losses], "shapley")
