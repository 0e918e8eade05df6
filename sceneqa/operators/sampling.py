"""Reproducible samples, splits, shards, pools and packing. Order comes from md5 of a seed and a key, so every engine agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneqa.operators import ordered
from sceneqa.operators.matching import per_key


def hash_order(seed: str, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from 32 bits of a hash of the seed and the keys."""
    named = [F.lit(k) if isinstance(k, str) else k.cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *named).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def stratified(df: DataFrame, by: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum (all of a smaller one)."""
    w = Window.partitionBy(by).orderBy(hash_order(seed, by, key), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def train_val(df: DataFrame, by: str, key: str, cap: int, seed: str) -> DataFrame:
    """split = val for the first min(cap, n // 5) rows of each group in hash order, else train. Only cap rows of a group are ranked."""
    w = Window.partitionBy(by).orderBy(hash_order(seed, by, key), key)
    first = df.select(by, key).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap)  # the limit goes before the shuffle
    sizes = df.groupBy(by).agg(F.floor(F.count("*") / 5).alias("_most"))
    val = first.join(sizes, by).where(F.col("_r") <= F.col("_most")).select(by, key, F.lit(True).alias("_val")).dropDuplicates([by, key])
    return df.join(val, [by, key], "left").withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_val").select(*df.columns, "split")


def percent(df: DataFrame, key: str, pct: int, seed: str, buckets: int = 1024) -> DataFrame:
    """max(1, n * pct // 100) rows exactly. Hash buckets below the border come whole; only the border's bucket is ranked."""
    h = df.withColumn("_h", hash_order(seed, key)).withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * buckets / 65536)
    h = h.withColumn("_b", F.floor("_b").cast("int"))
    counts = h.groupBy("_b").agg(F.count("*").alias("_n"))  # at most `buckets` rows
    total = Window.partitionBy()
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    plan = counts.select("_b", F.greatest(F.lit(1), F.floor(F.sum("_n").over(total) * pct / 100)).alias("_want"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), "_n")
    plan = plan.where(F.col("_before") < F.col("_want"))
    kept = h.join(F.broadcast(plan), "_b")
    whole = kept.where(F.col("_before") + F.col("_n") <= F.col("_want"))
    border = kept.where(F.col("_before") + F.col("_n") > F.col("_want"))
    border = border.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))).where(F.col("_before") + F.col("_r") <= F.col("_want")).drop("_r")
    return whole.union(border).select(df.columns)


def shard(df: DataFrame, index: str, stride: int, offset: int) -> DataFrame:
    return df.where(F.pmod(F.col(index), F.lit(stride)) == offset)


def pool_plan(df: DataFrame, pool: str, category: str, order: list[str]) -> DataFrame:
    """pool, category, n, start: pools one after another in the order named, categories by name within."""
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col(pool))
    counts = df.groupBy(pool, category).agg(F.count("*").alias("n")).withColumn("_o", rank)
    w = Window.orderBy("_o", category).rowsBetween(Window.unboundedPreceding, -1)  # pools x categories rows
    return counts.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("_o")


def view_buckets(df: DataFrame, views: Column, category: str, least: int) -> DataFrame:
    """Rows of each (view, category); a row belongs to each of its views; small buckets go."""
    return df.select(category, F.explode(F.array_distinct(views)).alias("view")).groupBy("view", category).agg(F.count("*").alias("n")).where(F.col("n") >= max(1, least))


def capped_weights(weights: list[float], cap: float) -> list[float]:
    """Shares of at most cap, the excess spread evenly over the rest, again and again; uniform if that can't be."""
    n = len(weights)
    if not n or cap * n < 1:
        return [1 / n] * n if n else []
    total = sum(weights)
    w = [x / total for x in weights] if total else [1 / n] * n
    held = [False] * n
    while any(x > cap + 1e-12 for x in w):
        excess = sum(x - cap for x in w if x > cap)
        held = [h or x >= cap for h, x in zip(held, w, strict=True)]
        free = held.count(False)
        w = [cap if h else x + excess / free for h, x in zip(held, w, strict=True)]
    return w


def two_stage_draw(plan: DataFrame, draws: int, seed: int) -> DataFrame:
    """draws rows of (draw, category, row): a category uniformly, then one of its rows, with replacement."""
    dim = plan.withColumn("_k", F.row_number().over(Window.orderBy("category")) - 1)  # a row for each category
    many = plan.count()
    base = plan.sparkSession.range(draws).select(F.col("id").alias("draw"), F.floor(uniform(seed, F.col("id"), "category") * many).cast("int").alias("_k"))
    return base.join(F.broadcast(dim), "_k").select("draw", "category", F.floor(uniform(seed, F.col("draw"), "row") * F.col("n")).cast("bigint").alias("row"))


PACKED = "batch bigint, bin bigint, key bigint, size bigint"


def bin_pack(df: DataFrame, key: str, size: str, capacity: int, batch: int = 256) -> DataFrame:
    """batch, bin, key, size: first fit by falling size (ties by key) within batches of so many rows in the order of (key, size).

    Batches are cut by the running number of a row in the whole table, so they are the same however the table is partitioned.
    A row larger than the capacity, or of null size, has a bin of its own. Rows of a null key stand first.
    """

    def pack(number: int, rows: list[dict]) -> list[tuple]:
        room: list[int] = []
        out = []
        for r in rows:
            s = r["size"]
            i = len(room) if s is None else next((i for i, left in enumerate(room) if s <= left), len(room))
            if i == len(room):
                room.append(0 if s is None else max(capacity, s))
            room[i] -= s or 0
            out.append((number, i, r["key"], s))
        return out

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(size).cast("bigint").alias("size"))
    cut = ordered.batches(rows, ["key", "size"], batch).withColumn("falling", -F.col("size"))  # nulls first
    return per_key(cut, "batch", ["falling", "key"], pack, PACKED)


def assert_shares(observed: DataFrame, expected: DataFrame, key: str, tolerance: float = 0.02) -> DataFrame:
    """key, observed, expected, ok for each cell."""
    both = observed.join(expected, key, "full")
    both = both.select(key, F.coalesce("observed", F.lit(0.0)).alias("observed"), F.coalesce("expected", F.lit(0.0)).alias("expected"))
    return both.withColumn("ok", F.abs(F.col("observed") - F.col("expected")) <= tolerance)
