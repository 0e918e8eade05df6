"""Ordered operators: kinematics, islands, chunks, fills, nearest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneqa.operators import ordered


def _w(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def forward_difference(df: DataFrame, by: str, order: str, time_us: str, value: str, out: str) -> DataFrame:
    """(next value - value) / seconds; 0 at the end of a group and where time doesn't pass."""
    w = _w([by], [order])
    dt = (F.lead(time_us).over(w) - F.col(time_us)) / 1e6
    return df.withColumn(out, F.coalesce(F.when(dt > 0, (F.lead(value).over(w) - F.col(value)) / dt), F.lit(0.0)))


def centred_acceleration(df: DataFrame, by: str, order: str, time_us: str, value: str, out: str) -> DataFrame:
    """The change between the velocities ahead and behind over the mean step; null at the edges."""
    w = _w([by], [order])
    ahead = (F.lead(time_us).over(w) - F.col(time_us)) / 1e6
    behind = (F.col(time_us) - F.lag(time_us).over(w)) / 1e6
    v = F.when(ahead > 0, (F.lead(value).over(w) - F.col(value)) / ahead) - F.when(behind > 0, (F.col(value) - F.lag(value).over(w)) / behind)
    return df.withColumn(out, v / ((ahead + behind) / 2))


def islands(df: DataFrame, order: str, key: str, by: list[str] | None = None) -> DataFrame:
    """Runs of equal keys in order: island, key, first, last, n. by: runs within these columns alone, whose groups fit a task;
    ordered.islands() is for groups that don't, as is the whole table without `by`.
    """
    if not by:
        return ordered.islands(df, order, key)
    w = Window.partitionBy(*by).orderBy(order)
    numbered = df.withColumn("_change", F.when(F.col(key) == F.lag(key).over(w), 0).otherwise(1)).withColumn("island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island", key).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def keyframes(df: DataFrame, by: str, order: str, every: int, chunk: int, *token: str) -> DataFrame:
    """Every k-th row of a group in chunks: chunk, frame, token, prev, next ('' at the ends of a chunk)."""
    w = _w([by], [order])
    kept = df.withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") % every == 0)
    kept = kept.withColumn("_k", (F.col("_i") / every).cast("int")).withColumn("chunk", F.floor(F.col("_k") / chunk).cast("int")).withColumn("frame", F.col("_k") % chunk)
    kept = kept.withColumn("token", F.md5(F.concat_ws("|", *[F.col(t).cast("string") for t in token]).cast("binary")))
    c = Window.partitionBy(by, "chunk").orderBy("frame")
    return kept.withColumn("prev", F.coalesce(F.lag("token").over(c), F.lit(""))).withColumn("next", F.coalesce(F.lead("token").over(c), F.lit(""))).drop("_i", "_k")


def consecutive(df: DataFrame, by: str, order: str, value: str, n: int, out: str) -> DataFrame:
    """The values of a row and the n - 1 after it; null where the group ends before."""
    rows = F.collect_list(value).over(_w([by], [order]).rowsBetween(0, n - 1))
    return df.withColumn(out, F.when(F.size(rows) == n, rows))


def last_write(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last in order."""
    fields = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_last"))
    return picked.select(*keys, "_last.*")


def nearest_fill(df: DataFrame, by: str, order: str, label: str, out: str) -> DataFrame:
    """A row without a label takes that of the nearest labelled row of its group; a tie goes to the lower one."""
    at = F.when(F.col(label).isNotNull(), F.col(order))
    back, ahead = (Window.partitionBy(by).orderBy(c).rowsBetween(Window.unboundedPreceding, 0) for c in (F.asc(order), F.desc(order)))
    lo, hi = F.last(at, True).over(back), F.last(at, True).over(ahead)
    low, high = F.last(label, True).over(back), F.last(label, True).over(ahead)
    lower = lo.isNotNull() & (hi.isNull() | (F.col(order) - lo <= hi - F.col(order)))
    return df.withColumn(out, F.when(lower, low).otherwise(high))


def asof_nearest(left: DataFrame, right: DataFrame, by: str, time: str, value: str, tolerance: int, out: str) -> DataFrame:
    """The value of the nearest right row in time within a tolerance, a tie to the earlier one; null without.

    One union and one window instead of a range join: each left row looks at the right row before (or at) it and after it.
    """
    both = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).unionByName(right.select(by, time, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), True)
    right_at = F.when(F.col("_side") == 0, F.struct(F.col(time).alias("t"), F.col("_v").alias("v")))
    before = F.last(right_at, True).over(Window.partitionBy(by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(right_at, True).over(Window.partitionBy(by).orderBy(F.desc(time), "_side").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_b", before).withColumn("_a", after)
    db, da = F.col(time) - F.col("_b.t"), F.col("_a.t") - F.col(time)
    near = F.when((db <= tolerance) & (da.isNull() | (db <= da)), F.col("_b.v")).when(da <= tolerance, F.col("_a.v"))
    return both.where("_side = 1").withColumn(out, near).drop("_side", "_v", "_a", "_b")


def running_offset(df: DataFrame, by: list[str], order: list[str], size: str, out: str) -> DataFrame:
    """The sum of the sizes before each row, in each group or, without `by`, in the whole table."""
    if not by:
        return ordered.running_offset(df, order, size, out)
    return df.withColumn(out, F.coalesce(F.sum(size).over(_w(by, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
