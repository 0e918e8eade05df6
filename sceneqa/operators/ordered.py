"""Values that depend on the order of a whole table, or of a hot group, without a window that holds it.

The table is range-partitioned by its order and written once with the number of each row's range, so that every later pass sees
the same ranges, also where an executor was lost. Each range is sorted and scanned by itself. A summary of each range (sums, last and first values:
whatever joins associatively) is scanned over the ranges alone, and what stands before a range is carried into it. With `by` values
start anew in each group; only a group that ends one range and begins another reaches over a border, so the carried rows are at most two for
each range, whatever the number of groups. Ranges decide the balance of the tasks, never a value.

The order is ascending, nulls first. It should be total: rows that are equal in all of it stand in any order, in one range.
Sums are exact for integers and decimals. A null of `by` is a group. An empty table stays empty. The columns `_range` and
those that a scan adds must not be in the input, of which only the columns needed should be given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sceneqa.sources.scratch import written


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


class Ranges:
    """`df` with `_range`, the number of its range of (by, order); scan() adds running values to it or to what was made of it
    row by row.
    """

    def __init__(self, df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), parts: int | None = None):
        self.by, self.order = list(by), _cols(order)
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = df.repartitionByRange(parts, *_cols(self.by), *self.order).withColumn("_range", F.spark_partition_id())
        self.df = written(ranged, "ranges")
        self.groups = self._groups()

    def _groups(self) -> DataFrame | None:
        """The groups that may reach over a border: at most one for each range."""
        if not self.by:
            return None
        group = F.struct(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(self.by)])
        ends = self.df.groupBy("_range").agg(F.min(group).alias("first"), F.max(group).alias("last")).orderBy("_range").collect()
        reach = [tuple(r.last) for r, then in zip(ends, ends[1:], strict=False) if r.last == then.first]
        kind = T.StructType([T.StructField(f"_b{i}", self.df.schema[b].dataType) for i, b in enumerate(self.by)])
        return self.df.sparkSession.createDataFrame(list(dict.fromkeys(reach)), kind)

    def scan(self, df: DataFrame | None = None, sums: dict[str, str | Column] | None = None, lasts: dict[str, str | Column] | None = None, nexts: dict[str, str | Column] | None = None, lags: dict[str, str | Column] | None = None) -> DataFrame:
        """Adds by name: the sum of the rows up to and with each row; the last value that isn't null up to it; the first one from it
        on; `lags`: a struct `value` of the row before, null for the first row of a group.
        """
        df = self.df if df is None else df
        named = [(kind, out, F.col(c) if isinstance(c, str) else c) for kind, many in (("sum", sums), ("last", lasts), ("next", nexts), ("lag", lags)) for out, c in (many or {}).items()]
        at = F.struct(*self.order)
        held = lambda c: F.struct(c.alias("value"))
        some = lambda c: F.when(c.isNotNull(), held(c))

        summary = {"sum": F.sum, "last": lambda c: F.max_by(some(c), F.when(c.isNotNull(), at)), "next": lambda c: F.min_by(some(c), F.when(c.isNotNull(), at)), "lag": lambda c: F.max_by(held(c), at)}
        over = Window.partitionBy(*[f"_b{i}" for i in range(len(self.by))])
        before, after = (over.orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in (F.asc("_at"), F.desc("_at")))
        carried = {"sum": lambda c: F.sum(c).over(before), "last": lambda c: F.last(c, True).over(before), "next": lambda c: F.last(c, True).over(after), "lag": lambda c: F.last(c, True).over(before)}
        # what follows is what precedes in falling order: a frame that reaches to the end is computed anew for each row
        inner, back = (Window.partitionBy("_range", *self.by).orderBy(*cols) for cols in (self.order, [c.desc() for c in self.order]))
        upto, on = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (inner, back))
        inside = {"sum": lambda c: F.sum(c).over(upto), "last": lambda c: F.last(some(c), True).over(upto), "next": lambda c: F.last(some(c), True).over(on), "lag": lambda c: F.lag(held(c)).over(inner)}

        same = lambda: [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(self.by)]
        reach = df.join(F.broadcast(self.groups), same(), "left_semi") if self.by else df
        parts = reach.groupBy(F.col("_range").alias("_at"), *[F.col(b).alias(f"_b{i}") for i, b in enumerate(self.by)]).agg(*[summary[kind](c).alias(f"_c{i}") for i, (kind, _, c) in enumerate(named)])
        carry = parts.select("_at", *[f"_b{i}" for i in range(len(self.by))], *[carried[kind](F.col(f"_c{i}")).alias(f"_c{i}") for i, (kind, _, _) in enumerate(named)])
        out = df.select("*", *[inside[kind](c).alias(f"_i{i}") for i, (kind, _, c) in enumerate(named)])
        out = out.join(F.broadcast(carry), [F.col("_range") == F.col("_at"), *same()], "left")  # a row for each range and carried group
        value = {"sum": lambda i: F.coalesce(F.col(f"_i{i}") + F.col(f"_c{i}"), F.col(f"_i{i}"), F.col(f"_c{i}")), "lag": lambda i: F.coalesce(f"_i{i}", f"_c{i}")}
        latest = lambda i: F.coalesce(f"_i{i}", f"_c{i}")["value"]
        return out.select(*df.columns, *[value.get(kind, latest)(i).alias(name) for i, (kind, name, _) in enumerate(named)])


def running_offset(df: DataFrame, order: Sequence[str], size: str, out: str, by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """The sum of the sizes before each row; a null size counts as 0."""
    size_ = F.coalesce(F.col(size), F.lit(0))
    r = Ranges(df, order, by, parts)
    return r.scan(sums={"_sum": size_}).select(*df.columns, (F.col("_sum") - size_).alias(out))


def locate(df: DataFrame, order: Sequence[str], mark: Column, out: str, by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """The last mark that isn't null at or before each row: the scene a frame falls in, the tag that holds for a row."""
    return Ranges(df, order, by, parts).scan(lasts={out: mark}).drop("_range")


def islands(df: DataFrame, order: str, key: str, by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Runs of equal keys in order: by..., island (from 1 in each group), key, first, last, n. A null key is a run of its own row."""
    r = Ranges(df.select(*by, order, key), [order, key], by, parts)
    changed = r.scan(lags={"_before": key}).withColumn("_change", F.when(F.col(key) == F.col("_before")["value"], 0).otherwise(1))
    numbered = r.scan(changed, sums={"island": "_change"})
    return numbered.groupBy(*by, "island", key).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def nearest_fill(df: DataFrame, order: str, label: str, out: str, by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """A row without a label takes that of the nearest labelled row of its group by `order`; a tie goes to the lower one."""
    at = F.when(F.col(label).isNotNull(), F.struct(F.col(order).alias("o"), F.col(label).alias("l")))
    both = Ranges(df, [order, label], by, parts).scan(lasts={"_lo": at}, nexts={"_hi": at})
    lower = F.col("_lo").isNotNull() & (F.col("_hi").isNull() | (F.col(order) - F.col("_lo")["o"] <= F.col("_hi")["o"] - F.col(order)))
    return both.select(*df.columns, F.coalesce(F.col(label), F.when(lower, F.col("_lo")["l"]).otherwise(F.col("_hi")["l"])).alias(out))


def asof_nearest(left: DataFrame, right: DataFrame, time: str, value: str, tolerance: int, out: str, by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """The value of the nearest right row in time within a tolerance, a tie to the earlier one; null without. Of right rows at one
    time the largest value counts.
    """
    right = right.groupBy(*by, time).agg(F.max(value).alias("_v"))
    both = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(0)), True)
    at = F.when(F.col("_side") == 0, F.struct(F.col(time).alias("t"), F.col("_v").alias("v")))
    rest = [c for c in left.columns if c not in (*by, time)]  # makes the order total
    near = Ranges(both, [time, "_side", *rest], by, parts).scan(lasts={"_b": at}, nexts={"_a": at}).where("_side = 1")
    db, da = F.col(time) - F.col("_b")["t"], F.col("_a")["t"] - F.col(time)
    found = F.when((db <= tolerance) & (da.isNull() | (db <= da)), F.col("_b")["v"]).when(da <= tolerance, F.col("_a")["v"])
    return near.select(*left.columns, found.alias(out))


def batches(df: DataFrame, order: Sequence[str], size: int, out: str = "batch", parts: int | None = None) -> DataFrame:
    """The number (from 0) of the batch of so many rows, in order, that a row falls in."""
    seen = Ranges(df, order, (), parts).scan(sums={"_seen": F.lit(1).cast("bigint")})
    return seen.select(*df.columns, F.expr(f"(_seen - 1) div {size}").alias(out))


def intervals_with_instant(intervals: DataFrame, instants: DataFrame, start: str, end: str, at: str, by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Intervals in which an instant of the same group lies, its ends not counted; each row once, repeated rows as often as they are.

    The first instant after the start decides, so no interval meets more than one, and one group with all rows is split like any
    other. A null of `by`, of an end or of an instant meets nothing; an interval that ends where it starts, or before, holds
    nothing. `start`, `end` and `at` have one type. Columns are those of `intervals`; `by` has the same names on both sides.
    """
    known = lambda df, *more: df.dropna(subset=[*by, *more]) if by or more else df
    here = known(instants, at).select(*by, F.col(at).alias("_t")).distinct()
    there = known(intervals, start, end).where(F.col(start) < F.col(end))
    row = F.struct(*intervals.columns)
    both = there.select(*by, F.col(start).alias("_t"), F.lit(1).alias("_side"), F.col(end).alias("_e"), row.alias("_row")).unionByName(here.withColumn("_side", F.lit(0)), True)
    # at one time instants stand before intervals, so only later ones follow an interval; the rest spreads equal starts over ranges
    order = ["_t", "_side", "_e", F.xxhash64(*[F.col("_row")[c] for c in intervals.columns if not isinstance(intervals.schema[c].dataType, (T.MapType, T.VariantType))])]
    near = Ranges(both, order, by, parts).scan(nexts={"_next": F.when(F.col("_side") == 0, F.col("_t"))})
    return near.where("_side = 1 and _next < _e").select("_row.*")
