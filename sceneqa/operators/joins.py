"""Lookups, theta joins, division, instantiation, object matching by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneqa.operators.windows import last_write


def lookup_last_wins(left: DataFrame, right: DataFrame, key: str, order: list[Column], default: Column | None = None, value: str = "value") -> DataFrame:
    """Left join to the last right row of each key; Spark broadcasts the looked-up side if its statistics allow it."""
    picked = last_write(right.select(key, value, *[o.alias(f"_o{i}") for i, o in enumerate(order)]), [key], [F.col(f"_o{i}") for i in range(len(order))])
    out = left.join(picked.select(key, F.col(value).alias("_found")), key, "left")
    return out.withColumn(value, F.coalesce("_found", default if default is not None else F.lit(None))).drop("_found")


def best_pick(left: DataFrame, right: DataFrame, on: Column, left_key: str, order: list[Column], right_key: str, missing, shape: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """For each left row the candidate that comes first in order, `missing` without one. `on` should hold an equality.

    shape: the columns of left and of right on which `on` and `order` depend, but for its last, right_key. Rows that are equal in them
    meet as one, so pairs grow with the different shapes and not with the rows.
    """
    if shape:
        mine, theirs = shape
        shapes = right.where(F.col(right_key).isNotNull()).groupBy(*theirs).agg(F.min(right_key).alias(right_key), F.count("*").alias("_n"))
        first = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.col(right_key).alias("_key"))
        met = left.select(*mine).distinct().join(shapes, on).groupBy(*mine).agg(F.min(first).alias("_first"), F.sum("_n").alias("_n"))
        met = met.select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(mine)], "_first", "_n")
        every = left.select(left_key, *mine).join(met, [F.col(c).eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate(mine)], "left")
        picked = every.groupBy(left_key).agg(F.min("_first").alias("_first"), F.coalesce(F.sum("_n"), F.lit(0).cast("bigint")).alias("candidates"))
        return picked.select(left_key, F.coalesce("_first._key", F.lit(missing)).alias("picked"), "candidates")
    pairs = left.join(right, on, "left")
    picked = pairs.groupBy(left_key).agg(F.min_by(right_key, F.when(F.col(right_key).isNotNull(), F.struct(*order))).alias("picked"), F.count(right_key).alias("candidates"))
    return picked.withColumn("picked", F.coalesce("picked", F.lit(missing)))


def interval_semi(intervals: DataFrame, instants: DataFrame, key: str, start: str, end: str, at: str) -> DataFrame:
    """Intervals in which an instant of the same key lies, its ends not counted."""
    i, t = intervals.alias("i"), instants.alias("t")
    return i.join(t, (F.col(f"i.{key}") == F.col(f"t.{key}")) & (F.col(f"t.{at}") > F.col(f"i.{start}")) & (F.col(f"t.{at}") < F.col(f"i.{end}")), "left_semi")


def resume(todo: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What hasn't been written yet."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def division(df: DataFrame, key: str, member: str, members: int) -> DataFrame:
    """Keys that stand with every member."""
    return df.groupBy(key).agg(F.count_distinct(member).alias("_n")).where(F.col("_n") == members).select(key)


def priority_merge(df: DataFrame, keys: list[str], priority: Column) -> DataFrame:
    """Of several layouts of one row that with the lowest priority number."""
    fields = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*fields), priority).alias("_first")).select(*keys, "_first.*")


def batch_lookup(wanted: DataFrame, table: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of some keys in the order asked, repeated as often as asked."""
    return wanted.join(table, key).orderBy(order)


def instantiate(templates: DataFrame, values: list[DataFrame], seed: str, most: int, template_key: str) -> DataFrame:
    """The first `most` combinations of values for each template in the order of a hash. Values are dimensions of a few
    rows by contract (placeholders of a question template), which is what makes one array of each safe. Combinations are
    ranked where they arise, and no more than `most` of a template leave a task.
    """
    # the values travel as one array each, so a template multiplies within its own row
    rows, names = templates, [v.columns[0] for v in values]
    for v, name in zip(values, names, strict=True):
        lists = v.agg(F.collect_set(name).alias(f"_{name}"))
        rows = rows.crossJoin(F.broadcast(lists)).withColumn(name, F.explode(f"_{name}")).drop(f"_{name}")
    rank = F.md5(F.concat_ws("|", F.lit(seed), template_key, *names).cast("binary"))
    ord_ = F.row_number().over(Window.partitionBy(template_key).orderBy(rank, *names))
    return rows.withColumn("ord", ord_).where(F.col("ord") <= most).select(template_key, (F.col("ord") - 1).alias("ord"), *names)
