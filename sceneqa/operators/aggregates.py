"""Shares, cross-tabs, funnels, weights, forgetting, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(df: DataFrame, *keys: str) -> DataFrame:
    """n and pct of each key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of row by column, both with totals (`Total`); empty cells are 0."""
    cube = df.groupBy(F.coalesce(F.col(row), F.lit("(none)")).alias(row)).pivot(column, values).agg(F.count(F.lit(1)))
    cells = [F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(v) for v in values]
    body = cube.select(row, *cells).withColumn("total", sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`")))
    names = [*values, "total"]
    return body.union(body.agg(*[F.sum(f"`{v}`").alias(v) for v in names]).select(F.lit("Total").alias(row), *[f"`{v}`" for v in names]))


def funnel(df: DataFrame, steps: list[tuple[str, Column]], rest: str = "kept") -> DataFrame:
    """The first step whose condition holds, as a column `outcome`."""
    out = None
    for name, condition in steps:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return df.withColumn("outcome", out.otherwise(rest))


def inverse_frequency(df: DataFrame, key: str, classes: list) -> DataFrame:
    """weight = total / (k (n + 1)), with mean 1 over all classes, those that don't occur included; 1 each if none does."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(c,) for c in classes], df.select(key).schema)
    counted = dim.join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy()
    raw = F.sum("n").over(w) / (len(classes) * (F.col("n") + 1))
    counted = counted.withColumn("_raw", raw)
    return counted.withColumn("weight", F.coalesce(F.try_divide(F.col("_raw"), F.avg("_raw").over(w)), F.lit(1.0))).drop("_raw")


def forgetting(df: DataFrame, category: str, stage: str, value: str) -> DataFrame:
    """Per category the final value, the best before it, and best - final (may be negative; null without an earlier one)."""
    w = Window.partitionBy(category)
    marked = df.withColumn("_final", F.max(stage).over(w))
    grouped = marked.groupBy(category).agg(F.max(F.when(F.col(stage) < F.col("_final"), F.col(value))).alias("best"), F.max(F.when(F.col(stage) == F.col("_final"), F.col(value))).alias("final"))
    return grouped.withColumn("forgetting", F.col("best") - F.col("final"))


def macro(df: DataFrame, group: list[str], category: str, value: Column) -> DataFrame:
    """The mean over categories of their means; nulls count nowhere."""
    return df.groupBy(*group, category).agg(F.avg(value).alias("_m")).groupBy(*group).agg(F.avg("_m").alias("macro"))


def with_overall(df: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """One row per key and one for all (`Overall`)."""
    return df.rollup(key).agg(F.grouping(key).alias("_g"), *aggs).withColumn(key, F.when(F.col("_g") == 1, "Overall").otherwise(F.col(key))).drop("_g")
