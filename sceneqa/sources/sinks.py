"""Writers: splits, categories, reports, idempotent publication."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneqa.functions.text import strip_control
from sceneqa.sources.scratch import delete


def write_partitioned(df: DataFrame, path: str, by: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per value. Rows of a value stay spread over the tasks that hold them, so a large one is no bottleneck."""
    df.write.partitionBy(by).format(fmt).mode(mode).save(path)


def category_report(df: DataFrame, category: str, known: list[str]) -> DataFrame:
    """category, n, pct for every known category, the unknown ones only in the base of the percentage."""
    dim = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(known)], f"{category} string, ord int")
    counts = df.groupBy(category).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    out = dim.join(counts, category, "left").crossJoin(F.broadcast(total))
    return out.select(category, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.round(F.try_divide(F.col("n") * 100.0, F.col("total")), 2), F.lit(0.0)).alias("pct"), "ord")


def publish_once(df: DataFrame, path: str, single: bool = False) -> bool:
    """Whether this call published the output at `path`: a Parquet folder, or with `single` one Parquet file (of a small result, made by one task).

    It is written beside its place and renamed as a whole, so a reader sees all of it or nothing; where the place is taken, by then or in
    the meantime, the rename fails and what was written is removed. Renames are atomic in HDFS and in local file systems, not in object stores.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    if fs.exists(place):
        return False
    beside = f"{path}.part-{uuid.uuid4().hex}"
    try:
        (df.coalesce(1) if single else df).write.parquet(beside)
        made = jvm.org.apache.hadoop.fs.Path(beside)
        if single:
            made = next(f.getPath() for f in fs.listStatus(made) if f.getPath().getName().startswith("part-"))
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
            context.rename(made, place, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception) and not fs.exists(place):
                raise
            return False
        return True
    finally:
        delete(spark, beside)


def scaled_once(df: DataFrame, factor: int, apply) -> DataFrame:
    """Applies a scaling once: the column bbox_scale keeps what was applied, and a second call fails."""
    scale = F.col("bbox_scale") if "bbox_scale" in df.columns else F.lit(1)
    checked = df.withColumn("bbox_scale", F.when(scale == 1, F.lit(factor)).otherwise(F.raise_error("boxes are scaled already")))
    return apply(checked)


def report_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A small report as one CSV file with a fixed column order; nulls are empty."""
    df.select(order).coalesce(1).write.option("header", True).option("nullValue", "").mode("overwrite").csv(path)


def markdown_rows(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """line: `| a | b |` with doubles rounded and nulls blank."""
    cells: list[Column] = []
    for c in columns:
        kind = dict(df.dtypes)[c]
        text = F.format_number(c, digits) if kind in ("double", "float") else F.col(c).cast("string")
        cells.append(F.coalesce(text, F.lit("")))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def excel_safe(df: DataFrame) -> DataFrame:
    return df.select(*[strip_control(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
