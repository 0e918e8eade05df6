"""What file names and nested documents tell: indices, categories, reports, labels, question banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneqa.operators.windows import last_write


def names(spark: SparkSession, root: str, pattern: str, regex: str, *fields: str, recursive: bool = False) -> DataFrame:
    """path and the groups of a pattern for each file below a root whose name matches; contents aren't read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(root).select("path")
    found = df.where(F.col("path").rlike(regex))
    return found.select("path", *[F.regexp_extract("path", regex, i + 1).alias(f) for i, f in enumerate(fields)])


def sample_indices(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """Distinct sample numbers at the beginning of file names."""
    return names(spark, root, pattern, r"/(\d+)_[^/]*$", "n", recursive=True).select(F.col("n").cast("bigint").alias("sample_idx")).distinct()


def detections(spark: SparkSession, root: str) -> DataFrame:
    """token to path from `index_token.json`; of several the greatest path."""
    return names(spark, root, "*.json", r"/\d+_([^/]+)\.json$", "token").groupBy("token").agg(F.max("path").alias("path"))


def categories(spark: SparkSession, root: str, skip: str = "subset") -> DataFrame:
    """Category names of `name_CATEGORY.json`, without subset files."""
    return names(spark, root, "*.json", r"_([A-Z]{3})(?:\.|_)[^/]*json$", "category").where(~F.contains(F.col("path"), F.lit(skip))).select("category").distinct()


def stage_reports(spark: SparkSession, root: str) -> DataFrame:
    """number, stage, report (JSON text) of `stage_NN_NAME/eval_report.json`."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "eval_report.json").text(root)
    regex = r"/stage_(\d+)_([^/]+)/eval_report\.json$"
    path = F.col("_metadata.file_path")
    return df.where(path.rlike(regex)).select(F.regexp_extract(path, regex, 1).cast("int").alias("number"), F.regexp_extract(path, regex, 2).alias("stage"), F.col("value").alias("report"))


def worker_reports(spark: SparkSession, root: str, frames: str) -> DataFrame:
    """Frames of all `predictions_worker*.json`; of a frame position the last worker's."""
    df = spark.read.schema(f"frames array<struct<frame_pos bigint, {frames}>>").option("multiLine", True).option("pathGlobFilter", "predictions_worker*.json").json(root)
    rows = df.select(F.col("_metadata.file_name").alias("_file"), F.explode("frames").alias("f")).select("_file", "f.*")
    return last_write(rows, ["frame_pos"], [F.col("_file")]).drop("_file")


def scene_labels(spark: SparkSession, root: str) -> DataFrame:
    """token, idx, label from `scene_*.json` {sample_labels: {token: {idx: label}}}; the last file wins."""
    df = spark.read.schema("sample_labels map<string,map<string,int>>").option("multiLine", True).option("pathGlobFilter", "scene_*.json").json(root)
    rows = df.select(F.col("_metadata.file_name").alias("_file"), F.explode("sample_labels").alias("token", "m")).select("_file", "token", F.explode("m").alias("idx", "label"))
    return last_write(rows.withColumn("idx", F.col("idx").cast("int")), ["token"], [F.col("_file"), F.col("idx")]).drop("_file")


TEMPLATE = "struct<template:string,placeholders:map<string,array<string>>,answer_type:string>"


def question_bank(bank: DataFrame) -> DataFrame:
    """category, template_idx (from 1) and template fields of both shapes (templates, or sub_categories' templates in order)."""
    templates: Column = F.coalesce(F.flatten(F.transform("sub_categories", lambda s: s["templates"])), F.col("templates"))
    rows = bank.select("category", F.posexplode(templates).alias("i", "t"))
    return rows.select("category", (F.col("i") + 1).alias("template_idx"), "t.*")


def demo_questions(categories_: DataFrame) -> DataFrame:
    """category, questions array to one row each, in order."""
    return categories_.select("category", F.posexplode("questions").alias("i", "question")).select("category", (F.col("i") + 1).alias("number"), "question")


def unite(datasets: dict[str, DataFrame]) -> DataFrame:
    """Datasets of one shape with their names; columns that some lack are null."""
    out = None
    for name, df in datasets.items():
        df = df.withColumn("dataset", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
