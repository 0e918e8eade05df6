"""Predictions to metrics per category, stage matrices and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneqa.operators.aggregates import forgetting


def category_metrics(samples: DataFrame, matches: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per category: n, answer_acc, grounding_acc, format_valid, spurious and missing boxes per sample.

    samples: sample, category, correct, parsed (failed ones with both false stay in the base); matches: of greedy_match.
    """
    hit = (F.col("gt") >= 0) & (F.col("pred") >= 0)
    per = matches.groupBy("sample").agg(
        F.count_if(F.col("gt") >= 0).alias("n_gt"), F.count_if(hit).alias("n_matched"), F.count_if(hit & (F.col("iou") >= threshold)).alias("n_good"), F.count_if(F.col("gt") < 0).alias("n_spurious")
    )
    both = samples.join(per, "sample", "left").na.fill(0, ["n_gt", "n_matched", "n_good", "n_spurious"])
    base = F.greatest(F.count("*"), F.lit(1))
    boxes = F.greatest(F.sum("n_gt"), F.lit(1))
    return both.groupBy("category").agg(
        F.count("*").alias("n"), (F.count_if("correct") / base).alias("answer_acc"), (F.count_if("parsed") / base).alias("format_valid"),
        (F.sum("n_good") / boxes).alias("grounding_acc"), (F.sum("n_matched") / boxes).alias("match_rate"),
        (F.sum("n_spurious") / base).alias("spurious"), (F.sum(F.col("n_gt") - F.col("n_matched")) / base).alias("missing"),
        (F.sum(F.col("n_gt") - F.col("n_matched")) / F.greatest(F.count_if(F.col("n_gt") > 0), F.lit(1))).alias("missing_grounded"),
    )


def stage_matrix(reports: DataFrame, categories: list[str]) -> DataFrame:
    """stage by category, answer_acc before acc, and the macro of the report, else the mean of what is there."""
    value = F.coalesce("answer_acc", "acc")
    wide = reports.groupBy("stage").pivot("category", categories).agg(F.first(value, True))
    macro = reports.groupBy("stage").agg(F.coalesce(F.first("macro", True), F.avg(value)).alias("macro"))
    return wide.join(macro, "stage")


def run_summary(reports: DataFrame) -> DataFrame:
    """experiment, forgetting (mean over categories, null below two checkpoints), collapse (least macro format_valid)."""
    acc = reports.groupBy("experiment", "category", "stage").agg(F.max("answer_acc").alias("v"))
    lost = forgetting(acc.withColumn("_k", F.concat_ws("|", "experiment", "category")), "_k", "stage", "v")
    lost = lost.withColumn("experiment", F.substring_index("_k", "|", 1)).groupBy("experiment").agg(F.avg("forgetting").alias("forgetting"))
    collapse = reports.groupBy("experiment", "stage").agg(F.avg("format_valid").alias("m")).groupBy("experiment").agg(F.min("m").alias("collapse"), F.count("*").alias("checkpoints"))
    out = lost.join(collapse, "experiment")
    return out.withColumn("forgetting", F.when(F.col("checkpoints") >= 2, F.col("forgetting")))


def exposure(draws: DataFrame) -> DataFrame:
    """pool, category, n, share of the pool, share of all."""
    counts = draws.groupBy("pool", "category").agg(F.count("*").alias("n"))
    return counts.withColumn("share_of_pool", F.col("n") / F.sum("n").over(Window.partitionBy("pool"))).withColumn("share_of_total", F.col("n") / F.sum("n").over(Window.partitionBy()))
