"""Conversations to fine-tuning pairs: pairing, cleansing, deduplication, split, shares, in one lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneqa.functions.text import tidy
from sceneqa.operators.aggregates import share
from sceneqa.operators.sampling import hash_order


def qa_pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: each user turn that an assistant turn follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = conversations.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(w).alias("_role"), F.lead("text").over(w).alias("answer"))
    return c.where("role = 'user' and _role = 'assistant'").select("conv_id", "turn", "question", "answer")


def dedup_pairs(pairs: DataFrame) -> DataFrame:
    """The first row of each (question, answer); empty ones go. Grouping goes by hashes, so long texts aren't shuffled."""
    keyed = pairs.where("question <> '' and answer <> ''").select("conv_id", "turn", F.md5(F.col("question").cast("binary")).alias("q"), F.md5(F.col("answer").cast("binary")).alias("a"))
    return keyed.groupBy("q", "a").agg(F.min(F.struct("conv_id", "turn")).alias("k")).select("k.*")


def split(keys: DataFrame, cap: int, seed: str) -> DataFrame:
    """split: val for the first min(cap, n // 5) keys in hash order.

    Keys are ranked within 4,096 prefixes of their hashes; what stands before each prefix comes from the prefixes' counts.
    So no task ranks the whole table.
    """
    h = keys.withColumn("_h", hash_order(seed, "conv_id", "turn")).withColumn("_p", F.substring("_h", 1, 3))
    counts = h.groupBy("_p").agg(F.count("*").alias("_n"))
    upto, total = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    plan = counts.select("_p", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.least(F.lit(cap), F.floor(F.sum("_n").over(total) / 5)).alias("_want"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("_h", "conv_id", "turn"))
    return h.join(F.broadcast(plan), "_p").select("conv_id", "turn", F.when(rank <= F.col("_want"), "val").otherwise("train").alias("split"))


def sft_plan(conversations: DataFrame, cap: int = 1000, seed: str = "sft") -> DataFrame:
    """split, n, pct of the cleansed and deduplicated pairs."""
    pairs = qa_pairs(conversations).withColumn("answer", tidy(F.col("answer")))
    return share(split(dedup_pairs(pairs), cap, seed), "split")
