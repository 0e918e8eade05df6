"""The queries of the llm operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneqa.llm import decontaminate, interaction, mixing, ngrams, oracles, packing, periodic, pii, quality, simhash, substrings, token_store, toxicity, vectors
from sceneqa.llm.common import Workspace, crc_column


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(read(spark, sf_dir, "documents"))


def op2_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(read(spark, sf_dir, "documents"), crc_column() % 5 == 1)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op3")
    return token_store.read_store(token_store.write_store(read(spark, sf_dir, "documents"), ws, public_tokenizers.path("word_bpe_49k.json"), keeps_blanks=False, end_id=1))


def op4_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = read(spark, sf_dir, "documents"), Workspace(spark, "op4")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels"), ws), ws=ws)


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), counted=True)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["words"])
    sha = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), sha.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(read(spark, sf_dir, "documents")).drop("kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), crc_column() % 4 == 2
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(~held), Workspace(spark, "op8"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cluster(read(spark, sf_dir, "embeddings"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), Workspace(spark, "op11"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "place", "epochs")


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which one document in ten repeats a piece of itself to the end, as the query's contract says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    cut = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    g = F.floor(F.col("h") / 10)
    cut = cut.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", 1, F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(planted_runs(read(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    milli = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", milli, F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))


def op13_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op13")
    rows = interaction.flagged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ws)
    return interaction.audit(rows, "ABCDE", ("good", "toxic"), ws)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_simhash, op2_ngram_trie, op3_token_store, op4_resampling, op5_pseudonyms, op6_decontamination, op7_substrings, op8_toxicity, op9_packing, op10_vectors, op11_mixing, op12_periodic, op13_interaction)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
