"""Model calls as an operator: rows in, one row each out, errors as a column, retries on answers that break the contract."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: prompt, attempt -> answer
Completer = Callable[[str, int], str]
#: Seconds that back-off waits at most (fixed value).
LONGEST_WAIT = 10.0


class Bucket:
    """Lets `rate` calls a second begin, and as many at once; its threads wait for their turn. No rate: all at once."""

    def __init__(self, rate: float | None):
        self.rate, self.left, self.at, self.lock = rate, max(1.0, rate or 0.0), time.monotonic(), threading.Lock()

    def take(self) -> None:
        if not self.rate:
            return
        with self.lock:
            now = time.monotonic()
            self.left = min(max(1.0, self.rate), self.left + (now - self.at) * self.rate) - 1
            self.at, wait = now, max(0.0, -self.left / self.rate)
        time.sleep(wait)


def complete(df: DataFrame, key: str, prompt: str, make: Callable[[], Completer], valid: Callable[[str], bool], tries: int = 3, wait: float = 0.0, inflight: int = 1, rate: float | None = None) -> DataFrame:
    """key, answer, attempts, error for each row. `make` builds the client once per task, on the executor.

    An answer that isn't valid and a call that raises are tried again, the latter after wait * 2 ** attempt seconds (LONGEST_WAIT
    at most). A row without a valid answer after all tries keeps the last error: its message, or `invalid`.

    A task has up to `inflight` calls open at a time (the client has to bear that) and begins `rate` of them a second at most, tries included; twice
    as many rows as calls wait for their turn or for a slower row before them, so rows leave in the order they came and memory is bounded.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, bucket = make(), Bucket(rate)

        def call(p: str) -> tuple[str | None, int, str | None]:
            error, n = None, 0
            for n in range(1, tries + 1):
                bucket.take()
                try:
                    got = client(p, n)
                except Exception as e:  # noqa: BLE001 - any failure of a client becomes the row's error
                    error = str(e)
                    if n < tries and wait:
                        time.sleep(min(wait * 2 ** (n - 1), LONGEST_WAIT))
                    continue
                if valid(got):
                    return got, n, None
                error = "invalid"
            return None, n, error

        with ThreadPoolExecutor(inflight) as pool:
            for frame in frames:
                out, open_ = [], deque()
                for k, p in zip(frame[key], frame[prompt], strict=True):
                    if len(open_) == 2 * inflight:
                        done, answer = open_.popleft()
                        out.append((done, *answer.result()))
                    open_.append((k, pool.submit(call, p)))
                out += [(k, *answer.result()) for k, answer in open_]
                yield pd.DataFrame(out, columns=[key, "answer", "attempts", "error"])

    return df.select(key, prompt).mapInPandas(run, f"{key} bigint, answer string, attempts int, error string")


def complete_into(df: DataFrame, key: str, prompt: str, make: Callable[[], Completer], valid: Callable[[str], bool], out: str, chunks: int = 16, **how) -> DataFrame:
    """complete() that can be taken up again: answers go to a Parquet table chunk by chunk (by a hash of the key), and rows that have
    an answer there are not asked again. Rows that failed are. The table's last word on each key: an answer, else the error.
    """
    spark, kind = df.sparkSession, f"{key} bigint, answer string, attempts int, error string"
    try:
        done = spark.read.schema(kind).parquet(out).where("answer is not null").select(key)  # the files there now
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    for i in range(chunks):
        part = df.where(F.pmod(F.xxhash64(key), F.lit(chunks)) == i)
        part = part if done is None else part.join(done, key, "left_anti")
        complete(part, key, prompt, make, valid, **how).write.mode("append").parquet(out)
    row = F.struct(F.col("answer").isNotNull().alias("ok"), "attempts", "answer", "error")
    return spark.read.schema(kind).parquet(out).groupBy(key).agg(F.max(row).alias("r")).select(key, "r.answer", "r.attempts", "r.error")


def judged(df: DataFrame, key: str, rule: Column, prompt: str, make: Callable[[], Completer], valid: Callable[[str], bool], tries: int = 5, wait: float = 0.0) -> DataFrame:
    """key, answer, source, extracted: the answer that a rule finds, else a judge's.

    Only rows of which the rule says nothing (null) go to the judge, who is asked up to `tries` times, the attempt telling it how
    freely to answer. A rule's `Z` is an answer, but counts as not extracted, as does an empty one of a judge who failed.
    """
    ruled = df.withColumn("_rule", rule)
    asked = complete(ruled.where("_rule is null"), key, prompt, make, valid, tries, wait)
    by_rule = ruled.where("_rule is not null").select(key, F.col("_rule").alias("answer"), F.lit("rule").alias("source"))
    by_judge = asked.select(key, F.coalesce("answer", F.lit("")).alias("answer"), F.lit("judge").alias("source"))
    return by_rule.union(by_judge).withColumn("extracted", ~F.col("answer").isin("", "Z"))


def equal_by_judge(df: DataFrame, key: str, rule: Column, prompt: str, make: Callable[[], Completer], tries: int = 5) -> DataFrame:
    """key, correct: what a rule says (true), else whether a judge answers yes."""
    out = judged(df, key, F.when(rule, F.lit("yes")), prompt, make, lambda a: a.strip().lower()[:2] in ("ye", "no"), tries)
    return out.select(key, F.lower(F.trim("answer")).startswith("ye").alias("correct"))
