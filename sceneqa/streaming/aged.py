"""Files that a live run may still be writing are left for later: rows of files of a least age, each version of a file once.

A run first claims the ripe files that no run has claimed, by path and time of last change, in one committed write; then it writes
their rows to its own folder of the output, and then that it is done. A run that breaks off is made again from its claim by the next one,
into the same folder, so no file is lost and none counts twice. A file that changes after it was taken is a new version; readers that
want the latest rows of a key order by `run`. Spark lists the files itself, so any store that it reads will do.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIMS = "run bigint, path string, changed timestamp"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def ripe_files(spark: SparkSession, folder: str, min_age: float, pattern: str = "*") -> DataFrame:
    """path, changed of the files below a folder that were last changed `min_age` seconds ago or more; contents are not read."""
    before = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(time.time() - min_age + 1))
    files = spark.read.format("binaryFile").option("modifiedBefore", before).option("timeZone", "UTC").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("modificationTime").alias("changed"))


def take_ripe(spark: SparkSession, folder: str, schema: str, ledger: str, out: str, min_age: float = 120.0, fmt: str = "json", pattern: str = "*", made: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int:
    """Writes what `made` makes of the rows of ripe files to out/run=<n>; the number of files taken.

    The driver holds the paths of the files of one run, as Spark's own listing does.
    """
    claims, done = _read(spark, f"{ledger}/claims", CLAIMS), _read(spark, f"{ledger}/done", "run bigint")
    open_ = claims.join(done, "run", "left_anti")
    if open_.isEmpty():
        last = claims.agg(F.max("run")).first()[0]
        fresh = ripe_files(spark, folder, min_age, pattern).join(claims, ["path", "changed"], "left_anti")
        if fresh.isEmpty():
            return 0
        fresh.select(F.lit((last or 0) + 1).cast("bigint").alias("run"), "path", "changed").write.mode("append").parquet(f"{ledger}/claims")
        open_ = spark.read.schema(CLAIMS).parquet(f"{ledger}/claims").join(done, "run", "left_anti")
    taken = 0
    for run in sorted(r.run for r in open_.select("run").distinct().collect()):
        there = ripe_files(spark, folder, 0, pattern).select("path")  # a file may have gone since
        paths = [r.path for r in open_.where(F.col("run") == run).join(there, "path", "left_semi").select("path").distinct().collect()]
        if paths:
            made(spark.read.schema(schema).format(fmt).load(paths)).write.mode("overwrite").parquet(f"{out}/run={run}")
        spark.createDataFrame([(run,)], "run bigint").write.mode("append").parquet(f"{ledger}/done")
        taken += len(paths)
    return taken
