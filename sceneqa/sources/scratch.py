"""Tables written once, to cut lineage: in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a temporary folder where that is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return tempfile.mkdtemp(prefix="sceneqa-scratch-")


def delete(spark: SparkSession, path: str) -> None:
    """Removes a path of any store, if the session is still there."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    try:
        there = sc._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(sc._jsc.hadoopConfiguration()).delete(there, True)
    except (ConnectionError, OSError):  # the JVM has ended
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """What costs much and is read several times: written, read again, removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)
