"""Streams in place of resumable logs: rows of new files, exactly once by key; the last row of each key; hourly counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from sceneqa.operators.windows import last_write


def read_new(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Files of a folder as a stream; the checkpoint remembers those read. aged.take_ripe() is for files that are still written."""
    return spark.readStream.schema(schema).option("cleanSource", "off").parquet(folder)


def _append(stream: DataFrame, out: str, checkpoint: str) -> None:
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_once(stream: DataFrame, out: str, checkpoint: str, keys: list[str]) -> None:
    """Appends the first row of each key, and stops when no file is new.

    Keys are the stream's state, so a batch reads nothing of the output; the sink's own log makes a repeated batch count once.
    """
    _append(stream.dropDuplicates(keys), out, checkpoint)


def _tuples(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    """Some columns row by row, what is missing as None. A frame is a few rows of one key, of which lists cost less than a table's operations."""
    return list(zip(*[[None if v is None or v is pd.NaT or v is pd.NA or v != v else v for v in frame[c].tolist()] for c in columns], strict=True))


def newest(stream: DataFrame, keys: list[str], order: list[str], time: str | None = None, keep: str = "30 days") -> DataFrame:
    """Rows that are later, by `order`, than all before them of their key: the changes that make `last row wins`.

    The state of a key is its order so far. Without `time` it stays; with it, a timestamp column, it goes when the stream's watermark (`keep`
    behind the latest time seen) has passed the key's last time by `keep` again, and rows behind the watermark are dropped. A row of a key whose
    state has gone is a change again, of which last_rows() gives the right one. Nulls of the order stand first, a key of null is a key.
    `order` should be total.
    """
    schema, late = stream.schema, int(pd.Timedelta(keep).total_seconds() * 1000)
    state = StructType([schema[c] for c in order])
    rank = lambda row: tuple((v is not None, v) for v in row)

    def later(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        best, at, seen = None, rank(held.get) if held.exists else None, 0
        for frame in frames:
            ranks = [rank(row) for row in _tuples(frame, order)]
            i = max(range(len(ranks)), key=ranks.__getitem__, default=None)
            if i is not None and (at is None or ranks[i] > at):
                best, at = frame.iloc[[i]], ranks[i]
            if time:
                seen = max(seen, int(frame[time].max().timestamp() * 1000))
        if best is not None:
            held.update(tuple(v for _, v in at))
            yield best
        if time:
            held.setTimeoutTimestamp(max(seen, held.getCurrentWatermarkMs()) + late + 1)

    marked = stream.withWatermark(time, keep) if time else stream
    return marked.groupBy(*keys).applyInPandasWithState(later, schema, state, "append", GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout)


def keep_last(stream: DataFrame, out: str, checkpoint: str, keys: list[str], order: list[str], time: str | None = None, keep: str = "30 days") -> None:
    """Appends the changes of newest() to a log, and stops when no file is new."""
    _append(newest(stream, keys, order, time, keep), out, checkpoint)


def last_rows(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key of a log of changes."""
    return last_write(log, keys, [F.col(c) for c in order])


def hourly_counts(events: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """window start and event_type to n; rows later than the watermark's delay don't count in a stream."""
    at = F.window(F.col(time).cast("timestamp"), "1 hour")
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay) if events.isStreaming else events
    return marked.groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
