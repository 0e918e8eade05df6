"""Packing: concatenate and cut.

Pass one encodes each partition and writes its documents with their place inside the partition. The totals of the
partitions, one number each, give every partition its place in the whole stream. Pass two cuts the stream into
fixed windows: a document that crosses a border gives a boundary record on either side. Nothing is shuffled, and no
order is asked of the documents, so neither a hot source nor a very long text gathers in one task.

Null and empty texts consist of the end id alone. Repeated rows are packed as often as they stand. An empty table
gives no pieces. Further columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneqa.llm.common import Workspace, sum_to_base, text_array, texts
from sceneqa.llm.tokens import encoder

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded_length bigint, ids binary"


def encode_local(df: DataFrame, path: str, keeps_blanks: bool, end_id: int) -> DataFrame:
    """doc_id, ids (2 bytes each, end_id last), part, local: the partition and the ids before the row in it.

    Correct only once written: a partition computed anew could hold other rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, keeps_blanks, end_id)
        part, local = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, sizes = encode(text_array(batch))
            at = local + np.cumsum(sizes) - sizes
            local += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(np.full(len(ids), part)), pa.array(at)], names=["doc_id", "ids", "part", "local"])

    return texts(df).mapInArrow(run, "doc_id bigint, ids binary, part bigint, local bigint")


def totals(encoded: DataFrame) -> dict[int, int]:
    """What stands before each partition: as many numbers as there were partitions."""
    rows = encoded.groupBy("part").agg(F.max(F.col("local") + F.length("ids") / 2).cast("bigint").alias("n")).collect()
    return sum_to_base({r.part: r.n for r in rows})


def padded(length: int, window: int) -> int:
    """A sequence is filled up to the window, but for one whose length is a power of two."""
    return length if length & (length - 1) == 0 else window


def pack(docs: DataFrame, path: str, keeps_blanks: bool = True, end_id: int = 0, window: int = 1024, with_ids: bool = True) -> DataFrame:
    """One row per piece; ids is the piece's content (null unless with_ids), padded_length the length of its sequence once padded."""
    ws = Workspace(docs.sparkSession, "packing")
    encoded = ws.table(encode_local(docs, path, keeps_blanks, end_id), "encoded")
    sizes = encoded.groupBy().agg(F.sum(F.length("ids") / 2).cast("bigint").alias("n")).first()
    base, total = totals(encoded), sizes.n or 0
    last = padded(total % window, window) if total % window else window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for doc, ids, part, local in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, at, done = len(ids) // 2, base[part] + local, 0
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                while done < n:
                    seq, offset = divmod(at + done, window)
                    k = min(n - done, window - offset)
                    piece = (doc, done, k, zlib.crc32(wide[4 * done : 4 * (done + k)]), n, seq, offset, last if seq == (total - 1) // window else window, ids[2 * done : 2 * (done + k)] if with_ids else None)
                    for c, v in zip(cols, piece, strict=True):
                        c.append(v)
                    done += k
            kinds = [pa.int64()] * 8 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return encoded.mapInArrow(cut, PIECES)
