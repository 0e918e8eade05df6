"""Order-dependent matching of predicted and true boxes, one sample at a time, and what is counted from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH = "sample bigint, gt int, pred int, iou double, view_gt int, view_pred int"


def _iou(a, b) -> float:
    if None in a or None in b:
        return 0.0
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = max(0.0, w) * max(0.0, h)
    union = max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1]) + max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1]) - common
    return common / union if union > 0 else 0.0


def per_key(df: DataFrame, key: str, order: list[str], fn: Callable[[int, list[dict]], list[tuple]], schema: str) -> DataFrame:
    """fn for the rows of each key in order. Keys are streamed through sorted partitions: a task holds the rows of one
    key at a time, and a call costs no more than its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]

        def done(held: list[list[tuple]]) -> pa.RecordBatch:
            rows = [r for part in held for r in part]
            kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[c.split()[1]]) for i, c in enumerate(schema.split(", "))], names=names)

        tail: list[dict] = []
        for batch in batches:
            held = []
            for k, rows in groupby(tail + batch.to_pylist(), key=lambda r: r[key]):
                group = list(rows)
                held.append((k, group))
            tail = held.pop()[1] if held else []
            yield done([fn(k, g) for k, g in held])
        if tail:
            yield done([fn(tail[0][key], tail)])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def greedy_match(boxes: DataFrame, by_view: bool = True) -> DataFrame:
    """Rows (sample, side 'gt' or 'pred', idx, view, label, x1, y1, x2, y2) to matches.

    True boxes in their order each take the best unused predicted box with the same label (and view), even without overlap;
    equal ones go to the first. A box with a null coordinate overlaps nothing, a null label is an empty one. gt is -1 for predictions left over, pred is -1 for true boxes without a match.
    """

    def match(sample: int, rows: list[dict]) -> list[tuple]:
        sides = [[(r["idx"], r["view"], (r["label"] or "").strip().lower(), (r["x1"], r["y1"], r["x2"], r["y2"])) for r in rows if r["side"] == s] for s in ("gt", "pred")]
        used: set[int] = set()
        out = []
        for idx, view, label, box in sides[0]:
            best, at = -1.0, -1
            for i, (_, pview, plabel, pbox) in enumerate(sides[1]):
                if i in used or plabel != label or by_view and pview != view:
                    continue
                v = _iou(box, pbox)
                if v > best:
                    best, at = v, i
            used.add(at)
            out.append((sample, idx, sides[1][at][0] if at >= 0 else -1, max(best, 0.0), view, sides[1][at][1] if at >= 0 else -1))
        return out + [(sample, -1, p, 0.0, -1, pview) for i, (p, pview, _, _) in enumerate(sides[1]) if i not in used]

    return per_key(boxes, "sample", ["side", "idx"], match, MATCH)


def view_confusion(matches: DataFrame, views: list[int]) -> DataFrame:
    """view_gt by predicted view: counts of matched boxes, empty cells 0."""
    out = matches.where("gt >= 0 and pred >= 0").groupBy("view_gt").pivot("view_pred", views).count()
    return out.select("view_gt", *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"pred_{v}") for v in views])


def recall_by_view(matches: DataFrame, threshold: float) -> DataFrame:
    """Per true view: boxes, boxes matched with an overlap of the threshold or more, recall."""
    g = matches.where("gt >= 0").groupBy("view_gt").agg(F.count("*").alias("n"), F.count_if((F.col("pred") >= 0) & (F.col("iou") >= threshold)).alias("hit"))
    return g.withColumn("recall", F.col("hit") / F.greatest(F.col("n"), F.lit(1)))
