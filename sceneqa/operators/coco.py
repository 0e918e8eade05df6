"""Detection evaluation with ignored boxes: areas, numbers of detections, overlaps.

In a sample and label, predictions in the order of falling score (ties by idx) each take the free true box of largest overlap, the later one
of equals, if it reaches the threshold. True boxes outside an area's range, and crowds, are ignored: they are taken only where no other reaches
the threshold, and neither they nor what takes them count; a prediction that takes nothing counts as wrong only inside the range.
A crowd can be taken again and again, and what overlaps it is measured against the prediction's own area.

Samples are matched one by one, but all thresholds and areas, and all samples of a batch, in one pass over the ranks of predictions with
numpy. Precision is cumulated over (score, sample, rank) by a scan over ranges of that order, so ties and hot labels
are split over tasks at will.

A prediction with a null score is dropped; a box with a null coordinate overlaps nothing and has the area 0. A label is compared as it stands, null
included. `dataset`, `area` and `crowd` are optional columns: one data set, the boxes' own areas, no crowds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneqa.functions.text import strip
from sceneqa.operators.ordered import Ranges
from sceneqa.sources.scratch import written

#: Overlaps, areas in pixels and numbers of detections of the benchmark (fixed values).
THRESHOLDS = tuple(np.linspace(0.5, 0.95, 10).tolist())
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
MOST = (100, 300, 1000)
#: A metric of the summary: its area, number of detections, threshold (None: all) and whether it is a recall.
METRICS = {
    "mAP": ("all", 100, None, False),
    "mAP_50": ("all", 1000, 0.5, False),
    "mAP_75": ("all", 1000, 0.75, False),
    "mAP_s": ("small", 1000, None, False),
    "mAP_m": ("medium", 1000, None, False),
    "mAP_l": ("large", 1000, None, False),
    "AR_100": ("all", 100, None, True),
    "AR_300": ("all", 300, None, True),
    "AR_1000": ("all", 1000, None, True),
    "AR_s": ("small", 1000, None, True),
    "AR_m": ("medium", 1000, None, True),
    "AR_l": ("large", 1000, None, True),
}
COUNTED = "dataset string, label string, area string, sample bigint, score double, pos int, tp int, fp int, n_gt bigint"


def _overlaps(a: np.ndarray, b: np.ndarray, area_a: np.ndarray, area_b: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    side = np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2])
    common = np.prod(np.maximum(side, 0), axis=1)
    union = np.where(crowd, area_a, area_a + area_b - common)
    return np.nan_to_num(np.divide(common, union, out=np.zeros_like(common), where=union > 0))


def _match(rows: pd.DataFrame, thresholds: Sequence[float], areas: dict[str, tuple[float, float]], most: int) -> pd.DataFrame:
    """COUNTED rows of whole samples."""
    rows = rows.assign(group=rows.groupby(["dataset", "sample", "label"], sort=False, dropna=False).ngroup())
    xy = ["x1", "y1", "x2", "y2"]
    dets = rows[(rows.side == "pred") & rows.score.notna()].sort_values(["group", "score", "idx"], ascending=[True, False, True], kind="stable")
    dets = dets.assign(pos=dets.groupby("group").cumcount())
    dets = dets[dets.pos < most]
    gts = rows[rows.side == "gt"].sort_values(["group", "idx"], kind="stable")
    boxes, truth = (t[xy].to_numpy(float) for t in (dets, gts))
    own = [np.nan_to_num(np.prod(np.maximum(b[:, 2:] - b[:, :2], 0), axis=1)) for b in (boxes, truth)]
    crowd = gts.crowd.to_numpy(bool)
    size = np.where(gts.area.isna(), own[1], gts.area.to_numpy(float))
    low, high = (np.array([r[i] for r in areas.values()])[:, None] for i in (0, 1))
    skip = crowd | (size < low) | (size > high)  # area x true box
    inside = (own[0] >= low) & (own[0] <= high)  # area x prediction

    # pairs of a prediction and a true box of its group, by the prediction's rank, then prediction, then true box
    first = np.searchsorted(gts.group.to_numpy(), dets.group.to_numpy())
    many = np.searchsorted(gts.group.to_numpy(), dets.group.to_numpy(), "right") - first
    det = np.repeat(np.arange(len(dets)), many)
    gt = np.arange(len(det)) - np.repeat(np.cumsum(many) - many - first, many)
    rank = dets.pos.to_numpy()[det]
    order = np.argsort(rank, kind="stable")
    det, gt, rank = det[order], gt[order], rank[order]
    iou = _overlaps(boxes[det], truth[gt], own[0][det], own[1][gt], crowd[gt])

    least = np.minimum(np.array(thresholds), 1 - 1e-10)
    shape = (len(areas), len(least))
    used = np.zeros((*shape, len(gts)), bool)
    took = np.zeros((*shape, len(dets)), np.int8)  # 1 a true box that counts, 2 an ignored one
    for lo, hi in pairwise([*np.flatnonzero(np.diff(rank, prepend=-1)), len(rank)]):
        d, g, v = det[lo:hi], gt[lo:hi], iou[lo:hi]
        start = np.flatnonzero(np.diff(d, prepend=-1))
        free = (v >= least[:, None]) & (~used[:, :, g] | crowd[g])
        worth = np.where(free, v + 2.0 * ~skip[:, None, g], -1.0)
        best = np.maximum.reduceat(worth, start, axis=2)
        same = worth == np.repeat(best, np.diff(start, append=len(d)), axis=2)
        pick = np.maximum.reduceat(np.where(same, np.arange(len(d)), -1), start, axis=2)
        a, t, s = np.nonzero(best >= 0)
        g = g[pick[a, t, s]]
        used[a, t, g] = True
        took[a, t, d[start[s]]] = 1 + skip[a, g]

    bit = 1 << np.arange(len(least))[:, None]
    keys = dets[["dataset", "label", "sample", "score", "pos"]]
    out = []
    for a, name in enumerate(areas):
        tp, fp = ((x * bit).sum(axis=0) for x in (took[a] == 1, (took[a] == 0) & inside[a]))
        out.append(keys.assign(area=name, tp=tp, fp=fp, n_gt=0)[(tp | fp) > 0])
        counted = gts[~skip[a]].groupby(["dataset", "label"], dropna=False).size().rename("n_gt").reset_index()
        out.append(counted.assign(area=name, sample=-1, score=np.nan, pos=-1, tp=0, fp=0))
    return pd.concat(out)[[c.split()[0] for c in COUNTED.split(", ")]]


def counted(boxes: DataFrame, thresholds: Sequence[float] = THRESHOLDS, areas: dict[str, tuple[float, float]] = AREAS, most: int = MOST[-1]) -> DataFrame:
    """COUNTED: for each area and prediction that counts at any threshold, bits of the thresholds where it is right (tp) or wrong
    (fp); and numbers of true boxes that count (pos -1).
    """
    extra = {"dataset": F.lit("").alias("dataset"), "area": F.lit(None).cast("double").alias("area"), "crowd": F.lit(False).alias("crowd")}
    optional = [F.col(c) if c in boxes.columns else e for c, e in extra.items()]
    coordinates = [F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]
    rows = boxes.select("sample", "side", "idx", F.col("label").cast("string"), F.col("score").cast("double"), *coordinates, *optional)
    rows = rows.withColumn("crowd", F.coalesce("crowd", F.lit(False)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last sample of a batch may go on in the next
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame])
            open_ = (frame["sample"] == frame["sample"].iloc[-1]) & (frame["dataset"] == frame["dataset"].iloc[-1])
            held, done = frame[open_], frame[~open_]
            if len(done):
                yield _match(done, thresholds, areas, most)
        if held is not None:
            yield _match(held, thresholds, areas, most)

    known = rows.withColumn("dataset", F.coalesce("dataset", F.lit(""))).where("sample is not null")
    return known.repartition("dataset", "sample").sortWithinPartitions("dataset", "sample").mapInPandas(run, COUNTED)


def _level(tp: Column, n_gt: Column) -> Column:
    """The highest of the recalls 0, 0.01, ... 1 that tp of n_gt reach, in doubles."""
    recall = tp / n_gt
    near = F.rint(100 * recall)
    return F.when(near * 0.01 <= recall, near).otherwise(near - 1).cast("int")


def curves(found: DataFrame, thresholds: Sequence[float], uses: Sequence[tuple[str, int]]) -> DataFrame:
    """dataset, label, area, most, threshold, ap, recall, n_gt of counted() rows, for the pairs of area and number of detections named.

    ap: precision made monotone, read at 101 recalls. Labels without true boxes that count are left out.
    """
    by = ["dataset", "label", "area"]
    total = found.groupBy(*by).agg(F.sum("n_gt").alias("n_gt")).where("n_gt > 0")
    several = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(m).alias("m")) for a, m in uses])
    wanted = F.transform(F.filter(several, lambda u: u["a"] == F.col("area")), lambda u: u["m"])
    bits = range(len(thresholds))
    tp = [F.getbit("tp", F.lit(i)).cast("bigint") for i in bits]
    n = [F.getbit(F.col("tp").bitwiseOR(F.col("fp")), F.lit(i)).cast("bigint") for i in bits]
    rows = found.where("pos >= 0").withColumn("most", F.explode(wanted)).where("pos < most")
    by = [*by, "most"]
    seen = Ranges(rows.withColumn("falling", -F.col("score")), ["falling", "sample", "pos"], by).scan(sums={f"t{i}": tp[i] for i in bits} | {f"n{i}": n[i] for i in bits})
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("t"), F.col(f"n{i}").alias("n"), tp[i].alias("hit")) for i, t in enumerate(thresholds)])
    hits = seen.select(*by, F.inline(F.filter(each, lambda e: e["hit"] == 1)))  # precision rises at hits alone
    key = [*by, "threshold"]
    known = total.select(*[F.col(c).alias(f"_{c}") for c in by[:3]], "n_gt")
    best = hits.join(known, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in by[:3]]).groupBy(*key, _level(F.col("t"), F.col("n_gt")).alias("level")).agg(F.max(F.col("t") / F.col("n")).alias("p"), F.max("t").alias("t"))
    falling = Window.partitionBy(*key).orderBy(F.desc("level"))  # 101 rows at most
    steps = best.select(*key, "t", (F.max("p").over(falling.rowsBetween(Window.unboundedPreceding, 0)) * (F.col("level") - F.coalesce(F.lead("level").over(falling), F.lit(-1)))).alias("a"))
    area = steps.groupBy(*key).agg((F.sum("a") / 101).alias("ap"), F.max("t").alias("t"))
    grid = total.withColumn("most", F.explode(wanted)).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in key]
    told = grid.join(area.select(*[F.col(c).alias(f"_{c}") for c in key], "ap", "t"), same, "left")
    return told.select(*key, F.coalesce("ap", F.lit(0.0)).alias("ap"), (F.coalesce("t", F.lit(0)) / F.col("n_gt")).alias("recall"), "n_gt")


def summary(boxes: DataFrame) -> DataFrame:
    """dataset and the METRICS: means over labels and thresholds, to three places, -1 where nothing counts; and the row `Average`, their
    unweighted means over the data sets as they stand.
    """
    found = written(counted(boxes), "coco")
    uses = list(dict.fromkeys((a, m) for a, m, _, _ in METRICS.values()))
    told = curves(found, THRESHOLDS, uses)
    mean = lambda a, m, t, recall: F.avg(F.when((F.col("area") == a) & (F.col("most") == m) & (F.lit(t is None) | (F.col("threshold") == (t or 0.0))), F.col("recall" if recall else "ap")))
    rows = found.select("dataset").distinct().join(told.groupBy("dataset").agg(*[mean(*m).alias(name) for name, m in METRICS.items()]), "dataset", "left")
    each = rows.select("dataset", *[F.coalesce(F.rint(F.col(name) * 1000) / 1000, F.lit(-1.0)).alias(name) for name in METRICS])
    return each.unionByName(each.groupBy(F.lit("Average").alias("dataset")).agg(*[F.avg(name).alias(name) for name in METRICS]))


def predictions(results: DataFrame, relative: bool = False) -> DataFrame:
    """Rows for summary(), side `pred`, of generated answers (dataset, sample, answer, img_w, img_h, resized_w, resized_h, classes).

    An answer is a list of objects with bbox_2d and label, perhaps fenced as JSON. Boxes are scaled from the resized image, or from
    thousandths, to the image; every score is 1. A box that hasn't four coordinates goes, as does a label that is none of the
    classes whatever its case; an answer that is no such list, or has a box without a label, gives nothing.
    """
    text = strip(F.replace(F.replace("answer", F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    items = F.from_json(F.when(F.startswith(text, F.lit("[")), text), "array<struct<bbox_2d: array<double>, label: string>>")
    whole = lambda x: F.size(x["bbox_2d"]) == 4
    listed = results.withColumn("_items", items).where(~F.exists("_items", lambda x: whole(x) & x["label"].isNull()))
    known = F.transform("classes", lambda c: F.lower(c))
    rows = listed.select("*", known.alias("_known"), F.posexplode("_items").alias("idx", "_x")).where(whole(F.col("_x")) & F.array_contains("_known", F.lower("_x.label")))
    size = {"x": ("img_w", F.lit(1000) if relative else F.col("resized_w")), "y": ("img_h", F.lit(1000) if relative else F.col("resized_h"))}
    scaled = [(F.get("_x.bbox_2d", F.lit(i)) / size[c[0]][1] * F.col(size[c[0]][0])).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return rows.select("dataset", "sample", F.lit("pred").alias("side"), "idx", F.lower("_x.label").alias("label"), F.lit(1.0).alias("score"), *scaled)


def detection_map(boxes: DataFrame, thresholds: Sequence[float] = THRESHOLDS, most: int = MOST[0]) -> DataFrame:
    """label, threshold, ap, n_gt over boxes of any area, at most so many detections of a label in a sample."""
    every = {"all": AREAS["all"]}
    found = written(counted(boxes.drop("dataset"), thresholds, every, most), "map")
    return curves(found, thresholds, [("all", most)]).select("label", "threshold", "ap", "n_gt")
