"""Detection evaluation against the plain definition, box by box."""

import random

import numpy as np
import pytest

from sceneqa.operators import coco
from sceneqa.operators import matching as M

SCHEMA = "dataset string, sample bigint, side string, idx int, label string, score double, x1 double, y1 double, x2 double, y2 double, crowd boolean, extra int"


def plain_iou(d, g, crowd):
    if None in d or None in g:
        return 0.0
    w, h = min(d[2], g[2]) - max(d[0], g[0]), min(d[3], g[3]) - max(d[1], g[1])
    common = max(w, 0.0) * max(h, 0.0)
    a, b = ((max(x[2] - x[0], 0.0)) * max(x[3] - x[1], 0.0) for x in (d, g))
    union = a if crowd else a + b - common
    return common / union if union > 0 else 0.0


def area(b):
    return 0.0 if None in b else max(b[2] - b[0], 0.0) * max(b[3] - b[1], 0.0)


def plain_curve(rows, area_range, most, threshold):
    """ap, recall, n_gt of one data set and label."""
    lo, hi = area_range
    kept, n_gt = [], 0
    for sample in sorted({r[1] for r in rows}):
        gts = [(r[6:10], bool(r[10]), bool(r[10]) or not lo <= area(r[6:10]) <= hi) for r in sorted((r for r in rows if r[1] == sample and r[2] == "gt"), key=lambda r: r[3])]
        gts = [g for g in gts if not g[2]] + [g for g in gts if g[2]]
        n_gt += sum(not g[2] for g in gts)
        dets = sorted((r for r in rows if r[1] == sample and r[2] == "pred" and r[5] is not None), key=lambda r: (-r[5], r[3]))[:most]
        used = set()
        for r in dets:
            best, at = min(threshold, 1 - 1e-10), -1
            for i, (box, crowd, skip) in enumerate(gts):
                if i in used and not crowd:
                    continue
                if at >= 0 and not gts[at][2] and skip:
                    break
                v = plain_iou(r[6:10], box, crowd)
                if v >= best:
                    best, at = v, i
            used.add(at)
            kept.append((r[5], at >= 0, gts[at][2] if at >= 0 else not lo <= area(r[6:10]) <= hi))
    if not n_gt:
        return None
    order = sorted(range(len(kept)), key=lambda i: -kept[i][0])  # stable: samples in order, then ranks
    tp = np.cumsum([kept[i][1] and not kept[i][2] for i in order])
    fp = np.cumsum([not kept[i][1] and not kept[i][2] for i in order])
    recall, precision = tp / n_gt, tp / np.maximum(fp + tp, 1e-300)
    for i in range(len(precision) - 1, 0, -1):
        precision[i - 1] = max(precision[i - 1], precision[i])
    at = np.searchsorted(recall, np.linspace(0, 1, 101), side="left") if len(recall) else np.full(101, 1)
    return sum(precision[i] if i < len(precision) else 0 for i in at) / 101, recall[-1] if len(recall) else 0.0, n_gt


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(11)
    rows = []
    for sample in range(60):
        for side, most in (("gt", 6), ("pred", 14)):
            for idx in range(rng.randrange(most)):
                x, y, s = rng.randrange(40), rng.randrange(30), rng.choice([10, 30, 60, 150])
                box = [float(x), float(y), float(x + s + rng.randrange(9)), float(y + s)]
                if rng.random() < 0.04:
                    box[rng.randrange(4)] = None
                score = rng.choice([None, 0.5, 0.5, 0.9, 1.0]) if side == "pred" else None
                rows.append((f"set{sample % 3}", sample, side, idx, rng.choice(["a", "b", None]), score, *box, side == "gt" and rng.random() < 0.1, 1))
    rows += [("only predictions", 99, "pred", 0, "a", 0.5, 0.0, 0.0, 9.0, 9.0, False, 1)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("parts", ["3", "40"])
def test_curves(spark, boxes, parts):
    rows, df = boxes
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        uses = [("all", 2), ("all", 1000), ("small", 5), ("medium", 1000), ("large", 1000)]
        got = {(r.dataset, r.label, r.area, r.most, r.threshold): (r.ap, r.recall, r.n_gt) for r in coco.curves(coco.counted(df).persist(), coco.THRESHOLDS, uses).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for ds, label in {(r[0], r[4]) for r in rows}:
        own = [r for r in rows if r[0] == ds and r[4] == label]
        for a, most in uses:
            for t in coco.THRESHOLDS:
                if (v := plain_curve(own, coco.AREAS[a], most, t)) is not None:
                    want[ds, label, a, most, t] = v
    assert got.keys() == want.keys() and len(want) > 300
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k


def test_summary_and_its_means(boxes):
    rows, df = boxes
    got = {r.dataset: r.asDict() for r in coco.summary(df).collect()}
    for ds in {r[0] for r in rows}:
        for name, (a, most, t, recall) in coco.METRICS.items():
            curves = [plain_curve([r for r in rows if r[0] == ds and r[4] == label], coco.AREAS[a], most, x) for label in ("a", "b", None) for x in ([t] if t else coco.THRESHOLDS)]
            values = [c[1 if recall else 0] for c in curves if c]
            assert got[ds][name] == pytest.approx(round(float(np.mean(values)), 3) if values else -1, abs=1.01e-3)
    assert got["only predictions"]["mAP"] == -1
    for name in coco.METRICS:
        assert got["Average"][name] == pytest.approx(np.mean([v[name] for k, v in got.items() if k != "Average"]))


def test_many_detections_of_one_sample(spark):
    """Of detections above the number allowed none counts; a recall of exactly 0.57 reaches the double 57 * 0.01 or not, as the scale says."""
    gt = [("d", 1, "gt", i, "a", None, float(20 * i), 0.0, 20.0 * i + 10, 10.0, None, 1) for i in range(100)]
    pred = [("d", 1, "pred", i, "a", 1.0, float(20 * i), 0.0, 20.0 * i + 10, 10.0, None, 1) for i in range(57)] + [("d", 1, "pred", 57 + i, "a", 0.5, 5e4, 0.0, 5e4 + 10, 10.0, None, 1) for i in range(1000)]
    df = spark.createDataFrame(gt + pred, SCHEMA)
    got = {r.most: (r.ap, r.recall) for r in coco.curves(coco.counted(df, (0.5,)).persist(), (0.5,), [("all", 50), ("all", 100)]).collect()}
    assert got == {50: (pytest.approx(51 / 101), 0.5), 100: (pytest.approx(plain_curve(gt + pred, (0, 1e10), 100, 0.5)[0]), 0.57)}


def test_predictions_of_answers(spark):
    answers = [
        '```json\n[{"bbox_2d": [0, 0, 50, 100], "label": "Cat"}, {"bbox_2d": [1, 2, 3], "label": "cat"}, {"bbox_2d": [10, 10, 20, 20], "label": "cow"}, {"bbox_2d": [50, 50, 100, 100], "label": "dog"}]\n```',
        "[{'bbox_2d': [0, 0, 100, 100], 'label': 'DOG'}]",
        '[{"bbox_2d": [0, 0, 100, 100]}, {"bbox_2d": [0, 0, 9, 9], "label": "dog"}]',
        "nothing here", None, "[]", '{"bbox_2d": [0, 0, 100, 100], "label": "dog"}',
    ]
    df = spark.createDataFrame([("d", i, a, 200, 400, 100, 100, ["cat", "Dog"]) for i, a in enumerate(answers)], "dataset string, sample bigint, answer string, img_w int, img_h int, resized_w int, resized_h int, classes array<string>")
    got = sorted((r["sample"], r.idx, r.label, r.score, r.x1, r.y1, r.x2, r.y2) for r in coco.predictions(df).collect())
    assert got == [(0, 0, "cat", 1.0, 0.0, 0.0, 100.0, 400.0), (0, 3, "dog", 1.0, 100.0, 200.0, 200.0, 400.0), (1, 0, "dog", 1.0, 0.0, 0.0, 200.0, 400.0)]
    assert sorted(r.x2 for r in coco.predictions(df, relative=True).collect()) == [10.0, 20.0, 20.0]


def test_map_and_matches_of_null_rows(spark, boxes):
    rows, df = boxes
    got = {(r.label, r.threshold): (r.ap, r.n_gt) for r in coco.detection_map(df, (0.5,), 100).collect()}
    assert got.keys() == {("a", 0.5), ("b", 0.5), (None, 0.5)}
    assert coco.detection_map(df.limit(0), (0.5,)).collect() == []
    odd = [(1, "gt", 0, 1, "car", None, 0.0, 1.0, 1.0), (1, "pred", 0, 1, "car", 0.0, None, 1.0, 1.0), (2, "gt", 0, 1, None, 0.0, 0.0, 1.0, 1.0)]
    match = M.greedy_match(spark.createDataFrame(odd, "sample bigint, side string, idx int, view int, label string, x1 double, y1 double, x2 double, y2 double"))
    assert {(r["sample"], r.gt, r.pred): r.iou for r in match.collect()} == {(1, 0, 0): 0.0, (2, 0, -1): 0.0}
