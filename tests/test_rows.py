"""Lookups, writers, geometry and text of single rows, each against values worked out here."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sceneqa.functions import geometry as G
from sceneqa.functions import messages as M
from sceneqa.functions import text as T
from sceneqa.functions import text_udf as U
from sceneqa.operators import records as R
from sceneqa.operators import windows as W
from sceneqa.plans import evaluate, scenes
from sceneqa.sources import sinks, tables


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lits(*values):
    return [F.lit(float(v)) for v in values]


def quaternion(yaw):
    return F.array(*lits(math.cos(yaw / 2), 0, 0, math.sin(yaw / 2)))


# scans and sinks


def test_benchmark_tsv(spark, tmp_path):
    image = "x" * 80
    (tmp_path / "b.tsv").write_text(f'index\timage\tquestion\n1\t{image}\t"two ""quoted""\nlines"\n2\t1\tshort\n3\t9\tnone\n')
    got = {r["index"]: (r.image, r.question) for r in tables.benchmark_tsv(spark, str(tmp_path / "b.tsv")).collect()}
    assert got == {"1": (image, 'two "quoted"\nlines'), "2": (image, "short"), "3": ("9", "none")}


def test_inference_jsonl(spark, tmp_path):
    rows = [{"question_id": "a", "annotation": {"answer": "A", "split": "dev"}, "result": {"gen": "B"}}, {"question_id": "b", "annotation": {"answer": "C"}, "result": None}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = [tuple(r) for r in tables.inference_jsonl(spark, str(tmp_path / "r.jsonl"), "answer:string,split:string").orderBy("question_id").collect()]
    assert got == [("a", "A", "dev", "B"), ("b", "C", None, None)]


def test_publication_happens_once(spark, tmp_path):
    path = f"{tmp_path}/out"
    sinks.publish_once(spark.range(3), path)
    sinks.publish_once(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    double = lambda df: df.withColumn("id", F.col("id") * 2)
    once = sinks.scaled_once(spark.range(1, 3), 2, double)
    assert sorted(map(tuple, once.collect())) == [(2, 2), (4, 2)]
    with pytest.raises(Exception, match="scaled already"):
        sinks.scaled_once(once, 2, double).collect()


# lookups


def test_enriching_pinning_and_picking(spark):
    rows = spark.createDataFrame([(1, "A", 1, "t1"), (2, "A", 9, "t9"), (3, "B", 1, "t1")], "id int, category string, template_idx int, template string")
    bank = spark.createDataFrame([("A", 1, "q?")], "category string, template_idx int, question string")
    assert {r.id: r.question for r in R.enrich(rows, bank).collect()} == {1: "q?", 2: None, 3: None}
    found, lost = R.pin(rows, spark.createDataFrame([("A", "t1", 7, "mcq")], "category string, template string, pinned int, kind string"))
    assert [(r.id, r.pinned, r.kind) for r in found.collect()] == [(1, 7, "mcq")] and {r.id for r in lost.collect()} == {2, 3}
    picks = R.first_per_category(spark.createDataFrame([("A", 3, True), ("A", 1, False), ("A", 2, True), ("B", 5, True), ("C", 1, False)], "c string, o int, ok boolean"), "c", "o", 1, F.col("ok"))
    assert {(r.c, r.o) for r in picks.collect()} == {("A", 2), ("B", 5)}


def test_lookup_by_base_name_and_by_box(spark):
    rows = spark.createDataFrame([("a/x.jpg",), ("y.jpg",), ("a/none.jpg",)], "image string")
    index = spark.createDataFrame([("root/b/x.jpg", 1), ("x.jpg", 4), ("c/y.jpg", 2)], "path string, sample_idx int")
    assert {r.image: r.sample_idx for r in R.by_basename(rows, "image", index, "path").collect()} == {"a/x.jpg": 4, "y.jpg": 2, "a/none.jpg": None}
    boxes = spark.createDataFrame([(2, 1, 2, 3, 4, 0, 0.0), (2, 1, 2, 3, 4, 5, 7.5), (3, 1, 2, 3, 4, 1, 1.0)], "view int, x1 int, y1 int, x2 int, y2 int, ord int, speed double")
    last = W.last_write(boxes, ["view", "x1", "y1", "x2", "y2"], [F.col("ord")])
    assert {r.view: r.speed for r in last.collect()} == {2: 7.5, 3: 1.0}


def test_samples_have_six_cameras_and_their_inverse(spark):
    kind = "sample_idx bigint, cameras map<string, struct<rotation:array<double>, translation:array<double>>>"
    turned = ([math.cos(math.pi / 4), 0.0, 0.0, math.sin(math.pi / 4)], [1.0, 2.0, 3.0])
    whole = spark.createDataFrame([(1, dict.fromkeys(R.CAMERAS, turned))], kind)
    cam = R.camera_records(whole).first().cameras["CAM_BACK"]
    assert [x for row in cam.ego2sensor_rotation for x in row] == pytest.approx([0, 1, 0, -1, 0, 0, 0, 0, 1], abs=1e-9)
    assert cam.ego2sensor_translation == pytest.approx([-2, 1, -3])
    with pytest.raises(Exception, match="CAM_BACK_RIGHT not found in sample 1"):
        R.camera_records(spark.createDataFrame([(1, dict.fromkeys(R.CAMERAS[:5], turned))], kind)).collect()


def test_exposure(spark):
    draws = spark.createDataFrame([("p", "a")] * 3 + [("p", "b")] + [("q", "a")] * 4, "pool string, category string")
    got = {(r.pool, r.category): (r.n, r.share_of_pool, r.share_of_total) for r in evaluate.exposure(draws).collect()}
    assert got == {("p", "a"): (3, 0.75, 0.375), ("p", "b"): (1, 0.25, 0.125), ("q", "a"): (4, 1.0, 0.5)}


# text


def test_token_roles_over_rows(spark):
    df = spark.createDataFrame([([1, 7, 5, 6, 8, 3, 4, 9, 2, 1],), ([],), (None,)], "ids array<int>")
    got = [r.r for r in df.select(U.token_roles(7, 8, [3, 4], 2)("ids").alias("r")).collect()]
    assert got == [[0, 0, 1, 1, 0, 0, 0, 2, 0, 0], [], None]


def test_replies_as_json(spark):
    ref = F.array(F.lit("r1"))
    r = one(spark, M.reply_json(F.lit('say "so"'), ref, F.lit("Yes")), M.reply_json(F.lit("x"), F.lit(None).cast("array<string>"), F.lit("No")))
    assert json.loads(r.c0) == {"reasoning": 'say "so"', "grounding": ["r1"], "answer": "Yes"}
    assert json.loads(r.c1) == {"reasoning": "x", "grounding": [], "answer": "No"}
    r = one(spark, T.extract_answer(F.lit(r.c0)), T.extract_answer(F.lit('broken {"answer": "B", ')), T.extract_answer(F.lit("none")))
    assert (r.c0, r.c1, r.c2) == ("Yes", "B", None)


def test_questions_and_options(spark):
    r = one(spark, T.task_question(F.lit("v=1\n\nTASK:\nIs it?\nNow?\n\nOptions:\nA. x")), T.task_question(F.lit("TASK:\nAlone")), T.task_question(F.lit("none")))
    assert (r.c0, r.c1, r.c2) == ("Is it?\nNow?", "Alone", "")
    none = F.lit(None).cast("map<string,string>")
    options, answer = M.mcq_rewrite(none, F.lit("42"))
    kept, letter = M.mcq_rewrite(F.create_map(F.lit("A"), F.lit("x")), F.lit("A"))
    r = one(spark, options, answer, kept, letter)
    assert (r.c0, r.c1, r.c2, r.c3) == ({"A": "42", "B": "Other Answers"}, "A", {"A": "x"}, "A")


def test_object_lines(spark):
    args = [F.lit(3), F.lit("car"), *lits(1.25, -2, 2.36)]
    r = one(spark, M.object_line(*args, F.lit(1.5)), M.object_line(*args, F.lit(None).cast("double")))
    assert r.c0.startswith("OBJ 3: car at (1.") and r.c0.endswith(", 2.4 m, contact in 1.5 s") and r.c1.endswith("-2.0), 2.4 m")


# geometry


def test_rigid_transforms(spark):
    """A turn to the left and a step: forth and back, one after another, boxes and velocities."""
    q, t, v = quaternion(math.pi / 2), F.array(*lits(1, 2, 3)), lits(10, 0, 0)
    there = F.array(*G.rigid_apply(q, t, v))
    m, back = G.rigid_inverse(q, t)
    home = F.array(*[a + F.get(back, i) for i, a in enumerate(G.rotate(m, [F.get(there, i) for i in range(3)]))])
    twice = F.array(*G.rigid_apply(q, t, [F.get(there, i) for i in range(3)]))
    both = F.array(*G.rigid_apply(G.quat_multiply(q, q), F.array(*G.rigid_apply(q, t, [F.get(t, i) for i in range(3)])), v))
    r = one(spark, there, home, twice, both, F.array(*G.rotate(G.quat_matrix(q), v)), F.array(*G.rotate_back(G.quat_matrix(q), v)))
    assert r.c0 == pytest.approx([1, 12, 3]) and r.c1 == pytest.approx([10, 0, 0]) and r.c2 == pytest.approx(r.c3)
    assert r.c4 == pytest.approx([0, 10, 0], abs=1e-9) and r.c5 == pytest.approx([0, -10, 0], abs=1e-9)


def test_boxes_in_another_frame(spark):
    corners = G.box_corners(*lits(10, 0, 0, 4, 2, 2, math.pi / 2))
    r = one(spark, corners, G.wrap_angle(F.lit(3 * math.pi / 2)))
    assert len(r.c0) == 8 and r.c0[0] == pytest.approx([9, 2, 1]) and r.c0[7] == pytest.approx([11, -2, -1]) and r.c1 == pytest.approx(-math.pi / 2)


def test_headings(spark):
    look = F.array(*lits(0.5, -0.5, 0.5, -0.5))  # a camera's axis (z) along the frame's x
    assert one(spark, G.camera_heading(look)).c0 == pytest.approx(0.0, abs=1e-6)
    assert one(spark, G.camera_heading(G.quat_multiply(quaternion(math.pi / 2), look))).c0 == pytest.approx(90.0)
    steps = [("c", k * 100_000, 3.0 * k, 3.0 * k) for k in range(6)] + [("slow", k * 1_000_000, float(k), 0.0) for k in range(4)]
    got = {r.clip: (round(r.heading, 6), r.steps) for r in scenes.road_heading(spark.createDataFrame(steps, "clip string, ts_us bigint, x double, y double")).collect()}
    assert got == {"c": (45.0, 4)}


def test_lifting_to_depth_and_ground(spark):
    r = one(spark, G.pinhole_depth(F.lit(1000.0), 0.8, F.lit(40.0), F.lit(3.0)), G.pinhole_depth(F.lit(1000.0), 0.8, F.lit(0.0), F.lit(3.0)), G.pinhole_depth(F.lit(1000.0), 0.8, F.lit(1.0), F.lit(3.0)))
    assert r.c0 == pytest.approx(20.0) and r.c1 == 3.0 and r.c2 is None
    r = one(spark, G.ground_hit(lits(0, 0, 2), lits(1, 0.5, -0.1)), G.ground_hit(lits(0, 0, 2), lits(1, 0, 0.1)), G.ground_hit(lits(0, 0, 2), lits(1, 0, -0.001)))
    assert r.c0 == pytest.approx([20, 10, 0]) and r.c1 is None and r.c2 is None


def test_coordinate_spaces(spark):
    r = one(spark, *[G.coordinate_scale(F.lit(x)) for x in (0.9, 1.5, 2.0)], *[G.coordinate_width(F.lit(x)) for x in (1200, 600, 300, 0)])
    assert list(r) == [1, 1, 1000, 1600, 800, 400, None]
    h = F.array(*[F.array(*lits(*row)) for row in ((2, 0, 1), (0, 2, 1), (0, 0, 2))])
    flat = F.array(*[F.array(*lits(*row)) for row in ((1, 0, 0), (0, 1, 0), (0, 0, 0))])
    r = one(spark, G.homography(h, *lits(3, 5)), G.homography(flat, *lits(3, 5)))
    assert r.c0 == [3.5, 5.5] and r.c1 == [None, None]
