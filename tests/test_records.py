"""Messages, discovery and records on fixtures made here."""

import json

import pytest
from pyspark.sql import functions as F

from sceneqa.functions import messages as G
from sceneqa.operators import records as R
from sceneqa.sources import discovery as D


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_grounding(spark):
    r = one(spark, G.has_grounding(F.lit('{"grounding": [{"image_idx": 1}]}')).alias("a"), G.has_grounding(F.lit('{"grounding": []}')).alias("b"), G.has_grounding(F.lit("no")).alias("c"))
    assert (r.a, r.b, r.c) == (True, False, False)
    e = lambda i, *b: F.struct(F.lit("x").alias("label"), F.lit(i).alias("image"), F.array(*[F.lit(v) for v in b]).alias("box"))
    got = one(spark, G.canonical_grounding(G.valid_grounding(F.array(e(2, 0, 0, 5, 5), e(1, 0, 0, 2, 2), e(1, 0, 0, 9, 9), e(7, 0, 0, 1, 1), e(1, 3, 3, 3, 9), e(2, 0, 0, 5, 5)))).alias("g")).g
    assert [(x.image, x.box) for x in got] == [(1, [0, 0, 9, 9]), (1, [0, 0, 2, 2]), (2, [0, 0, 5, 5])]


def test_boxes_and_descriptions(spark):
    text = "red car (Image 2 (Front) bbox[1,2,3,4]) and bbox[5, 6, 7, 8]"
    got = one(spark, G.parse_boxes(F.lit(text)).alias("b")).b
    assert [(x.label, x.image, x.box) for x in got] == [("red car", 2, [1, 2, 3, 4]), (None, None, [5, 6, 7, 8])]
    box = F.array(*[F.lit(v) for v in (100, 2, 300, 4)])
    r = one(spark, G.description(F.lit("car"), F.lit(5), F.lit("Back"), box, F.lit(True)).alias("a"), G.description(F.lit("car"), F.lit(5), F.lit("Back"), F.lit(None).cast("array<int>"), F.lit(True)).alias("b"))
    assert (r.a, r.b) == ("car (Image 5 (Back) bbox[1300,2,1500,4])", "car")


@pytest.mark.parametrize("a, b, want", [("1.0", "1", True), ("x", "x", True), ("x", "y", False), ("1", "1.1", False), (None, "1", False), ("2**3", "8", True), (r"\frac{1}{2}", "0.5", True), (r"\sqrt{16}", "2^2", True), ("X", "x", True), ("__import__('os')", "1", False), ("9**9**9", "1", False)])
def test_math_equality_evaluates_arithmetic_alone(spark, a, b, want):
    assert one(spark, G.math_equal(F.lit(a).cast("string"), F.lit(b)).alias("r")).r is want


def test_text_blocks(spark):
    r = one(spark, G.sections(F.lit("intro\n1. Risk\nhigh\nmore\n2. Plan\nstop")).alias("s"), G.tagged_blocks(F.lit("[A]\none\n---\n[B C] two")).alias("t"), G.swap_words(F.lit("Back Left, Back Right"), "Back Left", "Back Right").alias("w"))
    assert [(x.header, x.body) for x in r.s] == [("Risk", "high\nmore"), ("Plan", "stop")]
    assert [(x.tag, x.body.strip()) for x in r.t] == [("A", "one"), ("B C", "two")]
    assert r.w == "Back Right, Back Left"


def test_messages(spark):
    r = one(spark, G.chat(F.lit("s"), G.user_prompt(F.lit("v=1"), F.lit("q?"), F.lit("A. x")), F.lit("Yes."), F.lit("as seen")).alias("c"))
    assert [t["from"] for t in r.c] == ["system", "human", "gpt"] and r.c[2].value == "Yes. as seen" and r.c[1].value.endswith("TASK:\nq?\n\nOptions:\nA. x")
    parts = one(spark, G.interleave(F.lit("a<image>b<image>"), F.array(F.lit("1"), F.lit("2"))).alias("p")).p
    assert [(p.type, p.value) for p in parts] == [("text", "a"), ("image", "1"), ("text", "b"), ("image", "2")]
    with pytest.raises(Exception, match="differ"):
        one(spark, G.interleave(F.lit("a<image>"), F.array().cast("array<string>")).alias("p"))
    pc = spark.createDataFrame([([("system", "s"), ("human", "h"), ("gpt", "g")],), ([("human", "h")],)], "c array<struct<who string, value string>>").select(G.prompt_completion(F.col("c")).alias("p")).collect()
    assert len(pc[0].p.prompt) == 2 and pc[0].p.completion[0].value == "g" and pc[1].p is None


def test_normalized_result(spark):
    good, inner = '{"pairs": [1]}', '{"qa_results": [{"x": 1}, {"template_idx": 4}]}'
    rows = [one(spark, G.normalized_result(F.parse_json(F.lit(t))).cast("string").alias("r")).r for t in (good, inner, "{}")]
    assert rows == ['{"pairs":[1]}', '{"template_idx":4}', None]


def test_frames(spark):
    r = one(spark, G.frame_range(F.lit(0.5), F.lit(2.0), F.lit(10.0), F.lit(15)).alias("a"), G.frame_range(F.lit(3.0), F.lit(1.0), F.lit(10.0), F.lit(50)).alias("b"), G.frame_indices(F.lit(4), F.lit(10)).alias("c"))
    assert (r.a, r.b, r.c) == ([5, 14], None, [0, 3, 6, 9])


def test_discovery(spark, tmp_path):
    (tmp_path / "all").mkdir()
    for name in ("0001_x.json", "0002_y.json", "0002_z.json", "train_OBS.json", "subset_DRA.json"):
        (tmp_path / "all" / name).write_text("{}")
    assert sorted(r.sample_idx for r in D.sample_indices(spark, str(tmp_path)).collect()) == [1, 2]
    assert [r.category for r in D.categories(spark, str(tmp_path / "all")).collect()] == ["OBS"]
    assert {r.token for r in D.detections(spark, str(tmp_path / "all")).collect()} == {"x", "y", "z"}
    stage = tmp_path / "stage_02_TSS"
    stage.mkdir()
    (stage / "eval_report.json").write_text('{"a": 1}')
    assert [(r.number, r.stage) for r in D.stage_reports(spark, str(tmp_path)).collect()] == [(2, "TSS")]


def test_labels_and_workers(spark, tmp_path):
    (tmp_path / "scene_1.json").write_text(json.dumps({"sample_labels": {"t": {"3": 1}}}))
    (tmp_path / "scene_2.json").write_text(json.dumps({"sample_labels": {"t": {"4": 2}}}))
    assert [(r.token, r.idx, r.label) for r in D.scene_labels(spark, str(tmp_path)).collect()] == [("t", 4, 2)]
    for k in (0, 1):
        (tmp_path / f"predictions_worker{k}.json").write_text(json.dumps({"frames": [{"frame_pos": 1, "v": k}, {"frame_pos": 10 + k, "v": k}]}))
    assert {r.frame_pos: r.v for r in D.worker_reports(spark, str(tmp_path), "v int").collect()} == {1: 1, 10: 0, 11: 1}


def test_question_bank(spark):
    t = lambda x: (x, {"a": ["b"]}, "mcq")
    bank = spark.createDataFrame([("X", None, [t("one")]), ("Y", [([t("two"), t("three")],), ([t("four")],)], None)], f"category string, sub_categories array<struct<templates:array<{D.TEMPLATE}>>>, templates array<{D.TEMPLATE}>")
    got = sorted((r.category, r.template_idx, r.template) for r in D.question_bank(bank).collect())
    assert got == [("X", 1, "one"), ("Y", 1, "two"), ("Y", 2, "three"), ("Y", 3, "four")]


def test_lookups(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "i bigint, scene_token string")
    assert R.point_lookup(df, "i", 2).first().scene_token == "abc"
    with pytest.raises(Exception, match="no row"):
        R.point_lookup(df, "i", 9).collect()
    assert R.scene_filter(df, "abc").count() == 1
    with pytest.raises(ValueError):
        R.scene_filter(df, "")
    samples = spark.createDataFrame([("q1", None), ("q2", "OWN"), ("q3", None)], "question string, category string")
    lookup = spark.createDataFrame([("q1", "A", 1), ("q1", "B", 2), ("q2", "C", 1)], "question string, category string, ord int")
    assert {r.question: r.category for r in R.resolve_category(samples, lookup).collect()} == {"q1": "B", "q2": "OWN", "q3": None}
    signals = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    status = spark.createDataFrame([(1, 1, True, "red", 0.5), (1, 2, True, "green", 0.9), (2, 1, False, None, None)], "k int, ord int, parse_ok boolean, colour string, confidence double")
    got = {r.k: (r.outcome, r.colour, r.confidence) for r in R.status_join(signals, status, ["k"]).collect()}
    assert got == {1: ("labelled", "green", 0.9), 2: ("unparsed", "unknown", -1.0), 3: ("missing", "unknown", -1.0)}


def test_draws(spark):
    buckets = spark.createDataFrame([(1, "a", 10), (1, "b", 5), (2, "c", 3)], "view bigint, category string, n bigint")
    drawn = R.three_stage_draw(buckets, {1: 3.0, 2: 1.0}, 8000, 5).groupBy("view", "category").count().collect()
    share = {(r.view, r.category): r["count"] / 8000 for r in drawn}
    assert share == {k: pytest.approx(v, abs=0.03) for k, v in {(1, "a"): 0.375, (1, "b"): 0.375, (2, "c"): 0.25}.items()}
    pools = {r.pool: r["count"] / 8000 for r in R.composite_pool(spark.range(8000), "id", 0.3, 0.2, 1).groupBy("pool").count().collect()}
    assert pools == {k: pytest.approx(v, abs=0.03) for k, v in R.expected_pools(0.3, 0.2).items()}


def test_flattening(spark):
    d = spark.createDataFrame([(1, [[0, 0, 4, 6]], [0.5], [7])], "image_id int, boxes array<array<int>>, scores array<double>, labels array<int>")
    assert [(r.bbox, r.score, r.category_id) for r in R.coco_rows(d).collect()] == [([0, 0, 4, 6], 0.5, 7)]
    reports = spark.createDataFrame([("e", 1, '{"a": {"b": 2.5}}')], "experiment string, seed int, summary string")
    r = R.run_rows(reports, {"x": "$.a.b", "y": "$.c"}).first()
    assert (r.x, r.y) == (2.5, None)
    levels = spark.createDataFrame([(1, "LOW"), (1, "LOW")], "k int, l string")
    assert {r.l: r.n for r in R.level_histogram(levels, "k", "l", ["LOW", "HIGH"]).collect()} == {"LOW": 2, "HIGH": 0}
    cats = spark.createDataFrame([("Z",), ("B",), ("A",)], "c string")
    assert [r.c for r in R.curriculum_order(cats, "c", ["B"]).collect()] == ["B", "A", "Z"]
