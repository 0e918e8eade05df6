"""Semantic traps of the survey, each as a case."""

import math

import pytest
from pyspark.sql import functions as F

from sceneqa.functions import geometry as G
from sceneqa.functions import text as T
from sceneqa.operators import matching as M
from sceneqa.operators import sampling as S


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def lit_box(*v):
    return [F.lit(float(x)) for x in v]


def test_rounding_is_half_even(spark):
    r = one(spark, G.normalize_pixel(F.lit(4), 1600.0).alias("a"), G.normalize_pixel(F.lit(12), 1600.0).alias("b"), G.normalize_pixel(F.lit(-5), 1600.0).alias("c"), G.normalize_pixel(F.lit(9999), 1600.0).alias("d"))
    assert tuple(r) == (round(4 / 1600 * 1000), round(12 / 1600 * 1000), 0, 1000)


@pytest.mark.parametrize("a, b, want", [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0), ((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3)])
def test_iou(spark, a, b, want):
    assert one(spark, G.iou(lit_box(*a), lit_box(*b))).asDict().popitem()[1] == pytest.approx(want)


def test_touching_boxes_collide(spark):
    box = (F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    at = lambda x: (F.lit(x), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    r = one(spark, G.obb_overlap(box, at(2.0)).alias("touch"), G.obb_overlap(box, at(2.01)).alias("apart"))
    assert (r.touch, r.apart) == (True, False)


def test_quaternion_round_trip(spark):
    q = F.array(*[F.lit(x) for x in (0.5, 0.5, -0.5, 0.5)])
    got = one(spark, G.matrix_quat(G.quat_matrix(q)).alias("q")).q
    assert got == pytest.approx([0.5, 0.5, -0.5, 0.5]) or got == pytest.approx([-0.5, -0.5, 0.5, -0.5])
    w = one(spark, G.quat_multiply(q, G.quat_inverse(q)).alias("q")).q
    assert w == pytest.approx([1, 0, 0, 0])


def test_quaternion_is_not_normalised_unless_asked(spark):
    q = F.array(*[F.lit(x) for x in (2.0, 0.0, 0.0, 2.0)])
    r = one(spark, F.get(F.get(G.quat_matrix(q), 0), 0).alias("raw"), F.get(F.get(G.quat_matrix(q, normalize=True), 0), 0).alias("unit"))
    assert r.raw == pytest.approx(-7.0)
    assert r.unit == pytest.approx(0.0)


def test_euler_at_the_pole(spark):
    h = math.sqrt(0.5)
    q = F.array(*[F.lit(x) for x in (h, 0.0, h, 0.0)])
    assert one(spark, G.quat_euler(q).alias("e")).e[1] == pytest.approx(90.0, abs=1e-5)


def test_projection_guards_depth_zero(spark):
    eye = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(3)]) for i in range(3)])
    p = one(spark, G.project(F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0)), eye, F.array(*[F.lit(0.0)] * 3), eye).alias("p")).p
    assert p == [None, None, 0.0]


def test_risk_bands(spark):
    cases = {0.0: "CRITICAL", 1.99: "HIGH", 2.0: "MODERATE", 5.0: "LOW"}
    got = one(spark, *[G.risk_band(F.lit(k)).alias(str(i)) for i, k in enumerate(cases)], G.risk_band(F.lit(None).cast("double")).alias("none"))
    assert list(got) == [*cases.values(), "NONE"]


def test_first_occurrence_alone_is_replaced(spark):
    r = one(spark, T.replace_first(F.lit("a {x} b {x}"), "{x}", "1").alias("a"), T.replace_first(F.lit("none"), "{x}", "1").alias("b"))
    assert (r.a, r.b) == ("a 1 b {x}", "none")


@pytest.mark.parametrize("answer, want", [("A", "A"), ("The answer is B.", "B"), ("A car is on the left", None), ("A or B", None), ("I am sorry", None), ("Cannot determine the answer", "Z"), ("Failed to obtain answer via API. B", None), ("Z!", "Z"), ("(C)", "C")])
def test_option_inference(spark, answer, want):
    assert one(spark, T.infer_option(F.lit(answer), ["A", "B", "C", "D"]).alias("o")).o == want


@pytest.mark.parametrize("answer, want", [(" b, a. ", "A,B"), ("Yes.", "yes"), ("B and A", "A,B"), ("No way", "no way")])
def test_answer_normalisation(spark, answer, want):
    assert one(spark, T.normalize_answer(F.lit(answer)).alias("o")).o == want


@pytest.mark.parametrize("kind, answer, ok", [("y_or_n", "Yes, it is", True), ("y_or_n", "maybe", False), ("num_count", "three", True), ("num_count", "3 cars", False), ("distance", "5 m", True), ("open_ended", "x", False), ("mcq", "A", False), ("odd", "x", False), ("open_ended", "", False)])
def test_contracts(spark, kind, answer, ok):
    none = F.lit(None).cast("map<string,string>")
    assert (one(spark, T.contract_reason(F.lit(kind), F.lit(answer), none).alias("r")).r is None) == ok


def test_json_ladder(spark):
    cases = ['{"a": 1}', 'x <think>[1]</think> ```json\n{"a": 1}\n```', 'so: {"a": 1} done', "no json"]
    got = [one(spark, F.try_variant_get(T.tolerant_json(F.lit(c)), "$.a", "int").alias("a")).a for c in cases]
    assert got == [1, 1, 1, None]


def test_references_survive_a_round_trip(spark):
    ref = T.render_ref(F.lit("car"), [F.lit(i) for i in (1, 2, 30, 40)])
    flat = T.render_ref(F.lit("bus"), [F.lit(i) for i in (9, 2, 9, 40)])
    text = F.concat(ref, F.lit(' "image_idx": 2 '), ref, F.lit(" "), F.regexp_replace(ref, T.LABEL, ""), F.lit(' "image_idx": 3'), flat)
    whole = F.to_json(F.struct(F.array(*[F.struct(F.lit(v).alias("image_idx"), F.lit("x").alias("camera"), r.alias("ref")) for v, r in ((2, ref), (7, ref), (1, flat))]).alias("grounding")))
    r = one(spark, ref.alias("ref"), T.parse_refs(text).alias("a"), T.parse_refs(whole).alias("b"), T.parse_refs(F.lit("none")).alias("c"))
    assert r.ref == "<|object_ref_start|>car<|object_ref_end|><|box_start|>(1,2),(30,40)<|box_end|>"
    assert [tuple(x) for x in r.a] == [(2, "car", [1, 2, 30, 40], True), (2, "", [1, 2, 30, 40], True), (3, "bus", None, False)]
    assert [tuple(x) for x in r.b] == [(2, "car", [1, 2, 30, 40], True), (1, "bus", None, False)] and r.c == []


def test_cleansing(spark):
    r = one(spark, T.cleanse_references(F.lit("a  b ( )")).alias("a"), T.count_references(F.lit("a  b ()")).alias("n"), T.cleanse_references(F.lit("see obj 36 (pedestrian, 19.6m), , (OBJ 4, 5) OBJs 1, OBJ 2 go")).alias("b"))
    assert (r.a, r.n, r.b) == ("a b", 0, "see , go")
    df = spark.createDataFrame([("No object with an OBJ ID stays",), ("One. It is in the Spatial Data. Two!",), ("spatial datasets",), (None,)], "t string")
    got = [tuple(x) for x in T.cleansed(df, "t").collect()]
    assert got == [("", 0, 1, 0), ("One.Two!", 0, 1, 0), ("scenes", 0, 0, 1), (None, None, None, None)]


def test_sentences_go_as_a_plain_search_takes_them(spark):
    """The anchored pattern against the plain one, over texts with every kind of border."""
    import random
    import re

    rng = random.Random(5)
    parts = ["object list", "prior knowledge", "spatial data", "a b", "x", ".", "!", "?", "\n", " ", "  ", "\n\n", "Object lists"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(400)] + ["word " * 30_000 + "spatial data"]
    plain = re.compile(T.META.replace(T.BEGIN, "").replace("(?i)", "(?i)", 1))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(F.regexp_replace("t", T.META, "#"), F.regexp_count("t", F.lit(T.META))).collect()]
    assert got[:-1] == [plain.subn("#", t) for t in texts[:-1]] and got[-1] == ("#", 1)


def test_greedy_order_and_zero_overlap(spark):
    rows = [
        (1, "gt", 0, 1, "Car ", 0.0, 0.0, 10.0, 10.0),
        (1, "gt", 1, 1, "car", 0.0, 0.0, 10.0, 9.0),
        (1, "pred", 0, 1, "car", 0.0, 0.0, 10.0, 10.0),
        (1, "pred", 1, 1, "car", 50.0, 50.0, 60.0, 60.0),
        (1, "pred", 2, 2, "car", 0.0, 0.0, 10.0, 10.0),
        (2, "gt", 0, 1, "dog", 0.0, 0.0, 1.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "sample bigint, side string, idx int, view int, label string, x1 double, y1 double, x2 double, y2 double")
    got = {(r["sample"], r.gt, r.pred): r.iou for r in M.greedy_match(df).collect()}
    assert got == {(1, 0, 0): 1.0, (1, 1, 1): 0.0, (1, -1, 2): 0.0, (2, 0, -1): 0.0}


def test_capped_weights():
    w = S.capped_weights([8, 1, 1], 0.5)
    assert sum(w) == pytest.approx(1) and max(w) <= 0.5 + 1e-9
    assert S.capped_weights([1, 1], 0.2) == [0.5, 0.5]


def test_percent_sample_is_exact(spark):
    df = spark.range(1000)
    assert S.percent(df, "id", 7, "x").count() == 70
    assert S.percent(df.limit(3), "id", 7, "x").count() == 1
