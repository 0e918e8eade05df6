"""Plans and callback edits on fixtures made here."""

import math

import pytest
from pyspark.sql import functions as F

from sceneqa.functions import geometry as G
from sceneqa.functions import text_udf as U
from sceneqa.operators import joins, qa, windows
from sceneqa.operators import matching as M
from sceneqa.plans import evaluate, priors, scenes
from sceneqa.plans.label import complete, equal_by_judge, judged


def test_references_expand_by_map():
    names = {"3": "car A", "8": "bus B"}
    assert U.expand_text("see OBJ 3 (car) now", names) == "see car A now"
    assert U.expand_text("OBJ 99 stays", names) == "OBJ 99 stays"
    assert U.expand_text("OBJs 3, 8, 99 here", names) == "car A, bus B here"
    assert U.expand_text("OBJs 98, 99", names) == "OBJs 98, 99"
    assert U.expand_text("two  blanks", {}) == "two  blanks" and U.expand_text(None, names) is None


def test_boxes_rescale_and_motion_is_corrected():
    assert U.rescale_text("a bbox[1,2,3,4] b bbox[5,6,7,8]", 2) == ("a bbox[2,4,6,8] b bbox[10,12,14,16]", 2)
    text = "The car (Image 2 (Front) bbox[1,2,3,4]) is Moving and in motion, not at rest"
    seen = "The car (Image 2 (Front) bbox[1,2,3,4])"
    assert U.correct_text(text, {"2,1,2,3,4": 0.0}) == (f"{seen} is stationary and stationary, not at rest", 2)
    assert U.correct_text(text, {"2,1,2,3,4": 3.0}) == (f"{seen} is Moving and in motion, not in motion", 1)
    assert U.correct_text(text, {"1,1,2,3,4": 3.0}) == (text, 0)
    assert U.correct_text(text + " " * 200 + "in motion", {"2,1,2,3,4": 0.0})[0].endswith("in motion")


@pytest.mark.parametrize("response, want", [
    ('{"a": 1}', '{"a": 1}'), ("<think>[1]</think>```json\n[2]\n```", "[2]"), ('then {"a": "}"} end', '{"a": "}"}'), ("{oops} [1, 2]", "[1, 2]"), ("nothing", None), (None, None), ("<think>{}</think>", None),
])
def test_response_ladder(response, want):
    assert U.ladder(response) == want


def test_parse_response_is_native_where_it_can_be(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('x {"a": 2} y',), ("z",)], "r string")
    got = df.select(F.try_variant_get(U.parse_response(F.col("r")), "$.a", "int").alias("a")).collect()
    assert [r.a for r in got] == [1, 2, None]


def test_token_roles():
    assert U.role_masks([1, 7, 5, 6, 8, 3, 4, 9, 2, 1], 7, 8, [3, 4], 2) == [0, 0, 1, 1, 0, 0, 0, 2, 0, 0]


def test_contact_of_turned_boxes(spark):
    def ttc(other, v, a=(0.0, 0.0)):
        lit = lambda xs: [F.lit(float(x)) for x in xs]
        return spark.range(1).select(G.ttc_obb(lit((0, 0, 0, 2, 1)), lit(other), lit(v), lit(a)).alias("t")).first().t

    assert ttc((3, 0, 0, 1, 1), (0, 0)) == 0.0
    assert ttc((13, 0, 0, 1, 1), (-5, 0)) == pytest.approx(2.0, abs=1e-3)
    assert ttc((13, 0, 0, 1, 1), (0, 0), (-5, 0)) == pytest.approx(2.0, abs=1e-3)
    assert ttc((13, 0, math.pi / 2, 1, 3), (-5, 0)) == pytest.approx(1.6, abs=1e-3)
    assert ttc((13, 9, 0, 1, 1), (-5, 0)) is None and ttc((13, 0, 0, 1, 1), (0.05, 0)) is None and ttc((13, 0, 0, 1, 1), (5, 0)) is None


def test_traps_and_skips(spark):
    r = spark.range(1).select(
        qa.trap_markers(F.lit("the SAME answer</think>no valid contrastive")).alias("a"), qa.trap_markers(F.lit("same answer")).alias("b"),
        qa.has_skip(F.parse_json(F.lit('{"contrastive": null}'))).alias("c"), qa.has_skip(F.parse_json(F.lit("{}"))).alias("d"), qa.has_skip(F.parse_json(F.lit('{"contrastive_skip_reason": "x"}'))).alias("e"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (["same answer"], [], True, False, True)


def test_result_contract(spark):
    rows = [(1, "mcq", "A", {"A": "x"}, True), (1, "y_or_n", "yes", None, True), (2, "mcq", "Q", {"A": "x"}, True), (3, "mcq", None, None, False)]
    df = spark.createDataFrame(rows, "k int, answer_type string, answer string, options map<string,string>, has_block boolean")
    assert {r.k: r.accepted for r in qa.result_contract(df, "k").collect()} == {1: True, 2: False, 3: False}


def test_scene(spark):
    unit = [1.0, 0.0, 0.0, 0.0]
    left = [math.sqrt(0.5), 0.0, 0.0, math.sqrt(0.5)]  # the vehicle looks along y
    obj = [("car", [10.0, 0.0, 0.0, 4.0, 2.0, 1.5, 0.0], [float("nan"), 0.0]), ("adult", [-30.0, 1.0, 0.0, 1.0, 1.0, 1.8, 0.0], [0.0, 0.0]), ("car", [400.0, 0.0, 0.0, 4.0, 2.0, 1.5, 0.0], [0.0, 0.0])]
    frames = spark.createDataFrame([(0, "s", 0, [0.0, 0.0, 0.0], left, None, 2, obj), (1, "s", 1_000_000, [0.0, 5.0, 0.0], left, 9, 1, []), (2, "s", 2_000_000, [0.0, 12.0, 0.0], left, 6, 1, []), (3, "t", 0, [0.0, 0.0, 0.0], unit, 0, 1, [])], scenes.FRAMES)
    ego = {r.sample_idx: r for r in scenes.ego_states(frames).collect()}
    assert (ego[0].speed, ego[0].motion, ego[0].command) == (5.0, "moderate", "Go straight")
    assert (ego[1].speed, ego[1].command, ego[2].command, ego[3].command) == (7.0, "Unknown", "U-Turn", "Turn left")
    assert (ego[0].ay, ego[1].ay, ego[2].ay) == (0.0, 2.0, 0.0)
    o = scenes.objects(frames, rear=20.0)
    assert [(r.number, r.name, r.vx, r.place) for r in o.collect()] == [(1, "car", 0.0, "ahead-center")]
    assert scenes.objects(frames).count() == 2
    hit = scenes.contacts(o, scenes.ego_states(frames)).first()
    assert hit.ttc == pytest.approx((10 - 1.65 - 4.35) / 5, abs=1e-3) and hit.risk == "HIGH" and hit.closing == pytest.approx(5.0)
    assert scenes.scene_summary(o).first().class_counts == {"car": 1}


def test_priors(spark):
    car = ("car", 12.34, 12.0, 3.0, 1.0, 0.0, 1.0, "moving", [2, 3], "ahead-left", 1.5, "HIGH", 0.7)
    cone = ("traffic_cone", 20.0, -20.0, 0.0, 0.0, 0.0, 0.0, "stationary", [5], "behind-center", None, "NONE", 0.0)
    kind = f"sample_idx bigint, objects array<{priors.OBJECT}>, ego {priors.EGO}, location string, description string, risk {priors.RISK}"
    rows = [(1, [car, cone], ("slow", 4.0, 14.4, "Go straight"), "town", "rain", ("Low", None)), (2, [], ("stationary", 0.0, 0.0, "Unknown"), None, None, None)]
    got = {(r.sample_idx, r.category): r.prior.split("\n") for r in priors.prior_texts(spark.createDataFrame(rows, kind)).collect()}
    assert len(got) == 20
    lines = got[1, "Observation"]
    assert "  OBJ 1: car at distance=12.3m (ahead-left) visible in Image 2 (Front), Image 3 (Front-right)" in lines and lines[-1] == "** Total Objects in Scene: 2 **"
    assert "  - Image 5 (Rear): 1 objects (traffic_cone)" in lines and "  - Image 1 (Front-left): No objects" in lines and "  - car: 1" in lines
    assert got[2, "Observation"].count("  - No objects detected") == 2
    lines = got[1, "Spatial_Relationships_and_Occlusion"]
    assert lines[-6:-2] == ["  - Ahead: OBJ 1 (car) at 12.3m", "  - Behind: OBJ 2 (traffic_cone) at 20.0m", "  - Left: OBJ 1 (car) at 12.3m", "  - Right: Clear"]
    assert "  OBJ 2: traffic_cone, distance=20.0m, position=[x=-20.0m behind, y=0.0m right], visible in Image 5 (Rear)" in lines
    assert "  OBJ 2: traffic_cone at distance=20.0m, visible in Image 5 (Rear)" in got[1, "Traffic_Signs_and_Signals"] and "** No traffic-related objects in 3D annotations **" in got[2, "Traffic_Signs_and_Signals"]
    lines = got[1, "Dynamic_Agents_and_Risk_Assessment"]
    assert "    distance=20.0m, velocity=[vx=0.00, vy=0.00] m/s, TTC=∞, Risk=NONE, closing_speed=0.00m/s" in lines
    assert lines[-7:] == ["** Risk Level Distribution **", "  - HIGH: 1 objects", "  - NONE: 1 objects", "", "** Previous VQA Risk Analysis Summary **", "  - Overall Risk Level: Low", "  - Scene: N/A"]
    assert got[2, "Dynamic_Agents_and_Risk_Assessment"][-2:] == ["** Risk Level Distribution **", ""]
    assert [x for x in got[1, "Right_of_Way_and_Planning"] if "OBJ" in x] == ["  OBJ 1: car at distance=12.3m (ahead-left), TTC=1.50s, visible in Image 2 (Front), Image 3 (Front-right)"]
    assert "  - Speed: 4.00 m/s (14.4 km/h)" in got[1, "Attributes_and_States"] and "  - Motion: SLOW" in got[1, "Attributes_and_States"]
    lines = got[1, "Causal_and_Hypothetical_Reasoning"]
    assert "  OBJ 1: car at distance=12.3m, speed=1.00m/s, heading toward, visible in Image 2 (Front), Image 3 (Front-right)" in lines and "  - Estimated stopping distance (comfortable): 2.3m" in lines
    assert "  - No moving objects detected" in got[2, "Causal_and_Hypothetical_Reasoning"] and "  - Location: None" in got[2, "Environmental_and_Sensor_Conditions"]


def test_metrics_keep_failed_samples_in_the_base(spark):
    boxes = spark.createDataFrame([(1, "gt", 0, 1, "a", 0.0, 0.0, 9.0, 9.0), (1, "pred", 0, 1, "a", 0.0, 0.0, 9.0, 9.0), (2, "gt", 0, 1, "a", 0.0, 0.0, 9.0, 9.0), (3, "pred", 0, 1, "a", 0.0, 0.0, 9.0, 9.0)], "sample bigint, side string, idx int, view int, label string, x1 double, y1 double, x2 double, y2 double")
    samples = spark.createDataFrame([(1, "C", True, True), (2, "C", False, False), (3, "C", True, True)], "sample bigint, category string, correct boolean, parsed boolean")
    r = evaluate.category_metrics(samples, M.greedy_match(boxes)).first()
    assert (r.n, round(r.answer_acc, 4), r.grounding_acc, round(r.spurious, 4), round(r.missing, 4), r.missing_grounded) == (3, 0.6667, 0.5, 0.3333, 0.3333, 0.5)


def test_run_summary(spark):
    rows = [("e", "A", 1, 0.9, 1.0), ("e", "A", 2, 0.5, 0.2), ("e", "B", 1, 0.3, 1.0), ("e", "B", 2, 0.4, 0.4), ("f", "A", 1, 0.9, 1.0)]
    got = {r.experiment: r for r in evaluate.run_summary(spark.createDataFrame(rows, "experiment string, category string, stage int, answer_acc double, format_valid double")).collect()}
    assert got["e"].forgetting == pytest.approx((0.4 - 0.1) / 2) and got["e"].collapse == pytest.approx(0.3)
    assert got["f"].forgetting is None


def test_nearest_fill_and_asof_ties_go_low(spark):
    df = spark.createDataFrame([("s", 0, None), ("s", 1, 7), ("s", 2, None), ("s", 3, 8), ("t", 9, None)], "g string, i int, v int")
    assert [r.f for r in windows.nearest_fill(df, "g", "i", "v", "f").orderBy("i").collect()] == [7, 7, 7, 8, None]
    left = spark.createDataFrame([("a", 10), ("a", 15), ("a", 90)], "g string, t int")
    right = spark.createDataFrame([("a", 10, 1), ("a", 20, 2)], "g string, t int, v int")
    assert [r.o for r in windows.asof_nearest(left, right, "g", "t", "v", 20, "o").orderBy("t").collect()] == [1, 1, None]


def test_best_pick_without_candidates(spark):
    left, right = spark.createDataFrame([(1, 5), (2, 6)], "a int, k int"), spark.createDataFrame([(5, 9), (5, 3)], "k2 int, b int")
    got = {r.a: r.picked for r in joins.best_pick(left, right, F.col("k") == F.col("k2"), "a", [F.col("b")], "b", -1).collect()}
    assert got == {1: 3, 2: -1}


def test_calls_keep_errors_in_rows(spark):
    def make():
        def client(prompt, attempt):
            if prompt == "bad":
                raise RuntimeError("down")
            return "ok" if attempt == 2 else ""

        return client

    df = spark.createDataFrame([(1, "a"), (2, "bad")], "id bigint, p string")
    got = {r.id: (r.answer, r.attempts, r.error) for r in complete(df, "id", "p", make, bool).collect()}
    assert got == {1: ("ok", 2, None), 2: (None, 3, "down")}


def test_back_off_and_judges(spark):
    def flaky():
        def client(prompt, attempt):
            if attempt < 3:
                raise RuntimeError("busy")
            return "yes it is" if prompt == "good" else "no"

        return client

    df = spark.createDataFrame([(1, "good", "x", "x"), (2, "bad", "x", "y"), (3, "good", "x", "y")], "id bigint, p string, a string, b string")
    got = {r.id: (r.answer, r.attempts) for r in complete(df, "id", "p", flaky, bool, wait=0.01).collect()}
    assert got == {1: ("yes it is", 3), 2: ("no", 3), 3: ("yes it is", 3)}
    same = equal_by_judge(df, "id", F.col("a") == F.col("b"), "p", flaky)
    assert {r.id: r.correct for r in same.collect()} == {1: True, 2: False, 3: True}
    source = judged(df, "id", F.when(F.col("id") == 1, "Z"), "p", flaky, bool, tries=2)
    assert {r.id: (r.answer, r.source, r.extracted) for r in source.collect()} == {1: ("Z", "rule", False), 2: ("", "judge", False), 3: ("", "judge", False)}


def test_best_pick_of_equal_shapes(spark):
    """Equal rows meet as one, with the results of all pairs: nulls, repeated and missing keys, ties."""
    left = spark.createDataFrame([(i % 50, "ab"[i % 2], i % 4) for i in range(60)] + [(90, None, 1), (91, "a", None), (92, "z", 1), (None, "a", 2)], "a int, g string, x int")
    right = spark.createDataFrame([(None if i % 7 == 0 else i, "ab"[i % 3 // 2], i % 5) for i in range(80)] + [(99, None, 1), (98, "a", None), (97, "a", 3)], "b int, h string, y int")
    args = left, right, (F.col("g") == F.col("h")) & (F.abs(F.col("x") - F.col("y")) < 2), "a", [F.abs(F.col("x") - F.col("y")), F.col("b")], "b", -1
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    every, met = joins.best_pick(*args), joins.best_pick(*args, (["g", "x"], ["h", "y"]))
    assert rows(met) == rows(every) and met.dtypes == every.dtypes
    assert met._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].count("Aggregate") == 2
