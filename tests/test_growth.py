"""Steps whose cost per row counts on large tables: what is computed once, and what it gives."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sceneqa.functions import geometry as G
from sceneqa.functions import text as T
from sceneqa.functions.text_udf import number
from sceneqa.queries import catalogue
from sceneqa.streaming.resume import _tuples


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_values_of_repeated_texts_are_kept():
    number.cache_clear()
    assert [number(t) for t in ["2**3", "\\frac{1}{4}", "2**3", None, "x", "x"]] == [8.0, 0.25, 8.0, None, None, None]
    assert number.cache_info().hits == 2


def contact(axes, moves, horizon=10.0, step=0.05, fine=1e-3):
    """The search in plain Python."""
    if any(v is None for x in axes for v in x):
        return None
    near = lambda t: all(math.isnan(r) or abs(p + v * t + a * t * t) <= r for p, v, a, r in axes)
    if near(0.0):
        return 0.0
    hit = next((k for k in range(1, round(horizon / step) + 1) if near(k * step)), None)
    if not moves or hit is None:
        return None
    lo, hi = (hit - 1) * step, hit * step
    for _ in range(math.ceil(math.log2(step / fine))):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if near(mid) else (mid, hi)
    return hi


def test_contacts_are_searched_for_many_rows_at_once(spark):
    rng = random.Random(3)
    data = [(i, *[rng.choice([None, math.nan, 0.0]) if rng.random() < 0.03 else rng.uniform(-20, 20) for _ in range(6)]) for i in range(300)]
    df = spark.createDataFrame(data, "k int, x double, y double, yaw double, vx double, vy double, ax double")
    ego, zero = [F.lit(v) for v in (1.0, 0.0, 0.0, 2.0, 1.0)], F.lit(0.0)
    out = df.select("k", G.ttc_obb(ego, [F.col("x"), F.col("y"), F.col("yaw"), F.lit(2.0), F.lit(1.0)], [F.col("vx"), F.col("vy")], [F.col("ax"), zero]).alias("t"))
    assert "sequence(" not in plan(out)
    for (_, x, y, yaw, vx, vy, ax), got in zip(sorted(data), [r.t for r in out.orderBy("k").collect()], strict=True):
        if any(v is None or math.isnan(v) for v in (x, y, yaw, vx, vy, ax)):
            assert got is None or got == 0.0 or math.isfinite(got)
            continue
        axes = []
        for a in (0.0, yaw):
            for ux, uy in ((math.cos(a), math.sin(a)), (-math.sin(a), math.cos(a))):
                reach = sum(2 * abs(math.cos(t) * ux + math.sin(t) * uy) + abs(-math.sin(t) * ux + math.cos(t) * uy) for t in (0.0, yaw))
                axes.append(((x - 1) * ux + y * uy, vx * ux + vy * uy, ax * ux / 2, reach))
        want = contact(axes, math.hypot(vx, vy) >= 0.1 or abs(ax) >= 0.1)
        assert (got is None) == (want is None) and (got is None or abs(got - want) < 2e-3)


def test_replies_are_parsed_once(spark, sf):
    assert plan(catalogue.queries()["ref_render_parse"](spark, sf)).count("from_json") == 1
    ref = "<|object_ref_start|> a <|object_ref_end|><|box_start|>(1,2),(3,1001)<|box_end|>"
    data = [None, "", "grounding", '{"\\u0067rounding": [{"image_idx": 2, "ref": "%s"}]}' % ref, '"image_idx": 3 ' + ref + ref.replace("1001", "4"), "{'grounding': [{'image_idx': 9}]}", '"image_idx": 1 ' + ref.replace("1", "9" * 20)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "i int, t string").select("i", T.parse_refs(F.col("t")).alias("r")).orderBy("i").collect()
    assert [r.r and [tuple(x) for x in r.r] for r in got] == [
        None, [], [], [(2, "a", None, False)], [(3, "a", None, False), (3, "a", [1, 2, 3, 4], True)], [], [(1, "a", None, None)],
    ]


@pytest.mark.parametrize("name", ["map_eval", "view_confusion", "greedy_match"])
def test_line_items_are_ranked_once(spark, sf, name):
    from sceneqa.queries import extensions as E

    boxes = E._scored(spark, sf) if name == "map_eval" else E._boxes(spark, sf)
    assert plan(boxes).count("row_number()") == 1


def test_tuples_of_a_frame():
    frame = pd.DataFrame({"a": [1, None, 3], "b": [pd.Timestamp(5), pd.NaT, None], "c": ["x", None, "y"]})
    assert _tuples(frame, ["a", "b", "c"]) == [(1.0, pd.Timestamp(5), "x"), (None, None, None), (3.0, None, "y")]


def test_ends_are_stripped_without_a_search(spark):
    df = spark.createDataFrame([(1, " \t\n\x0b\x0c\r a \n b  \n"), (2, None), (3, "  ")], "k int, t string").select("k", T.strip(F.col("t")).alias("s"))
    assert [r.s for r in df.orderBy("k").collect()] == ["a \n b ", None, ""] and "regexp" not in plan(df)
    d = df.select(F.lit("The Spatial Data is old. Postal data, fine! No 3d detection\nOK").alias("t"))
    assert T._FIRST in T.META and d.select(T.drop_meta(F.col("t")).alias("m")).first().m == "Postal data, fine!OK"
