"""Readers and writers over files made here, and streams."""

import json

from pyspark.sql import functions as F

from sceneqa.sources import sinks, tables
from sceneqa.streaming import resume


def test_qa_versions(spark, tmp_path):
    v1 = {"sample_idx": 1, "qa_pairs": [{"question": "q", "answer": "a", "category": "c", "template_idx": 1}]}
    pair = {"pair_id": 0, "positive": {"instantiated_question": "p", "answer": "x"}, "contrastive": None, "contrastive_skip_reason": "none"}
    v2 = {"sample_idx": 2, "qa_results": [{"category": "c", "template_idx": 2, "answer_type": "mcq", "pairs": [pair]}]}
    for i, doc in enumerate((v1, v2)):
        (tmp_path / f"000{i}_qa_results.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "other.json").write_text("{}")
    got = {(r.sample_idx, r.role, r.question, r.answer) for r in tables.unify_qa(tables.qa_files(spark, str(tmp_path))).collect()}
    assert got == {(1, "positive", "q", "a"), (2, "positive", "p", "x")}


def test_tolerant_log(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "x"}\n\n{"k": 2, "v": "y"}\n{"k": 1, "v": "z"}\n{"k": 3, "v"')
    got = {r.k: r.v for r in tables.tolerant_log(spark, str(tmp_path), "k int, v string", ["k"]).collect()}
    assert got == {1: "z", 2: "y"}


def test_trajectory_and_late_header(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1.5 1 2 3 0 0 0 1\nbad line\n2.5 1 2 3 0 0 0\n")
    rows = tables.trajectory(spark, str(tmp_path / "t.txt")).collect()
    assert [(r.ts_us, r.quaternion) for r in rows] == [(1_500_000, [1.0, 0.0, 0.0, 0.0])]
    (tmp_path / "c.csv").write_text("made by x\nTime,Other,Speed\n0.1,a,36\nbad,a,b\n0.2,a,72\n")
    rows = tables.late_header_csv(spark, str(tmp_path / "c.csv"), "Time", "Speed").collect()
    assert [(r.time, round(r.value, 6)) for r in rows] == [(0.1, 10.0), (0.2, 20.0)]


def test_prior_results_and_runs(spark, tmp_path):
    (tmp_path / "0007_b_risk.json").write_text(json.dumps({"response": " late "}))
    (tmp_path / "0007_a_risk.json").write_text(json.dumps({"response": " early "}))
    assert [(r.sample_idx, r.response) for r in tables.prior_results(spark, str(tmp_path), "risk").collect()] == [(7, "early")]
    (tmp_path / "exp__seed3").mkdir()
    (tmp_path / "exp__seed3" / "summary.json").write_text("{}")
    assert [(r.experiment, r.seed) for r in tables.run_reports(spark, str(tmp_path)).collect()] == [("exp", 3)]


def test_category_report_keeps_unknown_in_the_base(spark):
    df = spark.createDataFrame([("a",), ("a",), ("zz",), ("zz",)], "category string")
    got = {r.category: (r.n, r.pct) for r in sinks.category_report(df, "category", ["a", "b"]).collect()}
    assert got == {"a": (2, 50.0), "b": (0, 0.0)}


def test_excel_safe_and_markdown(spark):
    df = spark.createDataFrame([("a\x01b\tc", 1.23456, None)], "s string, d double, n string")
    assert sinks.excel_safe(df).first().s == "ab\tc"
    assert sinks.markdown_rows(df, ["d", "n"]).first().line == "| 1.235 |  |"


def test_stream_appends_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.range(10).write.parquet(src)
    resume.append_once(resume.read_new(spark, src, "id bigint"), out, state, ["id"])
    spark.range(5, 15).write.mode("append").parquet(src)
    resume.append_once(resume.read_new(spark, src, "id bigint"), out, state, ["id"])
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(15))


def test_hourly_counts(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:59:59' t, 'a' event_type union all select timestamp_ntz'2024-01-01 01:00:00', 'a'")
    assert sorted(r.n for r in resume.hourly_counts(df, "t").collect()) == [1, 1]
    assert resume.hourly_counts(df, "t").columns == ["hour", "event_type", "n"] and F is not None
