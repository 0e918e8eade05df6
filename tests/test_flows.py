"""Model calls in flight, files of a least age, last rows of streams, atomic publication, late headers, answers of any shape."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from sceneqa.functions import messages
from sceneqa.functions import text as T
from sceneqa.operators import qa
from sceneqa.plans import label
from sceneqa.sources import sinks, tables
from sceneqa.streaming import aged, resume


def slow(seconds):
    def make():
        open_, most, lock = [0], [0], threading.Lock()

        def call(prompt, attempt):
            with lock:
                open_[0] += 1
                most[0] = max(most[0], open_[0])
            time.sleep(seconds * (3 if prompt == "p0" else 1))  # the first row is the slowest
            with lock:
                open_[0] -= 1
            if prompt == "p7" and attempt < 2:
                raise OSError("busy")
            return "" if prompt == "p9" else f"{prompt}:{attempt}:{most[0] <= 8}"

        return call

    return make


def test_calls_in_flight_keep_rows_and_order(spark):
    df = spark.range(64).select("id", F.concat(F.lit("p"), "id").alias("p")).coalesce(1)
    took, got = {}, {}
    for n in (1, 8):
        began = time.time()
        got[n] = [tuple(r) for r in label.complete(df, "id", "p", slow(0.05), bool, inflight=n).collect()]
        took[n] = time.time() - began
    assert got[8] == got[1] and [r[0] for r in got[8]] == list(range(64))
    assert got[8][7] == (7, "p7:2:True", 2, None) and got[8][9] == (9, None, 3, "invalid") and all(r[1].endswith("True") for r in got[8] if r[1])
    assert took[1] > 3.2 and took[8] < took[1] / 3


def test_rate_of_calls():
    bucket, began = label.Bucket(20), time.monotonic()
    threads = [threading.Thread(target=bucket.take) for _ in range(40)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert 0.9 < time.monotonic() - began < 2  # 20 at once, 20 over a second


def test_calls_are_taken_up_again(spark, tmp_path):
    out, asked = str(tmp_path / "answers"), str(tmp_path / "asked")
    os.makedirs(asked)
    df = spark.range(40).select("id", F.col("id").cast("string").alias("p"))

    def client(broken):
        def make():
            def call(p, _):
                open(f"{asked}/{p}-{broken}", "w").close()
                if int(p) % 4 == 0 and broken:
                    raise ValueError("down")
                return p

            return call

        return make

    first = label.complete_into(df, "id", "p", client(True), bool, out, chunks=4, tries=1)
    assert {r.id: (r.answer, r.error) for r in first.collect()} == {i: (None, "down") if i % 4 == 0 else (str(i), None) for i in range(40)}
    again = label.complete_into(df, "id", "p", client(False), bool, out, chunks=4, tries=1)
    assert sorted((r.id, r.answer) for r in again.collect()) == [(i, str(i)) for i in range(40)]
    assert sum(f.endswith("False") for f in os.listdir(asked)) == 10  # those that failed, and no others


def test_young_files_wait_and_none_is_lost(spark, tmp_path):
    src, ledger, out = (str(tmp_path / x) for x in ("in", "ledger", "out"))
    os.makedirs(f"{src}/deep")

    def put(name, value, age):
        with open(f"{src}/{name}", "w") as f:
            f.write(json.dumps({"v": value}) + "\n")
        os.utime(f"{src}/{name}", (time.time() - age,) * 2)

    def take():
        return aged.take_ripe(spark, src, "v int", ledger, out, 120)

    def seen():
        return sorted((r.run, r.v) for r in spark.read.schema("v int, run bigint").parquet(out).collect())

    put("a.json", 1, 500), put("deep/b.json", 2, 500), put("young.json", 3, 5)
    assert take() == 2 and take() == 0 and seen() == [(1, 1), (1, 2)]
    put("young.json", 3, 130), put("moved.json", 4, 9000)  # an old file that was moved in later
    assert take() == 2 and seen() == [(1, 1), (1, 2), (2, 3), (2, 4)]
    put("late.json", 5, 300)
    late = aged.ripe_files(spark, src, 120, "late.json").select(F.lit(3).cast("bigint").alias("run"), "path", "changed")
    late.write.mode("append").parquet(f"{ledger}/claims")
    put("next.json", 6, 300)
    assert take() == 1 and take() == 1 and seen()[4:] == [(3, 5), (4, 6)]  # the run that broke off is made first
    put("a.json", 7, 200)  # a new version
    assert take() == 1 and seen()[-1] == (5, 7)


def test_last_rows_of_a_stream(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    batches = [[(1, 5, "e"), (1, 3, "c"), (None, 1, "n")], [(1, 4, "late"), (1, 5, "e"), (2, None, "first")], [(1, 9, "i"), (2, 0, "z"), (1, 2, "b")]]
    log = None
    for rows in batches:
        spark.createDataFrame(rows, "k int, o int, v string").coalesce(1).write.mode("append").parquet(src)
        resume.keep_last(resume.read_new(spark, src, "k int, o int, v string"), out, state, ["k"], ["o"])
        log = spark.read.parquet(out)
    assert {tuple(r) for r in resume.last_rows(log, ["k"], ["o"]).collect()} == {(1, 9, "i"), (2, 0, "z"), (None, 1, "n")}
    assert log.where("v = 'late'").count() == 0 and log.count() == 5  # rows that change nothing leave no trace


def test_state_of_quiet_keys_goes(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for day, rows in enumerate([["1 00:00:00"], ["9 00:00:00"], ["9 01:00:00"]]):
        data = spark.createDataFrame([(day, r) for r in rows], "k int, t string").select("k", F.to_timestamp(F.concat(F.lit("2024-01-0"), "t")).alias("t"))
        data.write.mode("append").parquet(src)
        resume.keep_last(resume.read_new(spark, src, "k int, t timestamp"), out, state, ["k"], ["t"], "t", "1 day")
    left = spark.read.format("statestore").load(state).selectExpr("key.k").collect()
    assert sorted(r.k for r in left) == [1, 2] and spark.read.parquet(out).count() == 3


@pytest.mark.parametrize("single", [False, True])
def test_publication_is_whole_and_once(spark, tmp_path, single):
    place = str(tmp_path / "report.parquet")
    assert sinks.publish_once(spark.range(10), place, single) is True
    assert os.path.isfile(place) == single and spark.read.parquet(place).count() == 10
    assert sinks.publish_once(spark.range(3), place, single) is False and spark.read.parquet(place).count() == 10
    won = []
    other = str(tmp_path / "race.parquet")
    threads = [threading.Thread(target=lambda n=n: won.append(sinks.publish_once(spark.range(n), other, single))) for n in (2, 3, 4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False, False, True] and spark.read.parquet(other).count() in (2, 3, 4)
    assert not [f for f in os.listdir(tmp_path) if ".part-" in f]


def test_late_header_of_files_in_many_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("junk,1\r\n\r\nTime, Speed ,x\r\n0.5,36,1\r\nbad,1,1\r\nTime,72,1\r\n1.5,72,1\r\n")
    (tmp_path / "b.csv").write_text("x\nTime,other,Speed\n" + "".join(f"{i},0,{3.6 * i}\n" for i in range(20_000)))
    (tmp_path / "c.csv").write_text("no header\n1,2,3\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        df = tables.late_header_csv(spark, str(tmp_path), "Time", "Speed")
        assert df.rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 20_002 and got[:2] == [(0.0, 0.0), (0.5, pytest.approx(10))] and got[-1] == (19_999.0, pytest.approx(19_999))


def test_keys_of_nested_answers(spark):
    same = [['{"a":1,"b":{"d":[1,null],"c":"X"}}', '{"b":{"c":"X","d":[1,null]},"a":1}'], ['"Yes "', '"yes"'], ["1", '"1"', "1.0"], ["null", None], ["[2,1]"], ["[1,2]"], ['{"a":null}'], ["{}"], ["[]"], ["true"], ['"true"'], ['"None"'], ["[null]"]]
    df = spark.createDataFrame([(i, x) for i, group in enumerate(same) for x in group], "g int, j string").select("g", qa.nested_key(F.try_parse_json("j")).alias("k"))
    keys = {}
    for r in df.collect():
        assert r.k is not None
        keys.setdefault(r.g, set()).add(r.k)
    assert all(len(k) == 1 for k in keys.values()) and len({k for s in keys.values() for k in s}) == len(same)
    assert spark.sql("select parse_json('{\"b\":2,\"a\":1}') p, parse_json('{\"a\":1,\"b\":2}') c").select(qa.trap_pair(qa.nested_key(F.col("p")), qa.nested_key(F.col("c")), F.lit(True))).first()[0] == "honest_same"


def test_display_cleaning(spark):
    raw = "a \uFFFD~F~R b::\n:\nc::d ENUUU ENU U exxected SUPPLEMENT TTARY featureE objectt s 1.52]]\n m\r\rx \t\n\n\n\n\u2028end \n"
    want = "a  b:\nc:d ENU ENU EXPECTED SUPPLEMENTARY feature objects 1.52] m\n\nx\n\n\nend"
    assert spark.createDataFrame([(raw,)], "t string").select(T.clean_display(F.col("t"))).first()[0] == want


def test_post_checks(spark):
    rows = [("It is (B).", "B", ["x", "y"], True), ("A dog in red", "A", ["x", "y"], False), ("the Y one", "B", ["x", "y"], True), ("green of course", "B", ["red", "green"], True), ("red green", "A", ["red", "green"], False), ("I can't process this file.", "Z", ["red"], True), ("0.5", "1/2", [], True), ("no", "yes", [], False), ("C", "C", ["p", "q"], False)]
    df = spark.createDataFrame([(*r[:3],) for r in rows], "r string, a string, c array<string>")
    assert [x[0] for x in df.select(messages.post_check(F.col("r"), F.col("a"), F.col("c"))).collect()] == [r[3] for r in rows]


def test_object_listing(spark):
    view = "struct<image:int,camera:string,box:array<double>>"
    rows = [([("car", 9.96, 1.0, 0.0, None, "LOW", [(2, "Front", [1.0, 2.0, 30.0, 40.0]), (1, "Front-left", None)]), ("far", 99.0, 0.0, 0.0, None, None, [(1, "Front", None)]), ("hidden", 1.0, 0.0, 0.0, None, None, []), ("bus", 5.0, 0.0, -2.0, 3.456, "HIGH", [(5, "Rear", None)])],), ([],)]
    df = spark.createDataFrame(rows, f"o array<struct<name:string,distance:double,vx:double,vy:double,ttc:double,risk:string,views:array<{view}>>>")
    full, none = (r[0] for r in df.select(messages.object_listing(F.col("o"), 20)).collect())
    assert full.split("\n") == [
        "2 objects within 20.0m",
        "OBJ 1: car [Image 1 (Front-left), Image 2 (Front) bbox[1,2,30,40]]",
        "car at distance=10.0m from the ego, moving with velocity [vx=1.00, vy=0.00] visible in Image 1 (Front-left), Image 2 (Front) bbox[1,2,30,40]",
        ">> TTC = ∞, Risk = LOW",
        "OBJ 2: bus [Image 5 (Rear)]",
        "bus at distance=5.0m from the ego, moving with velocity [vx=0.00, vy=-2.00] visible in Image 5 (Rear)",
        ">> TTC = 3.46s, Risk = HIGH",
    ]
    assert none == "No objects are visible within 20.0m."
