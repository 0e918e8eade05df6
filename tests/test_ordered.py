"""Ordered scans: the same rows however the table is partitioned, hot groups, nulls, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from sceneqa.operators import ordered as O
from sceneqa.operators import qa, sampling, windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice(["x", "y", None]), rng.choice([None, 1, 2, 3])) for i in range(600)]
    return data, spark.createDataFrame(data, "t bigint, g string, k string, v int").repartition(7, "k")


def plain(data, by):
    """Running sum, last and next value that isn't null, and the value before, of each row."""
    out = {}
    for group in {r[1] for r in data} if by else {0}:
        own = [r for r in sorted(data) if not by or r[1] == group]
        for i, r in enumerate(own):
            some = [x[3] for x in own[: i + 1] if x[3] is not None]
            later = [x[3] for x in own[i:] if x[3] is not None]
            out[r[0]] = (sum(some) if some else None, some[-1] if some else None, later[0] if later else None, (own[i - 1][3],) if i else None)
    return out


@pytest.mark.parametrize("parts", [1, 2, 9, 300])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_scan(log, parts, by):
    data, df = log
    r = O.Ranges(df, ["t"], by, parts)
    got = r.scan(sums={"s": "v"}, lasts={"l": "v"}, nexts={"n": "v"}, lags={"b": "v"})
    if parts > 1:
        assert 1 < r.df.select("_range").distinct().count() <= parts
    assert {x.t: (x.s, x.l, x.n, x.b and tuple(x.b)) for x in got.collect()} == plain(data, by)


def test_ranges_are_even_and_a_hot_group_is_split(log):
    _, df = log
    sizes = {r["_range"]: r["count"] for r in O.Ranges(df, ["t"], ["g"], 10).df.groupBy("_range").count().collect()}
    assert len(sizes) == 10 and max(sizes.values()) <= 3 * 600 / 10
    assert O.Ranges(df, ["t"], ["g"], 10).df.where("g = 'hot'").select("_range").distinct().count() >= 5


@pytest.mark.parametrize("parts", ["4", "200"])
def test_results_do_not_depend_on_partitions(spark, log, parts):
    _, df = log
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = rows(sampling.bin_pack(df, "t", "v", 4, 16)), rows(windows.islands(df, "t", "k")), rows(O.batches(df.select("t"), ["t"], 7))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert (rows(sampling.bin_pack(df, "t", "v", 4, 16)), rows(windows.islands(df, "t", "k")), rows(O.batches(df.select("t"), ["t"], 7))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_groups_as_plain_windows(log):
    _, df = log
    d = df.select("t", "g", "v")
    known = d.where("g is not null")
    assert rows(O.islands(df, "t", "k", ["g"], 9)) == rows(windows.islands(df, "t", "k", ["g"]))
    assert rows(O.nearest_fill(known, "t", "v", "f", ["g"], 9)) == rows(windows.nearest_fill(known, "g", "t", "v", "f"))
    filled = d.fillna(0, ["v"])
    assert rows(O.running_offset(filled, ["t"], "v", "o", ["g"], 9)) == rows(windows.running_offset(filled, ["g"], ["t"], "v", "o"))
    right = known.where("v is not null").select((F.col("t") * 3 % 500).alias("t"), "g", "v")
    best = right.groupBy("g", "t").agg(F.max("v").alias("v"))
    left = known.select("t", "g")
    assert rows(O.asof_nearest(left, right, "t", "v", 4, "near", ["g"], 9)) == rows(windows.asof_nearest(left, best, "g", "t", "v", 4, "near").select("t", "g", "near"))


def test_tags_of_the_whole_table(log):
    data, df = log
    got = dict(rows(qa.preceding_tag(df.select("t", "v"), None, "t", "v", "tag").select("t", "tag")))
    assert got == {t: p[1] for t, p in plain(data, False).items()}


def test_bins_of_odd_sizes(spark):
    df = spark.createDataFrame([(1, 3), (2, None), (None, 9), (4, 1), (5, 4), (5, 4)], "k bigint, n bigint")
    got = {}
    for r in sampling.bin_pack(df, "k", "n", 4, 256).collect():
        got.setdefault(r.bin, []).append((r.key, r.size))
    assert sorted(map(sorted, got.values()), key=str) == sorted([[(2, None)], [(None, 9)], [(1, 3), (4, 1)], [(5, 4)], [(5, 4)]], key=str)


def test_empty_tables(log):
    _, df = log
    none = df.limit(0)
    assert windows.islands(none, "t", "k").collect() == [] and sampling.bin_pack(none, "t", "v", 4).collect() == []
    assert O.Ranges(none, ["t"], ["g"]).scan(sums={"s": "v"}).collect() == []


@pytest.mark.parametrize("parts", [1, 8, 60])
def test_intervals_with_instant(spark, parts):
    rng = random.Random(5)
    some = lambda top: rng.choice([None, *[rng.randrange(top) for _ in range(9)]])
    intervals = [(k, rng.choice(["hot", "hot", "hot", "a", "b", None]), s, s if s is None else rng.choice([None, s, s - 3, s + 1, s + 2, s + 9, s + 60])) for k in range(400) for s in [some(2000)]]
    intervals += intervals[:30]
    instants = [(rng.choice(["hot", "a", "c", None]), some(2000), "x") for _ in range(300)]
    i = spark.createDataFrame(intervals, "k int, g string, s int, e int").withColumn("tags", F.create_map(F.lit("k"), "k"))
    t = spark.createDataFrame(instants, "g string, s int, k string").repartition(5)
    held = lambda by: sorted(r[0] for r in intervals if None not in r[2:] and any(x is not None and r[2] < x < r[3] and (not by or g == r[1] is not None) for g, x, _ in instants))
    for by in (["g"], []):
        got = O.intervals_with_instant(i, t, "s", "e", "s", by, parts)
        assert sorted(r.k for r in got.collect()) == held(by) and got.columns == i.columns
        assert O.intervals_with_instant(i.limit(0), t, "s", "e", "s", by, parts).count() == O.intervals_with_instant(i, t.limit(0), "s", "e", "s", by, parts).count() == 0


def test_no_frame_reaches_to_the_end(log):
    """Spark computes such a frame anew for each row, so a range would cost the square of its rows."""
    _, df = log
    right = df.select("t", "g", F.col("v").alias("w")).where("w is not null")
    made = [
        O.Ranges(df, ["t"], ["g"], 3).scan(lasts={"l": "v"}, nexts={"n": "v"}), O.asof_nearest(df.select("t", "g"), right, "t", "w", 4, "near", ["g"], 3),
        O.intervals_with_instant(df.select("t", (F.col("t") + 2).alias("e"), "g"), right, "t", "e", "t", ["g"], 3), O.nearest_fill(df.select("t", "v"), "t", "v", "f", (), 3),
        windows.nearest_fill(df, "g", "t", "v", "f"), windows.asof_nearest(df.select("t", "g"), right, "g", "t", "w", 4, "near"),
    ]
    for out in made:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
