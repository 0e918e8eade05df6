"""Geometry over numbers derived from lineitem and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneqa.functions import geometry as G
from sceneqa.queries.registry import query
from sceneqa.sources.tables import table


def _boxes(spark, sf):
    """Two boxes a line item, of whole numbers."""
    q, n, s = F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.col("l_suppkey").cast("int")
    li = table(spark, sf, "lineitem")
    a = [q, n * 3, q + 20, n * 3 + 15]
    b = [q + s % 7, n * 3 + s % 5, q + s % 7 + 18, n * 3 + s % 5 + 12]
    return li.select("l_orderkey", "l_linenumber", *[v.cast("double").alias(f"{k}{i}") for k, box in (("a", a), ("b", b)) for i, v in enumerate(box)])


_B = """select l_orderkey, l_linenumber, l_quantity::int q, l_linenumber * 3 n, (l_suppkey % 7)::int u, (l_suppkey % 5)::int v from lineitem"""
_I = f"""select l_orderkey, l_linenumber, greatest(least(q + 20, q + u + 18) - greatest(q, q + u), 0)::double * greatest(least(n + 15, n + v + 12) - greatest(n, n + v), 0) i,
 300.0::double + 216 as s, (greatest(q + 20, q + u + 18) - q)::double * (greatest(n + 15, n + v + 12) - n) hull from ({_B})"""


@query(f"select l_orderkey, l_linenumber, round(i / (s - i), 6) iou, round(i, 6) area from ({_I})")
def iou(spark, sf):
    a, b = ([F.col(f"{k}{i}") for i in range(4)] for k in "ab")
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", F.round(G.iou(a, b), 6).alias("iou"), F.round(G.intersection(a, b), 6).alias("area"))


@query(f"select l_orderkey, l_linenumber, round(i / (s - i) - (hull - (s - i)) / hull, 6) + 0.0 giou from ({_I})")
def giou(spark, sf):
    a, b = ([F.col(f"{k}{i}") for i in range(4)] for k in "ab")
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", (F.round(G.giou(a, b), 6) + 0.0).alias("giou"))


@query("""
select l_orderkey, l_linenumber, greatest(0, least(1000, round_even(l_partkey % 1700 / 1600.0::double * 1000, 0)::int)) nx, greatest(0, least(1000, round_even(l_suppkey % 950 / 900.0::double * 1000, 0)::int)) ny from lineitem""")
def pixel_normalize(spark, sf):
    nx, ny = G.normalize_pixel(F.col("l_partkey") % 1700, 1600.0), G.normalize_pixel(F.col("l_suppkey") % 950, 900.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", nx.alias("nx"), ny.alias("ny"))


def _angles(spark, sf):
    half = F.radians((F.col("p_partkey") % 360 - 180).cast("double")) / 2
    return table(spark, sf, "part").select("p_partkey", "p_size", half.alias("half"), F.array(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half)).alias("q"))


@query("select p_partkey, round(abs(degrees(2 * atan2(sin(h), cos(h)))), 4) yaw, round(cos(2 * h), 6) + 0.0 r00 from (select p_partkey, radians((p_partkey % 360 - 180)::double) / 2 h from part)")
def quat_yaw(spark, sf):
    p = _angles(spark, sf)
    yaw = F.degrees(G.quat_yaw(F.col("q")))
    return p.select("p_partkey", F.round(F.abs(yaw), 4).alias("yaw"), (F.round(F.get(F.get(G.quat_matrix(F.col("q")), 0), 0), 6) + 0.0).alias("r00"))


@query("""
with p as (select p_partkey, p_size::double x, (p_partkey % 20 - 10)::double y, (p_partkey % 7 + 1)::double z from part)
select p_partkey, round(800 * x / (z + 2) + 800, 4) u, round(800 * y / (z + 2) + 450, 4) v, z + 2 as depth,
 800 * x / (z + 2) + 800 >= 0 and 800 * x / (z + 2) + 800 < 1600 and 800 * y / (z + 2) + 450 >= 0 and 800 * y / (z + 2) + 450 < 900 visible from p""")
def project_point(spark, sf):
    d = lambda c: c.cast("double")
    point = F.array(d(F.col("p_size")), d(F.col("p_partkey") % 20 - 10), d(F.col("p_partkey") % 7 + 1))
    eye = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(3)]) for i in range(3)])
    k = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in ((800, 0, 800), (0, 800, 450), (0, 0, 1))])
    p = table(spark, sf, "part").select("p_partkey", G.project(point, eye, F.array(F.lit(0.0), F.lit(0.0), F.lit(2.0)), k).alias("p"))
    return p.select("p_partkey", F.round(F.get("p", 0), 4).alias("u"), F.round(F.get("p", 1), 4).alias("v"), F.get("p", 2).alias("depth"), G.visible(F.array("p")).alias("visible"))


@query("""
with p as (select p_partkey, (p_size % 12)::double x, (p_partkey % 9)::double y, radians((p_partkey % 90)::double) t from part),
s as (select p_partkey, [abs(x) <= 2.35 + 2 * abs(cos(t)) + 1 * abs(sin(t)), abs(y) <= 0.95 + 2 * abs(sin(t)) + 1 * abs(cos(t)),
 abs(x * cos(t) + y * sin(t)) <= 2 + 2.35 * abs(cos(t)) + 0.95 * abs(sin(t)), abs(-x * sin(t) + y * cos(t)) <= 1 + 2.35 * abs(sin(t)) + 0.95 * abs(cos(t))] c from p)
select p_partkey, len(list_filter(c, lambda x: not x)) = 0 overlap from s""")
def obb_overlap(spark, sf):
    d = lambda c: c.cast("double")
    ego = (F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(2.35), F.lit(0.95))
    other = (d(F.col("p_size") % 12), d(F.col("p_partkey") % 9), F.radians(d(F.col("p_partkey") % 90)), F.lit(2.0), F.lit(1.0))
    return table(spark, sf, "part").select("p_partkey", G.obb_overlap(ego, other).alias("overlap"))


@query("""
with p as (select p_partkey, (p_size * 40 + 17)::int h, (p_partkey % 1500 + 20)::int w from part),
r as (select *, greatest(28, round_even(h / 28.0::double, 0)::int * 28) h0, greatest(28, round_even(w / 28.0::double, 0)::int * 28) w0, h::double * w a from p),
c as (select *, case when h0 * w0 > 1003520 then [greatest(28, floor(h / sqrt(a / 1003520) / 28)::int * 28), greatest(28, floor(w / sqrt(a / 1003520) / 28)::int * 28)]
 when h0 * w0 < 3136 then [ceil(h * sqrt(3136 / a) / 28)::int * 28, ceil(w * sqrt(3136 / a) / 28)::int * 28] else [h0, w0] end s from r)
select p_partkey, s[1]::int h, s[2]::int w from c where greatest(h, w) / least(h, w)::double <= 200""")
def smart_resize(spark, sf):
    h, w = (F.col("p_size") * 40 + 17).cast("int"), (F.col("p_partkey") % 1500 + 20).cast("int")
    s = table(spark, sf, "part").select("p_partkey", G.smart_resize(h, w).alias("s")).where("s is not null")
    return s.select("p_partkey", F.get("s", 0).cast("int").alias("h"), F.get("s", 1).cast("int").alias("w"))


@query("""
select s::bigint step, round(case when s < 50 then s / 50.0::double when s < 400 then 1.0 else greatest(0.0, (500.0 - s) / 100) end, 6) lr from range(500) t(s)""")
def trapezoid(spark, sf):
    return spark.range(500).select(F.col("id").alias("step"), F.round(G.trapezoid(F.col("id"), 500), 6).alias("lr"))


@query("""
with p as (select p_partkey, (p_size - 25)::double x, (p_partkey % 21 - 10)::double y, (p_partkey % 7 - 3)::double vx, (p_size % 5 - 2)::double vy from part),
s as (select p_partkey, min(k) k from p, range(0, 201) r(k) where abs(x + vx * k * 0.05) <= 4.0 and abs(y + vy * k * 0.05) <= 2.0 group by 1)
select p.p_partkey, round(s.k * 0.05, 2)::double ttc, case when s.k is null then 'NONE' when s.k = 0 then 'CRITICAL' when s.k * 0.05 < 2 then 'HIGH' when s.k * 0.05 < 5 then 'MODERATE' else 'LOW' end band from p left join s using (p_partkey)""")
def ttc_scan(spark, sf):
    d = lambda c: c.cast("double")
    x, y, vx, vy = d(F.col("p_size") - 25), d(F.col("p_partkey") % 21 - 10), d(F.col("p_partkey") % 7 - 3), d(F.col("p_size") % 5 - 2)
    steps = F.filter(F.sequence(F.lit(0), F.lit(200)), lambda k: (F.abs(x + vx * k * 0.05) <= 4.0) & (F.abs(y + vy * k * 0.05) <= 2.0))
    p = table(spark, sf, "part").select("p_partkey", F.get(steps, 0).alias("k"))
    ttc = F.col("k") * 0.05
    return p.select("p_partkey", F.round(ttc, 2).alias("ttc"), G.risk_band(ttc).alias("band"))


@query("""
with p as (select p_partkey, (p_size - 25)::double x, (p_partkey % 21 - 10)::double y, (p_partkey % 7 - 3)::double vx, (p_size % 5 - 2)::double vy from part),
t as (select p_partkey, case when vx = 0 then case when abs(x) <= 4 then 0.0 end else least((-4 - x) / vx, (4 - x) / vx) end ex, case when vx = 0 then case when abs(x) <= 4 then 1e18 end else greatest((-4 - x) / vx, (4 - x) / vx) end lx,
 case when vy = 0 then case when abs(y) <= 2 then 0.0 end else least((-2 - y) / vy, (2 - y) / vy) end ey, case when vy = 0 then case when abs(y) <= 2 then 1e18 end else greatest((-2 - y) / vy, (2 - y) / vy) end ly
 from (select p_partkey, x, y, nullif(vx, 0) vx0, nullif(vy, 0) vy0, vx, vy from p))
select p_partkey, case when ex is not null and ey is not null and greatest(ex, ey, 0.0) <= least(lx, ly) and least(lx, ly) >= 0 then round(greatest(ex, ey, 0.0), 6) end ttc from t""")
def ttc_axis_aligned(spark, sf):
    d = lambda c: c.cast("double")
    x, y, vx, vy = d(F.col("p_size") - 25), d(F.col("p_partkey") % 21 - 10), d(F.col("p_partkey") % 7 - 3), d(F.col("p_size") % 5 - 2)
    return table(spark, sf, "part").select("p_partkey", F.round(G.ttc_boxes(x, y, vx, vy, F.lit(4.0), F.lit(2.0)), 6).alias("ttc"))


@query("""
select event_id, case when v < 0.1 then 'stationary' when v < 5 then 'slow' when v < 15 then 'moderate' else 'fast' end band, case when v > 0.5 then round(v * v / 7.0, 4) end stop from (select event_id, abs("value") / 4 v from events)""")
def motion_bands(spark, sf):
    v = F.abs("value") / 4
    return table(spark, sf, "events").select("event_id", G.motion_band(v).alias("band"), F.round(G.stopping_distance(v), 4).alias("stop"))


@query("""
with p as (select p_partkey, p_size - 25 x, p_partkey % 21 - 10 y from part)
select p_partkey, case when x > 2 then 'ahead' when x < -2 then 'behind' else 'beside' end || '-' || case when y > 1 then 'left' when y < -1 then 'right' else 'center' end as label from p""")
def relative_position(spark, sf):
    return table(spark, sf, "part").select("p_partkey", G.relative_label(F.col("p_size") - 25, F.col("p_partkey") % 21 - 10).alias("label"))


@query("""
select doc_id, (floor(least(greatest(n_chars / 30.0::double * 2.0, 4.0), least(768.0, n_chars::double)) / 2) * 2)::int frames from documents""")
def frame_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", G.frame_count(F.col("n_chars"), F.lit(30.0)).alias("frames"))
