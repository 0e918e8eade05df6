"""Ordered rows: kinematics, islands, chunks, nearest rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneqa.functions import geometry as G
from sceneqa.operators import ordered as O
from sceneqa.operators import windows as W
from sceneqa.queries.registry import query
from sceneqa.sources.tables import micros, table


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("us", micros("ts"))


@query("""
with e as (select event_id, user_id, value, epoch_us(ts) us from events),
d as (select *, lead(value) over w - value dv, (lead(us) over w - us) / 1e6 dt from e window w as (partition by user_id order by event_id))
select event_id, user_id, round(coalesce(case when dt > 0 then dv / dt end, 0), 6) + 0.0 velocity from d""")
def forward_velocity(spark, sf):
    out = W.forward_difference(_events(spark, sf), "user_id", "event_id", "us", "value", "v")
    return out.select("event_id", "user_id", (F.round("v", 6) + 0.0).alias("velocity"))


@query("""
with e as (select event_id, user_id, value, epoch_us(ts) us from events),
d as (select event_id, user_id, (lead(us) over w - us) / 1e6 a, (us - lag(us) over w) / 1e6 b, lead(value) over w - value va, value - lag(value) over w vb from e window w as (partition by user_id order by us, event_id))
select event_id, user_id, round((case when a > 0 then va / a end - case when b > 0 then vb / b end) / ((a + b) / 2), 6) + 0.0 acceleration from d""")
def centered_acceleration(spark, sf):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = _events(spark, sf).withColumn("_n", F.row_number().over(w))
    out = W.centred_acceleration(e, "user_id", "_n", "us", "value", "a")
    return out.select("event_id", "user_id", (F.round("a", 6) + 0.0).alias("acceleration"))


@query("""
with d as (select user_id, event_id, event_type, case when event_type = lag(event_type) over w then 0 else 1 end chg from events window w as (partition by user_id order by event_id)),
r as (select *, sum(chg) over (partition by user_id order by event_id) island from d)
select user_id, island::bigint island, event_type, min(event_id) "first", max(event_id) "last", count(*) n from r group by 1, 2, 3""")
def scene_islands(spark, sf):
    return W.islands(table(spark, sf, "events"), "event_id", "event_type", ["user_id"])


@query("""
with k as (select event_id, user_id, (row_number() over (partition by user_id order by event_id) - 1) i from events),
s as (select event_id, user_id, (i // 5) // 15 as chunk, (i // 5) % 15 as frame, md5(user_id || '|' || event_id) token from k where i % 5 = 0)
select event_id, user_id, chunk::int chunk, frame::int frame, token, coalesce(lag(token) over w, '') prev, coalesce(lead(token) over w, '') "next"
from s window w as (partition by user_id, chunk order by frame)""")
def keyframe_chunks(spark, sf):
    out = W.keyframes(table(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id", 5, 15, "user_id", "event_id")
    return out.select("event_id", "user_id", "chunk", "frame", "token", "prev", "next")


@query("""
with l as (select event_id, user_id, list(event_id) over (partition by user_id order by event_id rows between current row and 3 following) l from events)
select event_id, user_id, case when len(l) = 4 then array_to_string(l, ',') end ids from l""")
def n_consecutive(spark, sf):
    out = W.consecutive(table(spark, sf, "events"), "user_id", "event_id", "event_id", 4, "l")
    return out.select("event_id", "user_id", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("ids"))


@query("""
with e as (select event_id, user_id, epoch_us(ts) us from events),
l as (select event_id, user_id, us, lag(us, 2) over (partition by user_id order by event_id) first_us from e)
select event_id, user_id, (us - first_us) / 1e6 as dt from l where first_us is not null""")
def multi_frame_delta(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = _events(spark, sf).withColumn("f", F.lag("us", 2).over(w)).where("f is not null")
    return e.select("event_id", "user_id", ((F.col("us") - F.col("f")) / 1e6).alias("dt"))


_PARTS = """select p_partkey, p_brand, p_size - 25 as x, (p_partkey % 41) - 20 as y from part"""


@query(f"""
with p as ({_PARTS}), s as (select *, case when abs(y) > abs(x) then case when y > 0 then 'left' else 'right' end else case when x >= 0 then 'ahead' else 'behind' end end sector, x * x + y * y d from p),
r as (select *, row_number() over (partition by p_brand, sector order by d, p_partkey) k from s)
select p_brand, sector, p_partkey, d::bigint d from r where k = 1""")
def closest_per_sector(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", (F.col("p_size") - 25).alias("x"), (F.col("p_partkey") % 41 - 20).alias("y"))
    p = p.withColumn("sector", G.sector(F.col("x"), F.col("y"))).withColumn("d", (F.col("x") * F.col("x") + F.col("y") * F.col("y")).cast("bigint"))
    best = p.groupBy("p_brand", "sector").agg(F.min(F.struct("d", "p_partkey")).alias("b"))
    return best.select("p_brand", "sector", "b.p_partkey", "b.d")


@query("""
select user_id, event_type, arg_max(event_id, (ts, event_id)) event_id, arg_max(value, (ts, event_id)) as "value" from events group by 1, 2""")
def latest_per_key(spark, sf):
    out = W.last_write(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return out.select("user_id", "event_type", "event_id", "value")


@query("""
with t as (select doc_id, lang, n_chars from documents)
select doc_id, lang, coalesce(sum(n_chars) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from t""")
def running_offsets(spark, sf):
    out = W.running_offset(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), ["lang"], ["doc_id"], "n_chars", "offset")
    return out.select("doc_id", "lang", "offset")


@query("""
with s as (select user_id, event_id as start from events where event_type = 'login'),
e as (select user_id, event_id from events)
select e.event_id, e.user_id, max(s.start) scene from e left join s on e.user_id = s.user_id and s.start <= e.event_id group by 1, 2""")
def range_locate(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "login", F.col("event_id")), True).over(w).alias("scene"))


@query("""
with d as (select event_id, event_type, case when event_type = lag(event_type) over (order by event_id) then 0 else 1 end chg from events),
r as (select *, sum(chg) over (order by event_id) island from d)
select island::bigint island, event_type, min(event_id) "first", max(event_id) "last", count(*) n from r group by 1, 2""")
def global_islands(spark, sf):
    """Scenes of the whole log, as a frame list without a scene column gives them."""
    return W.islands(table(spark, sf, "events"), "event_id", "event_type")


@query("select event_id, coalesce(max(case when event_type = 'login' then event_id end) over (order by event_id), -1) scene from events")
def global_locate(spark, sf):
    mark = F.when(F.col("event_type") == "login", F.col("event_id"))
    return O.locate(table(spark, sf, "events").select("event_id", "event_type"), ["event_id"], mark, "scene").select("event_id", F.coalesce("scene", F.lit(-1)).alias("scene"))


@query("select doc_id, coalesce(sum(n_chars) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from documents")
def global_offsets(spark, sf):
    return W.running_offset(table(spark, sf, "documents").select("doc_id", "n_chars"), [], ["doc_id"], "n_chars", "offset").select("doc_id", "offset")


@query("""
with d as (select d.doc_id, d.source, l.quality from documents d left join labels l using (doc_id)),
k as (select source, doc_id kid, quality kq from d where quality is not null)
select d.doc_id, d.source, arg_min(k.kq, (abs(d.doc_id - k.kid), k.kid)) filled from d left join k on d.source = k.source group by 1, 2""")
def fill_hot_groups(spark, sf):
    """nearest_labelled_fill for groups of any size: a source is cut into ranges of doc_id."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return O.nearest_fill(d.select("doc_id", "source", "quality"), "doc_id", "quality", "filled", ["source"]).select("doc_id", "source", "filled")


@query("""
with a as (select event_id, epoch_us(ts) us from events where event_type = 'purchase'),
b as (select epoch_us(ts) us, max(event_id) eid from events where event_type = 'view' group by 1),
n as (select a.event_id, a.us, (select max(us) from b where b.us <= a.us) lo, (select min(us) from b where b.us >= a.us) hi from a),
p as (select event_id, case when us - lo <= 60000000 and (hi is null or us - lo <= hi - us) then lo when hi - us <= 60000000 then hi end us from n)
select event_id, eid nearest from p left join b on b.us = p.us""")
def asof_one_key(spark, sf):
    """The nearest view of any user: all rows have one key."""
    e = _events(spark, sf)
    right = e.where("event_type = 'view'").select("us", F.col("event_id").alias("eid"))
    return O.asof_nearest(e.where("event_type = 'purchase'").select("event_id", "us"), right, "us", "eid", 60_000_000, "nearest").select("event_id", "nearest")
