"""Lookups, fills, as-of, theta and anti joins, division, instantiation, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneqa.operators import joins as J
from sceneqa.operators import ordered as O
from sceneqa.operators import windows as W
from sceneqa.queries.registry import query
from sceneqa.sources.tables import micros, table


@query("""
with m as (select text, arg_max(quality, doc_id) q from documents join labels using (doc_id) group by text)
select d.doc_id, coalesce(m.q, -1) as "value" from documents d left join m using (text)""")
def lookup_last_wins(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"))
    labels = docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("value")), "doc_id")
    return J.lookup_last_wins(docs, labels, "k", [F.col("doc_id")], F.lit(-1)).select("doc_id", "value")


@query("""
with d as (select d.doc_id, d.source, l.quality from documents d left join labels l using (doc_id)),
k as (select source, doc_id kid, quality kq from d where quality is not null)
select d.doc_id, d.source, arg_min(k.kq, (abs(d.doc_id - k.kid), k.kid)) filled from d left join k on d.source = k.source group by 1, 2""")
def nearest_labelled_fill(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return O.nearest_fill(d.select("doc_id", "source", "quality"), "doc_id", "quality", "filled", ["source"]).select("doc_id", "source", "filled")


@query("""
with a as (select event_id, user_id, epoch_us(ts) us from events where event_type = 'purchase'),
b as (select user_id, epoch_us(ts) us, max(event_id) eid from events where event_type = 'view' group by 1, 2)
select a.event_id, a.user_id, arg_min(b.eid, (abs(a.us - b.us), b.us)) filter (abs(a.us - b.us) <= 7200000000) nearest
from a left join b on a.user_id = b.user_id group by 1, 2""")
def asof_tolerance(spark, sf):
    e = table(spark, sf, "events").withColumn("us", micros("ts"))
    right = e.where("event_type = 'view'").groupBy("user_id", "us").agg(F.max("event_id").alias("eid"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "us")
    return W.asof_nearest(left, right, "user_id", "us", "eid", 7_200_000_000, "nearest").select("event_id", "user_id", "nearest")


@query("""
select o_orderkey, o_custkey from orders o where exists (select 1 from lineitem where l_orderkey = o_orderkey
 and l_shipdate > o_orderdate + interval 30 day and l_shipdate < o_orderdate + interval 60 day)""")
def interval_semi(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", F.expr("o_orderdate + interval 30 days").alias("s"), F.expr("o_orderdate + interval 60 days").alias("e"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_shipdate")
    return J.interval_semi(o, li, "k", "s", "e", "l_shipdate").select(F.col("k").alias("o_orderkey"), "o_custkey")


@query("""
with t as (select event_type, epoch_us(ts) us from events where user_id % 7 = 0 group by 1, 2),
i as (select event_id, event_type, epoch_us(ts) us from events),
n as (select i.event_id, i.us, t.us nxt from i asof join t on i.event_type = t.event_type and i.us < t.us)
select event_id from n where nxt < us + 3600000000""")
def interval_hot_keys(spark, sf):
    """Events after which, within an hour, a watched user does the same; few kinds of event hold all rows."""
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", micros("ts").alias("us"))
    spans = e.select("event_id", "event_type", "us", (F.col("us") + 3_600_000_000).alias("until"))
    return O.intervals_with_instant(spans, e.where("user_id % 7 = 0"), "us", "until", "us", ["event_type"]).select("event_id")


_BOXES = "select p_partkey k, p_brand brand, p_size % 20 as x1, p_partkey % 17 as y1, p_size % 20 + 3 + p_partkey % 5 as x2, p_partkey % 17 + 2 + p_size % 4 as y2, p_partkey % 3 as kind from part"


@query(f"""
with b as ({_BOXES}), s as (select * from b where kind = 0), p as (select * from b where kind = 1),
c as (select s.k sk, p.k pk, (least(s.x2, p.x2 + 1) - greatest(s.x1, p.x1 - 1)) * (least(s.y2, p.y2 + 1) - greatest(s.y1, p.y1 - 1)) a,
 (s.x1 + s.x2 - p.x1 - p.x2) * (s.x1 + s.x2 - p.x1 - p.x2) + (s.y1 + s.y2 - p.y1 - p.y2) * (s.y1 + s.y2 - p.y1 - p.y2) d
 from s join p on s.brand = p.brand and least(s.x2, p.x2 + 1) > greatest(s.x1, p.x1 - 1) and least(s.y2, p.y2 + 1) > greatest(s.y1, p.y1 - 1))
select s.k as signal, coalesce(arg_min(pk, (-a, d, pk)), -1) picked, count(pk) candidates from s left join c on s.k = c.sk group by 1""")
def theta_best_pick(spark, sf):
    part = table(spark, sf, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    b = part.select(key.alias("k"), F.col("p_brand").alias("brand"), (size % 20).alias("x1"), (key % 17).alias("y1"), (size % 20 + 3 + key % 5).alias("x2"), (key % 17 + 2 + size % 4).alias("y2"), (key % 3).alias("kind"))
    s = b.where("kind = 0").select("brand", F.col("k").alias("signal"), *[F.col(c).alias(f"s{c}") for c in ("x1", "y1", "x2", "y2")])
    p = b.where("kind = 1").select(F.col("brand").alias("pbrand"), "k", "x1", "y1", "x2", "y2")
    w = F.least(F.col("sx2"), F.col("x2") + 1) - F.greatest(F.col("sx1"), F.col("x1") - 1)
    h = F.least(F.col("sy2"), F.col("y2") + 1) - F.greatest(F.col("sy1"), F.col("y1") - 1)
    dx, dy = (F.col(f"s{c}1") + F.col(f"s{c}2") - F.col(f"{c}1") - F.col(f"{c}2") for c in "xy")
    shape = ["brand", "sx1", "sy1", "sx2", "sy2"], ["pbrand", "x1", "y1", "x2", "y2"]
    return J.best_pick(s, p, (F.col("brand") == F.col("pbrand")) & (w > 0) & (h > 0), "signal", [-(w * h), dx * dx + dy * dy, F.col("k")], "k", -1, shape)


@query("select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def resume_anti(spark, sf):
    return J.resume(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("select count(*) missing from labels where doc_id not in (select doc_id from documents)")
def subset_check(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("missing"))


@query("select user_id from events group by 1 having count(distinct event_type) = (select count(distinct event_type) from events)")
def all_types_present(spark, sf):
    e = table(spark, sf, "events")
    members = e.agg(F.count_distinct("event_type").alias("m"))
    return e.groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).crossJoin(F.broadcast(members)).where("n = m").select("user_id")


@query("""
with c as (select p_partkey, r_name, x, md5('s1|' || p_partkey || '|' || r_name || '|' || x) h from part, region, (select unnest(['near', 'far', 'none']) x) where p_size > 45),
r as (select *, row_number() over (partition by p_partkey order by h, r_name, x) - 1 as ord from c)
select p_partkey, ord::int as "ord", r_name, x from r where ord < 3""")
def template_instantiate(spark, sf):
    words = spark.createDataFrame([("near",), ("far",), ("none",)], "x string")
    return J.instantiate(table(spark, sf, "part").where("p_size > 45").select("p_partkey"), [table(spark, sf, "region").select("r_name"), words], "s1", 3, "p_partkey")


@query("""
with u as (select c_custkey k, c_name as name, 1 pri from customer where c_acctbal > 0 union all select s_suppkey, s_name, 2 from supplier)
select k, arg_min(name, pri) as name, min(pri)::int pri from u group by 1""")
def two_layout_merge(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit(1).alias("pri"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit(2).alias("pri"))
    return J.priority_merge(a.union(b), ["k"], F.col("pri"))


@query("""
with w as (select l_partkey as p_partkey, l_orderkey * 10 + l_linenumber as ord from lineitem where l_quantity >= 50)
select ord, w.p_partkey, p_name from w join part using (p_partkey)""")
def batch_lookup(spark, sf):
    w = table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return J.batch_lookup(w, table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "ord").select("ord", "p_partkey", "p_name")


@query("""
select n_name, count(*) n from nation join part on contains(lower(p_type), rtrim(lower(left(n_name, 3)), 's')) group by 1""")
def fuzzy_match(spark, sf):
    n = table(spark, sf, "nation").select("n_name", F.rtrim(F.lower(F.substring("n_name", 1, 3)), F.lit("s")).alias("w"))
    types = table(spark, sf, "part").groupBy(F.lower("p_type").alias("t")).agg(F.count("*").alias("c"))
    return types.join(F.broadcast(n), F.contains(F.col("t"), F.col("w"))).groupBy("n_name").agg(F.sum("c").alias("n"))


@query("""
with u as (select doc_id, 'current' pool from documents where lang = 'en' union all select doc_id, 'prior' from documents where n_chars > 2000
 union all select doc_id, 'global' from labels where quality = 1)
select pool, count(*) n, count(distinct doc_id) ids from u group by 1""")
def pool_union(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    pools = [d.where("lang = 'en'").select("doc_id", F.lit("current").alias("pool")), d.where("n_chars > 2000").select("doc_id", F.lit("prior").alias("pool")), lab.where("quality = 1").select("doc_id", F.lit("global").alias("pool"))]
    return pools[0].unionAll(pools[1]).unionAll(pools[2]).groupBy("pool").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))


@query("""
select p_partkey, array_to_string(list_filter(string_split(p_type, ' '), lambda x: not list_contains(string_split(p_name, ' '), x)), ',') rest from part""")
def set_difference_list(spark, sf):
    rest = F.filter(F.split("p_type", " "), lambda x: ~F.array_contains(F.split("p_name", " "), x))
    return table(spark, sf, "part").select("p_partkey", F.array_join(rest, ",").alias("rest"))


@query("""
with u as (select o_custkey k, o_orderkey v, 1 w from orders union all select o_custkey, o_orderkey, 2 from orders where o_totalprice > 100000)
select k, arg_max(v, (w, v)) v, count(*) n from u group by 1""")
def merged_distinct(spark, sf):
    o = table(spark, sf, "orders")
    u = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.lit(1).alias("w")).unionAll(o.where("o_totalprice > 100000").select(F.col("o_custkey"), F.col("o_orderkey"), F.lit(2)))
    return u.groupBy("k").agg(F.max_by("v", F.struct("w", "v")).alias("v"), F.count("*").alias("n"))
