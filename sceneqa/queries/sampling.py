"""Samples, splits, shards, pools, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneqa.operators import records as R
from sceneqa.operators import sampling as S
from sceneqa.queries.registry import query
from sceneqa.sources.tables import table


@query("""
with r as (select doc_id, lang, row_number() over (partition by lang order by md5('42|' || lang || '|' || doc_id), doc_id) k from documents)
select doc_id, lang from r where k <= 20""")
def stratified_subset(spark, sf):
    return S.stratified(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 20, "42")


@query("""
with r as (select doc_id, lang, row_number() over (partition by lang order by md5('7|' || lang || '|' || doc_id), doc_id) k, count(*) over (partition by lang) n from documents)
select doc_id, lang, case when k <= least(60, n // 5) then 'val' else 'train' end split from r""")
def train_val_split(spark, sf):
    return S.train_val(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 60, "7")


@query("""
with l as (select l_orderkey * 10 + l_linenumber id from lineitem), r as (select id, row_number() over (order by md5('p|' || id), id) k, count(*) over () n from l)
select id from r where k <= greatest(1, n * 7 // 100)""")
def percent_sample(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return S.percent(li, "id", 7, "p")


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey % 8 = 3")
def modulo_shard(spark, sf):
    return S.shard(table(spark, sf, "lineitem"), "l_orderkey", 8, 3).select("l_orderkey", "l_linenumber")


_POOLED = "select doc_id, lang, case when source in ('src0', 'src1') then 'current' when n_chars > 2000 then 'prior' else 'global' end pool from documents"


@query(f"""
with c as (select pool, lang, count(*) n, list_position(['current', 'prior', 'global'], pool) o from ({_POOLED}) group by all)
select pool, lang, n, coalesce(sum(n) over (order by o, lang rows between unbounded preceding and 1 preceding), 0)::bigint as start from c""")
def pool_plan(spark, sf):
    pool = F.when(F.col("source").isin("src0", "src1"), "current").when(F.col("n_chars") > 2000, "prior").otherwise("global")
    return S.pool_plan(table(spark, sf, "documents").select("lang", pool.alias("pool")), "pool", "lang", ["current", "prior", "global"])


@query("""
with v as (select lang, unnest(list_distinct([doc_id % 6 + 1, n_chars % 6 + 1])) as "view" from documents)
select "view", lang, count(*) n from v group by all having count(*) >= 20""")
def view_buckets(spark, sf):
    views = F.array(F.col("doc_id") % 6 + 1, F.col("n_chars") % 6 + 1)
    return S.view_buckets(table(spark, sf, "documents"), views, "lang", 20)


def _uniform(seed: int, key: str, what: str) -> str:
    return f"('0x' || left(md5('{seed}|' || {key} || '|{what}'), 8))::ubigint::double / 4294967296"


@query(f"""
with p as (select lang category, count(*) n, row_number() over (order by lang) - 1 k, count(*) over () m from documents group by 1),
d as (select i draw, floor({_uniform(11, "i", "category")} * (select max(m) from p))::int k, {_uniform(11, "i", "row")} v from range(20000) r(i))
select draw, category, floor(v * n)::bigint as "row" from d join p using (k)""")
def two_stage_draw(spark, sf):
    plan = table(spark, sf, "documents").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"))
    return S.two_stage_draw(plan, 20_000, 11)


@query(f"""
with b as (select ("view" % 3)::bigint v, lang category, count(*) n from (select doc_id % 6 + 1 as "view", lang from documents) group by all),
p as (select *, row_number() over (partition by v order by category) - 1 k, count(*) over (partition by v) m from b),
d as (select i draw, case when {_uniform(5, "i", "view")} < 0.2 then 0 when {_uniform(5, "i", "view")} < 0.5 then 1 else 2 end v, {_uniform(5, "i", "category")} c, {_uniform(5, "i", "row")} r from range(8000) t(i))
select draw, v as "view", category, floor(r * n)::bigint as "row" from d join p using (v) where p.k = floor(c * m)::int""")
def three_stage_draw(spark, sf):
    buckets = table(spark, sf, "documents").groupBy(((F.col("doc_id") % 6 + 1) % 3).cast("bigint").alias("view"), F.col("lang").alias("category")).agg(F.count("*").alias("n"))
    return R.three_stage_draw(buckets, {0: 2.0, 1: 3.0, 2: 5.0}, 8_000, 5)


@query(f"""
select doc_id, case when {_uniform(3, "doc_id", "replay")} < 0.3 then 'prior' when {_uniform(3, "doc_id", "floor")} < 0.25 then 'global' else 'current' end pool from documents""")
def composite_pool(spark, sf):
    return R.composite_pool(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.3, 0.25, 3)


@query("""
with recursive d as (select doc_id key, n_chars size, (row_number() over (order by doc_id nulls first, n_chars nulls first) - 1) // 256 batch from documents),
o as (select *, row_number() over (partition by batch order by size desc nulls first, key nulls first) k from d),
p as (select distinct batch, 0::bigint k, []::bigint[] room, 0::bigint bin, 0::bigint key, 0::bigint size from o union all
 select batch, k, case when b > 0 then list_concat(list_append(room[:b - 1], room[b] - size), room[b + 1:]) else list_append(room, case when size is null then 0 else greatest(4096, size) - size end) end, case when b > 0 then b - 1 else len(room) end, key, size
 from (select o.batch, o.k, p.room, o.key, o.size, coalesce(list_position(list_transform(p.room, lambda r: coalesce(r >= o.size, false)), true), 0) b from p join o on o.batch = p.batch and o.k = p.k + 1))
select batch, bin, key, size from p where k > 0""")
def bin_pack(spark, sf):
    return S.bin_pack(table(spark, sf, "documents"), "doc_id", "n_chars", 4096)


@query("""
with g as (select l_orderkey, list(l_linenumber order by l_suppkey % 6, -l_quantity::int, l_linenumber) l from lineitem group by 1)
select l_orderkey, array_to_string(l, ',') lines from g""")
def canonical_sort(spark, sf):
    li = table(spark, sf, "lineitem")
    items = F.array_sort(F.collect_list(F.struct((F.col("l_suppkey") % 6).alias("a"), (-F.col("l_quantity").cast("int")).alias("b"), F.col("l_linenumber").alias("c"))))
    return li.groupBy("l_orderkey").agg(items.alias("s")).select("l_orderkey", F.array_join(F.transform("s", lambda x: x["c"].cast("string")), ",").alias("lines"))


@query("""
with g as (select l_orderkey, l_quantity >= lag(l_quantity) over (partition by l_orderkey order by l_linenumber, l_quantity) ok from lineitem)
select l_orderkey, bool_and(coalesce(ok, true)) as canonical from g group by 1""")
def sortedness(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"]).alias("q"))
    pairs = F.arrays_zip(F.col("q").alias("a"), F.slice("q", 2, F.size("q")).alias("b"))
    return li.select("l_orderkey", F.forall(pairs, lambda p: p["b"].isNull() | (p["a"] <= p["b"])).alias("canonical"))


@query("""
select lang, q, row_number() over (order by q asc nulls last, n desc, lang)::int as rank from (select lang, round(avg(quality::double), 6) q, count(*) n from documents left join labels using (doc_id) group by 1)""")
def master_sort(spark, sf):
    g = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("q"), F.count("*").alias("n"))
    from pyspark.sql import Window

    return g.select("lang", "q", F.row_number().over(Window.orderBy(F.col("q").asc_nulls_last(), F.desc("n"), "lang")).alias("rank"))
