"""Aggregations: shares, cross-tabs, accuracy, funnels, weights, forgetting, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneqa.operators import aggregates as A
from sceneqa.queries.registry import query
from sceneqa.sources.tables import table


@query("select lang, count(*) n, round(count(*) * 100.0::double / sum(count(*)) over (), 4) pct from documents group by lang")
def count_share(spark, sf):
    return A.share(table(spark, sf, "documents"), "lang")


@query("""
with c as (select o_orderpriority prio, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O",
 count(*) filter (o_orderstatus = 'P') as "P" from orders group by 1)
select prio as o_orderpriority, "F", "O", "P", "F" + "O" + "P" as total from c
union all select 'Total', sum("F")::bigint, sum("O")::bigint, sum("P")::bigint, sum("F" + "O" + "P")::bigint from c""")
def crosstab_totals(spark, sf):
    return A.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""
select l_returnflag, l_linestatus, l_shipmonth, count(*) n, sum(l_quantity)::decimal(38,2)::varchar q from
 (select l_returnflag, l_linestatus, month(l_shipdate)::int l_shipmonth, l_quantity::decimal(18,2) l_quantity from lineitem)
group by grouping sets ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus, l_shipmonth))""")
def multi_grouping(spark, sf):
    table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.month("l_shipdate").alias("l_shipmonth"), F.col("l_quantity").cast("decimal(18,2)").alias("l_quantity")).createOrReplaceTempView("_grouping_input")
    return spark.sql("""select l_returnflag, l_linestatus, l_shipmonth, count(*) n, cast(cast(sum(l_quantity) as decimal(38,2)) as string) q
     from _grouping_input group by grouping sets ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus, l_shipmonth))""")


@query("""
select d.lang, count(*) n, count(l.doc_id) labelled, count(*) filter (l.toxic = 1) toxic, count(*) filter (l.toxic = 1 and l.quality = 0) "both"
from documents d left join labels l using (doc_id) group by d.lang""")
def availability(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return df.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("both"))


@query("""
select coalesce(lang, 'Overall') lang, count(*) tot, sum(quality)::bigint hit, round(sum(quality) * 100.0::double / count(*), 4) rate
from documents join labels using (doc_id) group by rollup (lang)""")
def subject_accuracy(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return A.with_overall(df, "lang", F.count("*").alias("tot"), F.sum("quality").alias("hit"), F.round(F.sum("quality") * 100.0 / F.count("*"), 4).alias("rate"))


@query("""
select 'overall' grp, null::varchar val, count(*) n, sum(quality)::bigint hit from documents join labels using (doc_id)
union all select 'lang', lang, count(*), sum(quality)::bigint from documents join labels using (doc_id) group by lang
union all select 'source', source, count(*), sum(quality)::bigint from documents join labels using (doc_id) group by source""")
def accuracy_by_split(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    sets = df.groupingSets([(), ("lang",), ("source",)], "lang", "source").agg(F.grouping("lang").alias("a"), F.grouping("source").alias("b"), F.count("*").alias("n"), F.sum("quality").alias("hit"))
    grp = F.when(F.col("a") == 0, "lang").when(F.col("b") == 0, "source").otherwise("overall")
    return sets.select(grp.alias("grp"), F.coalesce("lang", "source").alias("val"), "n", "hit")


@query("""
select round(avg(m), 6) macro_quality, round(avg(t), 6) macro_toxic, count(*) categories from
 (select lang, avg(quality::double) m, avg(toxic::double) t from documents join labels using (doc_id) group by lang)""")
def macro_average(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    per = df.groupBy("lang").agg(F.avg("quality").alias("m"), F.avg("toxic").alias("t"))
    return per.agg(F.round(F.avg("m"), 6).alias("macro_quality"), F.round(F.avg("t"), 6).alias("macro_toxic"), F.count("*").alias("categories"))


@query("""
select outcome, count(*) n from (select case when text is null or trim(text) = '' then 'empty' when n_chars < 200 then 'short'
 when contains(text, '###') then 'junk' when contains(text, '|') then 'table' else 'kept' end outcome from documents) group by outcome""")
def drop_funnel(spark, sf):
    text = F.col("text")
    steps = [("empty", text.isNull() | (F.trim(text) == "")), ("short", F.col("n_chars") < 200), ("junk", F.contains(text, F.lit("###"))), ("table", F.contains(text, F.lit("|")))]
    return A.funnel(table(spark, sf, "documents"), steps).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""
with dim as (select unnest(['click', 'view', 'purchase', 'scroll', 'login', 'never']) event_type),
c as (select dim.event_type, count(e.event_id) n from dim left join events e using (event_type) group by 1),
r as (select event_type, n, (select sum(n) from c)::double / (6 * (n + 1)) w from c)
select event_type, n, round(w / (select avg(w) from r), 6) weight from r""")
def inverse_freq_weights(spark, sf):
    out = A.inverse_frequency(table(spark, sf, "events"), "event_type", ["click", "view", "purchase", "scroll", "login", "never"])
    return out.select("event_type", "n", F.round("weight", 6).alias("weight"))


_STAGES = "select event_type, dayofyear(ts) // 7 as stage, count(*) n, count(*) filter (value > 50) hit from events group by 1, 2"


def _stages(spark, sf):
    e = table(spark, sf, "events").withColumn("stage", F.expr("dayofyear(ts) div 7"))
    return e.groupBy("event_type", "stage").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("hit"))


@query(f"""
with s as (select event_type, stage, hit::double / n acc, max(stage) over (partition by event_type) last from ({_STAGES})),
f as (select event_type, max(acc) filter (stage < last) best, max(acc) filter (stage = last) final from s group by 1)
select event_type, round(best, 6) best, round(final, 6) final, round(best - final, 6) + 0.0 forgetting from f""")
def forgetting(spark, sf):
    s = _stages(spark, sf).withColumn("acc", F.col("hit") / F.col("n"))
    out = A.forgetting(s, "event_type", "stage", "acc")
    return out.select("event_type", F.round("best", 6).alias("best"), F.round("final", 6).alias("final"), (F.round("forgetting", 6) + 0.0).alias("forgetting"))


@query(f"select round(min(m), 6) collapse, count(*) stages from (select stage, avg(hit::double / n) m from ({_STAGES}) group by stage)")
def collapse_indicator(spark, sf):
    m = A.macro(_stages(spark, sf), ["stage"], "event_type", F.col("hit") / F.col("n"))
    return m.agg(F.round(F.min("macro"), 6).alias("collapse"), F.count("*").alias("stages"))


@query(f"""
select stage, max(n) filter (event_type = 'click') click, max(n) filter (event_type = 'view') "view", max(n) filter (event_type = 'login') login,
 sum(n)::bigint total from ({_STAGES}) group by stage""")
def stage_matrix(spark, sf):
    out = _stages(spark, sf).groupBy("stage").agg(*[F.max(F.when(F.col("event_type") == t, F.col("n"))).alias(t) for t in ("click", "view", "login")], F.sum("n").alias("total"))
    return out


@query("""
select l_returnflag, count(*) n, count(*) filter (l_discount > 0.05) hit, round(count(*) filter (l_discount > 0.05) / greatest(count(*), 1)::double, 6) rate
from lineitem group by l_returnflag""")
def partial_merge(spark, sf):
    shards = table(spark, sf, "lineitem").groupBy("l_returnflag", F.pmod("l_orderkey", F.lit(8)).alias("shard")).agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("hit"))
    merged = shards.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    return merged.withColumn("rate", F.round(F.col("hit") / F.greatest(F.col("n"), F.lit(1)), 6))


@query("""
select user_id, count(*) frames, count(distinct event_type) kinds, sum((value > 50)::int)::bigint risky from events group by user_id""")
def group_histogram(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("frames"), F.count_distinct("event_type").alias("kinds"), F.count_if(F.col("value") > 50).alias("risky"))


@query("""
select coalesce(r_name, '(none)') region, n_name nation, count(c_custkey) customers, count(*) filter (c_acctbal < 0) negative
from nation left join region on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1, 2""")
def fanout_with_empty(spark, sf):
    df = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return df.groupBy(F.coalesce("r_name", F.lit("(none)")).alias("region"), F.col("n_name").alias("nation")).agg(F.count("c_custkey").alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("negative"))
