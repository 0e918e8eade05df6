"""Nested rows: conversations, pairs, media, configuration; the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneqa.plans.postprocess import qa_pairs as pairs_of
from sceneqa.plans.postprocess import sft_plan
from sceneqa.queries.registry import query
from sceneqa.sources.tables import table


@query("""
select conv_id, count(*) turns, array_to_string(list(role order by turn), ',') roles, md5(array_to_string(list(text order by turn), '|')) joined, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::bigint words
from conversations group by 1""")
def conversation_assembly(spark, sf):
    c = table(spark, sf, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    g = c.groupBy("conv_id").agg(turns.alias("t"))
    words = F.aggregate(F.transform("t", lambda x: F.size(F.filter(F.split(x["text"], r"\s+"), lambda w: w != ""))), F.lit(0), lambda a, n: a + n)
    return g.select("conv_id", F.size("t").cast("bigint").alias("turns"), F.array_join(F.transform("t", lambda x: x["role"]), ",").alias("roles"), F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "|").cast("binary")).alias("joined"), words.cast("bigint").alias("words"))


@query("""
with l as (select conv_id, turn, role, md5(text) question, lead(role) over w nr, md5(lead(text) over w) answer from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, question, answer from l where role = 'user' and nr = 'assistant'""")
def qa_pairs(spark, sf):
    p = pairs_of(table(spark, sf, "conversations"))
    return p.select("conv_id", "turn", F.md5(F.col("question").cast("binary")).alias("question"), F.md5(F.col("answer").cast("binary")).alias("answer"))


@query(r"""
with l as (select conv_id, turn, role, text q, lead(role) over w nr, lead(text) over w a from conversations window w as (partition by conv_id order by turn)),
p as (select conv_id, turn, q, trim(regexp_replace(regexp_replace(regexp_replace(a, '\(\)', '', 'g'), ',,', ',', 'g'), '\s{2,}', ' ', 'g'), ' ') a from l where role = 'user' and nr = 'assistant'),
d as (select conv_id, turn, row_number() over (partition by md5(q), md5(a) order by conv_id, turn) k from p where q <> '' and a <> ''),
s as (select conv_id, turn, row_number() over (order by md5('sft|' || conv_id || '|' || turn), conv_id, turn) r, count(*) over () n from d where k = 1)
select case when r <= least(1000, n // 5) then 'val' else 'train' end split, count(*) n, round(count(*) * 100.0::double / sum(count(*)) over (), 4) pct from s group by 1""")
def sft_category_share(spark, sf):
    return sft_plan(table(spark, sf, "conversations"))


@query("""
select page_id, len(regexp_extract_all(html, '(?i)<img')) tags, page_id % 3 as expected,
 array_to_string(list_filter([case when len(regexp_extract_all(html, '(?i)<img')) < page_id % 3 then 'missing tags' end, case when len(regexp_extract_all(html, '(?i)<img')) > page_id % 3 then 'spare tags' end,
 case when len(regexp_extract_all(html, '(?i)<script')) > 0 then 'script' end], lambda x: x is not null), ',') problems from pages""")
def media_token_check(spark, sf):
    tags, scripts = (F.regexp_count("html", F.lit(p)).cast("bigint") for p in ("(?i)<img", "(?i)<script"))
    want = F.col("page_id") % 3
    problems = F.array_compact(F.array(F.when(tags < want, "missing tags"), F.when(tags > want, "spare tags"), F.when(scripts > 0, "script")))
    return table(spark, sf, "pages").select("page_id", tags.alias("tags"), want.alias("expected"), F.array_join(problems, ",").alias("problems"))


@query("""
select n_nationkey, coalesce(case when n_nationkey % 3 = 0 then n_name end, 'default') as name, coalesce(case when n_nationkey % 2 = 0 then n_regionkey end, 99) as region from nation""")
def config_merge(spark, sf):
    n = table(spark, sf, "nation")
    defaults = F.create_map(F.lit("name"), F.lit("default"), F.lit("region"), F.lit("99"))
    over = F.create_map(F.lit("name"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")), F.lit("region"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string")))
    held = F.map_filter(over, lambda _, v: v.isNotNull())
    merged = F.map_zip_with(defaults, held, lambda _, a, b: F.coalesce(b, a))
    return n.select("n_nationkey", F.element_at(merged, "name").alias("name"), F.element_at(merged, "region").cast("int").alias("region"))


@query("""
with t as (select conv_id, list({'r': role, 'x': case when role = 'assistant' then '[a] ' || text else text end} order by turn) l from conversations group by 1)
select conv_id, md5(array_to_string(list_transform(l, lambda e: e.x), '|')) edited from t""")
def nested_update(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    edited = F.transform("t", lambda x: F.when(x["role"] == "assistant", x.withField("text", F.concat(F.lit("[a] "), x["text"]))).otherwise(x))
    return c.select("conv_id", F.md5(F.array_join(F.transform(edited, lambda x: x["text"]), "|").cast("binary")).alias("edited"))


@query("""
with t as (select conv_id, turn, role, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) w from conversations)
select conv_id, (sum(w) * case when bool_or(role = 'system') then 1 else -1 end)::bigint signed_length from t group by 1""")
def modality_length(spark, sf):
    w = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(w).alias("w"), F.bool_or(F.col("role") == "system").alias("s"))
    return g.select("conv_id", F.when(F.col("s"), F.col("w")).otherwise(-F.col("w")).alias("signed_length"))


@query("""
with u as (select doc_id, lang, unnest([{'role': 'positive', 'v': n_chars}, {'role': 'contrastive', 'v': case when n_chars % 2 = 0 then n_chars // 2 end}]) b from documents)
select doc_id, lang, b.role as role, b.v as v from u where b.v is not null""")
def roles_unnest(spark, sf):
    blocks = F.array(F.struct(F.lit("positive").alias("role"), F.col("n_chars").alias("v")), F.struct(F.lit("contrastive").alias("role"), F.when(F.col("n_chars") % 2 == 0, F.expr("n_chars div 2")).alias("v")))
    return table(spark, sf, "documents").select("doc_id", "lang", F.inline(blocks)).where("v is not null")


@query("""
select lang, count(*) n, greatest(1, ceil(count(*) * 3.0::double / (4 * 2 * 8)))::int steps, round(coalesce(avg((n_chars > 1000)::int::double), 0.0), 6) grounded from documents group by 1""")
def stage_steps(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.ceil(F.count("*") * 3.0 / 64)).cast("int").alias("steps"), F.round(F.coalesce(F.avg((F.col("n_chars") > 1000).cast("double")), F.lit(0.0)), 6).alias("grounded"))


