"""Question-answer rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneqa.functions import geometry as G
from sceneqa.functions import messages as M
from sceneqa.functions import text_udf as U
from sceneqa.operators import qa as Q
from sceneqa.queries.registry import query
from sceneqa.sources.tables import table


@query(r"""
with c as (select conv_id, case conv_id % 4 when 0 then 'Observation' when 1 then 'Dynamic_Agents_and_Risk_Assessment' when 2 then 'Right_of_Way_and_Planning' else 'XYZ' end cat, conv_id % 5 = 0 gone,
 list(case when turn % 7 = 4 then ' ' else role end order by turn) t, count(*) n from conversations group by 1),
f as (select conv_id, len(list_filter(t, lambda x: trim(x, ' ') = '')) > 0 bad, n, gone, case cat when 'Observation' then 2 when 'XYZ' then 2 when 'Right_of_Way_and_Planning' then 5 else 4 end lo,
 case cat when 'Observation' then 4 when 'Dynamic_Agents_and_Risk_Assessment' then 6 else 8 end hi from c),
g as (select conv_id, case when bad then ['malformed_think'] else list_filter([case when gone and n > 2 then 'absent_band_violation' end, case when n <> 2 and (n < lo or n > hi) then 'band_violation' end], lambda x: x is not null) end l from f)
select conv_id, array_to_string(l, ',') flags, len(l) > 0 retry from g""")
def think_flags(spark, sf):
    step = F.when(F.col("turn") % 7 == 4, " ").otherwise(F.col("role"))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", step.alias("s")))), lambda x: x["s"]).alias("t"))
    k = F.col("conv_id") % 4
    cat = F.when(k == 0, "Observation").when(k == 1, "Dynamic_Agents_and_Risk_Assessment").when(k == 2, "Right_of_Way_and_Planning").otherwise("XYZ")
    flags = Q.think_flags(F.col("t"), cat, F.col("conv_id") % 5 == 0)
    return c.select("conv_id", F.array_join(flags, ",").alias("flags"), Q.needs_retry(flags).alias("retry"))


@query(r"""
with r as (select event_id, case event_id % 4 when 0 then 'achieved' when 1 then 'same_answer' when 2 then 'skipped' end said, event_id % 9 <> 0 answered, user_id % 2 p, user_id % 3 c from events),
k as (select *, case when answered and said in ('achieved', 'same_answer') then said end known from r)
select event_id, case when answered then known else 'skipped' end status,
 array_to_string(list_filter([case when not answered then 'answer_null_downgraded' end, case when answered and known is null then 'missing_contrast_status' end,
  case when known = 'achieved' and p = c or known = 'same_answer' and p <> c then 'status_mismatch' end], lambda x: x is not null), ',') flags from k""")
def contrast_status(spark, sf):
    k, u = F.col("event_id") % 4, F.col("user_id")
    said = F.when(k == 0, "achieved").when(k == 1, "same_answer").when(k == 2, "skipped")
    s = Q.contrast_status(said, F.col("event_id") % 9 != 0, u % 2, u % 3)
    return table(spark, sf, "events").select("event_id", s.alias("s")).select("event_id", "s.status", F.array_join("s.flags", ",").alias("flags"))


@query(r"""
with t as (select event_id, case event_id % 4 when 0 then 'It is the SAME answer. Forced to pick one' when 1 then 'both answers; cannot really find a good contrastive here' when 2 then 'the answer would not change' else 'nothing' end || '</think>no valid contrastive' r from events)
select event_id, (event_id % 4 in (0))::int * 1 + (event_id % 4 = 2)::int * 4 + (event_id % 4 = 1)::int * 8 + (event_id % 4 = 1)::int * 64 + (event_id % 4 = 0)::int * 256 as hits from t""")
def trap_markers(spark, sf):
    k = F.col("event_id") % 4
    text = F.when(k == 0, "It is the SAME answer. Forced to pick one").when(k == 1, "both answers; cannot really find a good contrastive here").when(k == 2, "the answer would not change").otherwise("nothing")
    found = Q.trap_markers(F.concat(text, F.lit("</think>no valid contrastive")))
    bits = F.aggregate(F.transform(found, lambda p: F.pow(F.lit(2.0), F.array_position(F.array(*[F.lit(t) for t in Q.TRAPS]), p) - 1).cast("int")), F.lit(0), lambda a, x: a + x)
    return table(spark, sf, "events").select("event_id", bits.alias("hits"))


@query("""
with r as (select event_id, user_id, case when event_id % 7 = 0 then null else event_type end src, event_type cat, case when "value" > 50 then 'high' end prior, case when event_id % 2 = 0 then 'yes' else 'no' end said from events),
g as (select user_id, coalesce(src, 'unknown') source, coalesce(cat, 'unknown') category, coalesce(prior, '?') prior_says, said vlm_says from r)
select source, category, prior_says, vlm_says, count(*) n, count(distinct user_id) samples from g group by grouping sets ((source), (category), (source, prior_says, vlm_says))""")
def disagreement_rollup(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("sample_idx"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("source"), F.col("event_type").alias("category"), F.when(F.col("value") > 50, "high").alias("prior_says"), F.when(F.col("event_id") % 2 == 0, "yes").otherwise("no").alias("vlm_says"))
    return Q.disagreements(rows)


@query("""
with r as (select event_id, case event_id % 7 when 0 then 'Pedestrian ' when 1 then 'tram' when 2 then '' else 'vehicle' end kind, event_id % 2 = 0 seen, event_type, "value" from events where event_id % 5 <> 0)
select event_id, case when lower(trim(kind)) in ('vehicle', 'pedestrian', 'other', 'not_a_signal') then lower(trim(kind)) else 'other' end kind, case when seen and event_type = 'click' then 'red' else 'unknown' end colour,
 case when seen and event_type = 'view' then 'arrow_left' else 'unknown' end shape, least(greatest("value" / 100, 0.0), 1.0) conf from r where kind <> ''""")
def signal_vocabulary(spark, sf):
    k, e = F.col("event_id") % 7, F.col("event_type")
    kind = F.when(k == 0, "Pedestrian ").when(k == 1, "tram").when(k == 2, "").otherwise("vehicle")
    label = Q.signal_label(F.when(F.col("event_id") % 5 != 0, kind), F.col("event_id") % 2 == 0, F.when(e == "click", " RED ").otherwise("mauve"), F.when(e == "view", "Arrow_Left").otherwise("star"), F.col("value") / 100)
    return table(spark, sf, "events").select("event_id", label.alias("s")).where("s is not null").select("event_id", "s.kind", "s.colour", "s.shape", F.col("s.confidence").alias("conf"))


@query("""
select coalesce(reason, 'kept') reason, count(*) n from (select case when "value" < 10 then 'score' when event_type = 'login' then 'not_a_signal' when user_id % 4 = 0 then 'rear' end reason from events) group by 1""")
def signal_filters(spark, sf):
    kind = F.when(F.col("event_type") == "login", "not_a_signal").otherwise("vehicle")
    return table(spark, sf, "events").select(F.coalesce(Q.drop_reason(F.col("value"), 10.0, kind, F.col("user_id") % 4 == 0), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("select event_id, user_id, last_value(case when event_type = 'login' then event_id end ignore nulls) over (partition by user_id order by event_id) tag from events")
def preceding_tag(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type") == "login", F.col("event_id")).alias("t"))
    return Q.preceding_tag(e, "user_id", "event_id", "t", "tag").select("event_id", "user_id", "tag")


@query("""select l_orderkey, l_linenumber, printf('train/%06d_c%d_s%03d.jpg', l_orderkey, l_suppkey % 6, l_linenumber) file from lineitem""")
def crop_manifest(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit("train").alias("split"), F.col("l_orderkey").alias("sample_idx"), (F.col("l_suppkey") % 6).alias("cam_idx"), F.col("l_linenumber").alias("sig_idx"))
    return Q.crop_manifest(li).select("l_orderkey", "l_linenumber", "file")


@query("""
select o_orderkey, case when honest > 0 and contrast > 0 then 'mixed' when honest > 0 then 'honest_same' when contrast > 0 then 'contrast_achieved' else 'no_comparable_pairs' end kind from
 (select l_orderkey o_orderkey, count(*) filter (l_returnflag = 'A') honest, count(*) filter (l_returnflag = 'R') contrast from lineitem group by 1)""")
def trap_class(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "A").alias("h"), F.count_if(F.col("l_returnflag") == "R").alias("c"))
    return g.select("o_orderkey", Q.trap_class(F.col("h"), F.col("c")).alias("kind"))


@query("""
select l_orderkey, l_linenumber, 'a [' || l_returnflag || '] and OBJ 99 at bbox[' || (l_linenumber * 2) || ',4,' || (l_quantity::int * 2) || ',8] of [' || l_returnflag || '] too' as edited from lineitem""")
def reference_edits(spark, sf):
    """References expand by a map of each row, then boxes in the text double: two callback edits in a row."""
    li = table(spark, sf, "lineitem")
    text = F.format_string("a OBJ %d (thing) and OBJ 99 at bbox[%d,2,%d,4] of OBJs %d, 98 too", "l_linenumber", "l_linenumber", F.col("l_quantity").cast("int"), "l_linenumber")
    names = F.to_json(F.create_map(F.col("l_linenumber").cast("string"), F.concat(F.lit("["), F.col("l_returnflag"), F.lit("]"))))
    expanded = U.expand_references(text, names)
    return li.select("l_orderkey", "l_linenumber", U.rescale_boxes(expanded, F.lit(2.0)).alias("r")).select("l_orderkey", "l_linenumber", F.col("r.text").alias("edited"))


@query("""
with r as (select l_orderkey, l_linenumber, l_suppkey % 6 + 1 v, l_linenumber * 10 x, l_suppkey % 3 k from lineitem),
t as (select *, 'The car (Image ' || v || ' (Front) bbox[' || x || ',2,' || (x + 9) || ',4]) ' as h from r)
select l_orderkey, l_linenumber, case k when 0 then h || 'is stopped near and stationary' when 1 then h || 'is moving and also in motion' else h || 'is driving, also in motion' end as edited,
 case k when 0 then 2 when 1 then 1 else 0 end::int as n from t""")
def motion_edits(spark, sf):
    """An object that stands still, one that moves, and one of unknown speed."""
    li = table(spark, sf, "lineitem")
    k, x, v = F.col("l_suppkey") % 3, F.col("l_linenumber") * 10, F.col("l_suppkey") % 6 + 1
    head = F.format_string("The car (Image %d (Front) bbox[%d,2,%d,4]) ", v, x, x + 9)
    text = F.concat(head, F.when(k == 1, "is Parked and also in motion").when(k == 0, "is driving near and in motion").otherwise("is driving, also in motion"))
    speeds = F.to_json(F.create_map(F.format_string("%d,%d,2,%d,4", v, x, x + 9), F.when(k == 0, 0.05).otherwise(3.0)))
    edited = U.correct_motion(text, F.when(k != 2, speeds))
    return li.select("l_orderkey", "l_linenumber", edited.alias("e")).select("l_orderkey", "l_linenumber", F.col("e.text").alias("edited"), "e.n")


@query("""
with p as (select p_partkey, p_size - 25 - 1.65::double x, (p_partkey % 21 - 10)::double y, radians((p_partkey % 90)::double) t, (p_partkey % 7 - 3)::double vx, (p_size % 5 - 2)::double vy, (p_partkey % 3 - 1)::double / 2 ax from part),
a as (select *, [{'u': 1.0::double, 'v': 0.0::double, 'r': 2.35 + 2 * abs(cos(t)) + abs(sin(t))}, {'u': 0.0, 'v': 1.0, 'r': 0.95 + 2 * abs(sin(t)) + abs(cos(t))},
 {'u': cos(t), 'v': sin(t), 'r': 2 + 2.35 * abs(cos(t)) + 0.95 * abs(sin(t))}, {'u': -sin(t), 'v': cos(t), 'r': 1 + 2.35 * abs(sin(t)) + 0.95 * abs(cos(t))}] n from p),
s as (select a.*, k * 0.05::double / 64 m, k from a, range(0, 12801) r(k)),
o as (select p_partkey, k, len(list_filter(n, lambda q: abs((x + vx * m + ax / 2 * m * m) * q.u + (y + vy * m) * q.v) > q.r + 0)) = 0 hit from s),
f as (select p_partkey, min(k) filter (hit and k % 64 = 0 and k > 0) k, bool_or(hit and k = 0) now from o group by 1)
select p_partkey, case when now then 0 when vx = 0 and vy = 0 and ax = 0 then null else (select min(o.k) from o where o.p_partkey = f.p_partkey and o.hit and o.k > f.k - 64 and o.k <= f.k) end::bigint steps from f join a using (p_partkey)""")
def ttc_accelerated(spark, sf):
    """Contact of turned boxes in accelerated motion, in steps of 1/1280 s."""
    d = lambda c: c.cast("double")
    ego = [F.lit(x) for x in (1.65, 0.0, 0.0, 2.35, 0.95)]
    other = [d(F.col("p_size") - 25), d(F.col("p_partkey") % 21 - 10), F.radians(d(F.col("p_partkey") % 90)), F.lit(2.0), F.lit(1.0)]
    v, a = [d(F.col("p_partkey") % 7 - 3), d(F.col("p_size") % 5 - 2)], [d(F.col("p_partkey") % 3 - 1) / 2, F.lit(0.0)]
    return table(spark, sf, "part").select("p_partkey", F.round(G.ttc_obb(ego, other, v, a) * 1280).cast("bigint").alias("steps"))


@query(r"""
with v as (select l_orderkey, l_linenumber, l_quantity::int q, l_linenumber % 5 k from lineitem)
select l_orderkey, l_linenumber, k = 0 or k = 1 or k = 2 and q % 2 = 0 or k = 3 as same from v""")
def math_equality(spark, sf):
    """Fractions, roots and powers in LaTeX or Python against plain numbers."""
    q, k = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 5
    a = F.when(k == 0, F.format_string("\\frac{%d}{4}", q)).when(k == 1, F.format_string("%d**2", q)).when(k == 2, F.format_string("%d", q)).when(k == 3, F.format_string("\\sqrt{%d}", q * q)).otherwise("x + 1")
    b = F.when(k == 0, (q / 4).cast("string")).when(k == 1, (q * q).cast("string")).when(k == 2, F.format_string("2 \\times %d", F.floor(q / 2).cast("int"))).when(k == 3, q.cast("string")).otherwise("1")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", M.math_equal(a, b).alias("same"))


@query("""
with p as (select p_partkey, p_size % 10 s, (p_partkey % 21 - 10)::double x, (p_size - 25)::double y from part),
d as (select s, p_partkey, sqrt(x * x + y * y) d, unnest(list_filter([case when x > 2 then 'ahead' when x < -2 then 'behind' end, case when y > 1 then 'left' when y < -1 then 'right' end], lambda z: z is not null)) direction from p)
select s, direction, arg_min(p_partkey, (d, p_partkey)) nearest from d group by all""")
def closest_per_direction(spark, sf):
    """The nearest object of each direction that its label names; one ahead and to the left stands for both."""
    x, y = (F.col("p_partkey") % 21 - 10).cast("double"), (F.col("p_size") - 25).cast("double")
    p = table(spark, sf, "part").select((F.col("p_size") % 10).alias("s"), "p_partkey", F.sqrt(x * x + y * y).alias("d"), F.explode(G.directions(G.relative_label(x, y))).alias("direction"))
    return p.groupBy("s", "direction").agg(F.min(F.struct("d", "p_partkey")).alias("m")).select("s", "direction", F.col("m.p_partkey").alias("nearest"))


@query("""
with l as (select l_orderkey k, l_linenumber n, l_orderkey % 5 s from lineitem)
select case s when 0 then '{"a":[' || n || ',{"x":null,"y":"Q"}],"b":' || k || '}' when 1 then case when n % 2 = 0 then '[1,2]' else '[2,1]' end when 2 then case when n % 2 = 0 then '{"a":null}' else '{}' end
 when 3 then 'yes it is' else case n % 3 when 0 then 'None' when 1 then 'True' else '7' end end as "key", count(*) n from l group by 1""")
def nested_answers(spark, sf):
    """Answers of every shape, objects with their keys in either order, by the key they compare by."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    s, even = F.col("k") % 5, F.col("n") % 2 == 0
    text = (
        F.when((s == 0) & even, F.format_string('{"b": %d, "a": [%d, {"y": "Q", "x": null}]}', "k", "n"))
        .when(s == 0, F.format_string('{"a": [%d, {"x": null, "y": "Q"}], "b": %d}', "n", "k"))
        .when(s == 1, F.when(even, "[1, 2]").otherwise("[2, 1]")).when(s == 2, F.when(even, '{"a": null}').otherwise("{}"))
        .when(s == 3, F.when(even, '"Yes it is "').otherwise('"yes IT is"'))
        .when(F.col("n") % 3 == 0, F.when(even, "null")).when(F.col("n") % 3 == 1, "true").when(even, '"7"').otherwise("7.0")
    )
    return li.select(Q.nested_key(F.parse_json(text)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
