"""Order-dependent matching, average precision, model calls, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneqa.operators import coco
from sceneqa.operators import matching as M
from sceneqa.plans.label import complete, judged
from sceneqa.queries.registry import query
from sceneqa.sources.scratch import shared_dir
from sceneqa.sources.tables import table
from sceneqa.streaming.resume import append_once, hourly_counts, keep_last, last_rows, read_new


def _boxes(spark, sf):
    """Line items as true boxes, and shifted ones as predictions, one sample an order."""
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"))
    li = table(spark, sf, "lineitem").withColumn("idx", idx)
    q, n, s = F.col("l_quantity").cast("double"), F.col("l_linenumber"), F.col("l_suppkey")
    base = [F.col("l_orderkey").alias("sample"), F.col("idx"), (s % 6 + 1).cast("int").alias("view"), F.col("l_returnflag").alias("label")]
    d = (s % 9).cast("double")
    box = lambda side, dx: F.struct(F.lit(side).alias("side"), F.lit(1.0).alias("score"), (q + dx).alias("x1"), (n * 3.0).alias("y1"), (q + dx + 20).alias("x2"), (n * 3.0 + 15).alias("y2"))
    return li.select(*base, F.inline(F.array_compact(F.array(box("gt", 0), F.when(s % 5 != 0, box("pred", d))))))


_BOXES = """
b as (select l_orderkey sample, (row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice))::int idx, (l_suppkey % 6 + 1)::int v, l_returnflag f, l_quantity::double q, (l_suppkey % 9)::double d, l_linenumber * 3.0::double n, l_suppkey % 5 <> 0 seen from lineitem),
g as (select *, row_number() over (partition by sample order by idx) k from b)"""
#: True boxes in their order, each with the best predicted box of its label (and view) that none before it has.
_GREEDY = """
with recursive {boxes},
c as (select g.sample, g.idx, g.v, g.k, list({{'p': p.idx, 'v': p.v, 'i': x / (600 - x)}} order by x / (600 - x) desc, p.idx) filter (p.idx is not null) as best from g
 left join (select * from b where seen) p on p.sample = g.sample and p.f = g.f {view},
 lateral (select greatest(0.0, least(g.q + 20, p.q + p.d + 20) - greatest(g.q, p.q + p.d)) * greatest(0.0, least(g.n, p.n) + 15 - greatest(g.n, p.n)) as x) group by all),
m as (select sample, 0::bigint k, [0]::int[] used, 0 gt, 0 pred, 0.0::double iou, 0 vg, 0 vp from (select distinct sample from b)
 union all select sample, k, case when w is null then used else list_append(used, w.p) end, idx, coalesce(w.p, -1), coalesce(w.i, 0), v, coalesce(w.v, -1)
 from (select m.sample, c.k, m.used, c.idx, c.v, list_filter(c.best, lambda x: not list_contains(m.used, x.p))[1] w from m join c on c.sample = m.sample and c.k = m.k + 1)),
r as (select sample, gt, pred, iou, vg view_gt, vp view_pred from m where k > 0
 union all select b.sample, -1, b.idx, 0.0, -1, b.v from b where seen and not exists (select 1 from m where m.sample = b.sample and m.pred = b.idx and m.k > 0))
"""


@query(_GREEDY.format(boxes=_BOXES, view="and p.v = g.v") + "select sample, gt, pred, round(iou, 9) iou, view_gt, view_pred from r")
def greedy_match(spark, sf):
    return M.greedy_match(_boxes(spark, sf)).withColumn("iou", F.round("iou", 9))


@query(_GREEDY.format(boxes=_BOXES, view="") + "select view_gt, " + ", ".join(f"count(*) filter (view_pred = {v}) pred_{v}" for v in range(1, 7)) + " from r where gt >= 0 and pred >= 0 group by 1")
def view_confusion(spark, sf):
    return M.view_confusion(M.greedy_match(_boxes(spark, sf), by_view=False), [1, 2, 3, 4, 5, 6])


def _scored(spark, sf):
    """Line items as true boxes of many sizes, some of them crowds; shifted ones as predictions with ten scores, so with many ties."""
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"))
    li = table(spark, sf, "lineitem").withColumn("idx", idx)
    p, s, x, y = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("double"), F.col("l_linenumber") * 3.0
    w, h, d = 8 + p % 13 * 9, 6 + s % 11 * 12, s % 9
    base = [F.concat(F.lit("d"), F.col("l_orderkey") % 4).alias("dataset"), F.col("l_orderkey").alias("sample"), F.col("idx"), F.col("l_returnflag").alias("label")]
    box = lambda side, score, crowd, dx: F.struct(F.lit(side).alias("side"), score.alias("score"), crowd.alias("crowd"), (x + dx).alias("x1"), y.alias("y1"), (x + dx + w).alias("x2"), (y + h).alias("y2"))
    gt = box("gt", F.lit(None).cast("double"), p % 29 == 0, F.lit(0))
    pred = box("pred", (p * 7 + F.col("l_linenumber") * 13) % 10 / 10.0, F.lit(False), d)
    return li.select(*base, F.inline(F.array_compact(F.array(gt, F.when(s % 5 != 0, pred)))))


#: Predictions by falling score each take, per area a and threshold t, the first of their candidates (those that count first, then by overlap,
#: then the later one) that none before has; then precision over all samples.
_COCO = """
with recursive b as (select {dataset} ds, l_orderkey sample, (row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice))::int idx, l_returnflag f, l_quantity::double x,
 l_linenumber * 3.0::double y, (8 + l_partkey % 13 * 9)::double w, (6 + l_suppkey % 11 * 12)::double h, (l_suppkey % 9)::double d, l_suppkey % 5 <> 0 seen, ((l_partkey * 7 + l_linenumber * 13) % 10) / 10.0::double score, l_partkey % 29 = 0 crowd from lineitem),
ar as (select * from (values {areas}) t(a, lo, hi)), th as (select unnest([{thresholds}])::double t), uses as (select * from (values {uses}) t(a, most)),
p as (select *, row_number() over (partition by sample, f order by score desc, idx) r from b where seen),
pairs as (select p.sample, p.f, p.r, g.idx g, g.crowd, g.w * g.h area, c / case when g.crowd then p.w * p.h else p.w * p.h + g.w * g.h - c end i
 from p join b g on g.sample = p.sample and g.f = p.f, lateral (select greatest(0.0, least(g.x + g.w, p.x + p.d + p.w) - greatest(g.x, p.x + p.d)) * greatest(0.0, least(g.y + g.h, p.y + p.h) - greatest(g.y, p.y)) c) where c > 0),
cand as (select sample, f, r, a, list({{'g': g, 'i': i, 'crowd': crowd, 'ign': ign}} order by ign, i desc, g desc) best from (select *, crowd or area < lo or area > hi ign from pairs, ar) group by all),
c as (select p.ds, p.sample, p.f, p.r, p.score, ar.a, p.w * p.h between lo and hi inside, coalesce(best, []) best from p cross join ar left join cand on cand.sample = p.sample and cand.f = p.f and cand.r = p.r and cand.a = ar.a),
m as (select ds, sample, f, a, t, 0::bigint r, []::int[] used, 0.0::double score, null::boolean tp, null::boolean fp from (select distinct ds, sample, f, a from c), th
 union all select ds, sample, f, a, t, r, case when w is null then used else list_append(used, w.g) end, score, w is not null and not w.ign, w is null and inside
 from (select c.*, m.t, m.used, list_filter(c.best, lambda k: k.i >= m.t and (k.crowd or not list_contains(m.used, k.g)))[1] w from m join c on c.sample = m.sample and c.f = m.f and c.a = m.a and c.r = m.r + 1)),
n as (select ds, f, a, count(*) n from b, ar where not crowd and w * h >= lo and w * h <= hi group by all),
k as (select ds, f, m.a, most, t, tp, sum(tp::int) over o tps, count(*) over o seen from m join uses on uses.a = m.a and m.r <= most where m.r > 0 and (tp or fp) window o as (partition by ds, f, m.a, most, t order by score desc, sample, r)),
l as (select ds, f, a, most, t, case when round_even(100 * (tps / n), 0) * 0.01::double <= tps / n then round_even(100 * (tps / n), 0) else round_even(100 * (tps / n), 0) - 1 end lv, max(tps / seen) p, max(tps) tps from k join n using (ds, f, a) where tp group by all),
e as (select ds, f, a, most, t, sum(p) / 101 ap from (select ds, f, a, most, t, i, max(p) p from l, range(101) z(i) where lv >= i group by all) group by all),
q as (select ds, f, a, most, t, max(tps) tps from l group by all),
g as (select n.ds, n.f, n.a, most, t, n.n from n join uses on uses.a = n.a cross join th),
cv as (select ds, f, a, most, t, coalesce(ap, 0) ap, coalesce(tps, 0) / n recall, n n_gt from g left join e using (ds, f, a, most, t) left join q using (ds, f, a, most, t))
"""


def _coco_sql(dataset: str, areas: dict, thresholds, uses, tail: str) -> str:
    return _COCO.format(
        dataset=dataset, areas=", ".join(f"('{a}', {lo!r}::double, {hi!r}::double)" for a, (lo, hi) in areas.items()), thresholds=", ".join(f"{t!r}e0" for t in thresholds), uses=", ".join(f"('{a}', {m})" for a, m in uses)
    ) + tail


@query(_coco_sql("''", {"all": coco.AREAS["all"]}, (0.5, 0.75, 0.9), [("all", 100)], "select f as label, t as threshold, round(ap, 9) ap, n_gt from cv"))
def map_eval(spark, sf):
    return coco.detection_map(_scored(spark, sf), (0.5, 0.75, 0.9)).withColumn("ap", F.round("ap", 9))


_METRIC = "coalesce(round_even(1000 * avg({what}) filter (a = '{a}' and most = {most}{t}), 0) / 1000, -1) {name}"


@query(_coco_sql("'d' || (l_orderkey % 4)", coco.AREAS, coco.THRESHOLDS, dict.fromkeys((a, m) for a, m, _, _ in coco.METRICS.values()),
 "select ds as dataset, " + ", ".join(_METRIC.format(what="recall" if r else "ap", a=a, most=m, t=f" and t = {t}" if t else "", name=name) for name, (a, m, t, r) in coco.METRICS.items()) + " from cv group by 1")
)
def coco_eval(spark, sf):
    """Of each data set; the row of their means is left to the tests, as means of rounded values have no digits to compare."""
    return coco.summary(_scored(spark, sf)).where("dataset <> 'Average'")


@query("""
with c as (select conv_id * 1000 + turn id, length(text) n from conversations where role = 'user')
select id, case when n % 11 <> 0 then 'Yes' end as answer, (case when n % 11 = 0 then 3 else n % 3 + 1 end)::int attempts, case when n % 11 = 0 then 'stub failure' end as error from c""")
def llm_stub_pipeline(spark, sf):
    def stub():
        def answer(prompt: str, attempt: int) -> str:
            if len(prompt) % 11 == 0:
                raise ValueError("stub failure")
            return "Yes" if len(prompt) % 3 < attempt else ""

        return answer

    c = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return complete(c, "id", "text", stub, bool, inflight=8)


@query("""
with c as (select conv_id * 1000 + turn id, length(text) n from conversations where role = 'user')
select id, case when n % 2 = 0 then 'A' when n % 5 = 0 then 'Z' when n % 3 < 2 then 'B' else '' end as answer, case when n % 2 = 0 or n % 5 = 0 then 'rule' else 'judge' end as source,
 n % 2 = 0 or n % 5 <> 0 and n % 3 < 2 as extracted from c""")
def judge_after_rules(spark, sf):
    """Rules first; a judge for the rest, who fails on some whatever the attempt."""

    def judge():
        return lambda prompt, attempt: "B" if len(prompt) % 3 < min(attempt, 2) else ""

    c = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    n = F.length("text")
    return judged(c, "id", F.when(n % 2 == 0, "A").when(n % 5 == 0, "Z"), "text", judge, bool, tries=3)


@query("select time_bucket(interval 1 hour, ts)::varchar as hour, event_type, count(*) n from events group by 1, 2")
def hourly_windows(spark, sf):
    return hourly_counts(table(spark, sf, "events"), "ts").select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


@query("select user_id, event_type, max(event_id) event_id, arg_max(value, event_id) as \"value\" from events group by 1, 2")
def stream_last_rows(spark, sf):
    """The last row of each key, from a stream whose second half brings rows that are early, late and repeated."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    for rows in (events.where("event_id % 3 > 0"), events.where("event_id % 3 < 2")):
        rows.write.mode("append").parquet(f"{base}/in")
        stream = read_new(spark, f"{base}/in", "user_id bigint, event_type string, event_id bigint, value double")
        keep_last(stream, f"{base}/log", f"{base}/state", ["user_id", "event_type"], ["event_id"])
    return last_rows(spark.read.parquet(f"{base}/log"), ["user_id", "event_type"], ["event_id"])


@query("select event_id, user_id, event_type from events")
def stream_resume(spark, sf):
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, sf, "events").select("event_id", "user_id", "event_type").repartition(4, "event_id").write.parquet(f"{base}/in")
    for _ in range(2):  # the second run finds nothing new
        append_once(read_new(spark, f"{base}/in", "event_id bigint, user_id bigint, event_type string"), f"{base}/out", f"{base}/state", ["event_id"])
    return spark.read.parquet(f"{base}/out")
