"""Text and JSON scalars over documents, conversations, events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneqa.functions import messages as M
from sceneqa.functions import text as T
from sceneqa.queries.registry import query
from sceneqa.sources.tables import table


_R1 = [r"\bOBJ\s+\d+\s*\([^)]*\)", r"\(\s*OBJ\s+\d+(?:\s*,\s*(?:OBJ\s+)?\d+)*\s*\)", r"\bOBJs?\s+\d+(?:\s*,\s*(?:OBJ\s+)?\d+)*"]
_META = r"[^.!?\n]*\b(?:spatial data|OBJ IDs|OBJ ids|OBJ ID|OBJ id|object lists|object list|does not list|pre-computed|precomputed|prior knowledge|3D detection|3D object detection|provided object data|object detection data)\b[^.!?\n]*[.!?]?\s*"
_HEAD = "'See OBJ ' || (doc_id % 50) || ' (car, 3.5m ahead) and (obj 1, OBJ 2), OBJs 3, 4 here . The object list does not list it. No Object Lists? A spatial database and spatial dataset, '"


@query(rf"""
with a as (select doc_id, {_HEAD} || text t from documents where text is not null),
b as (select *, regexp_replace(t, '(?i){_R1[0]}', '', 'g') t1 from a), c as (select *, regexp_replace(t1, '(?i){_R1[1]}', '', 'g') t2 from b), d as (select *, regexp_replace(t2, '(?i){_R1[2]}', '', 'g') t3 from c),
e as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t3, '\(\s*\)', '', 'g'), ',\s*,', ',', 'g'), '\s{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g') t4 from d),
f as (select *, len(regexp_extract_all(t4, '(?i){_META}')) r2, regexp_replace(regexp_replace(regexp_replace(t4, '(?i){_META}', '', 'g'), '\s{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g') t5 from e),
g as (select *, case when r2 > 0 then t5 else t4 end t6 from f)
select doc_id, (len(regexp_extract_all(t, '(?i){_R1[0]}')) + len(regexp_extract_all(t1, '(?i){_R1[1]}')) + len(regexp_extract_all(t2, '(?i){_R1[2]}')))::int r1, r2::int r2,
 (len(regexp_extract_all(t6, '(?i)spatial database')) + len(regexp_extract_all(t6, '(?i)spatial dataset')))::int r3,
 md5(regexp_replace(regexp_replace(t6, '(?i)spatial database', 'scene', 'g'), '(?i)spatial dataset', 'scene', 'g')) h from g""")
def cleanse_rounds(spark, sf):
    """All three rounds over whole texts behind a sentence that each of them edits."""
    head = F.concat(F.lit("See OBJ "), (F.col("doc_id") % 50).cast("string"), F.lit(" (car, 3.5m ahead) and (obj 1, OBJ 2), OBJs 3, 4 here . The object list does not list it. No Object Lists? A spatial database and spatial dataset, "))
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.concat(head, F.col("text")).alias("t"))
    return T.cleansed(d, "t").select("doc_id", "r1", "r2", "r3", F.md5(F.col("t").cast("binary")).alias("h"))


@query(r"""
select doc_id, len(regexp_extract_all(text, '[#$%&*]{3}'))::int marks, len(regexp_extract_all(text, '(?i)\bthe\b'))::int "the",
 len(regexp_extract_all(text, '\n'))::int lines, len(regexp_extract_all(text, '[0-9a-f]{40}'))::int keys from documents""")
def regex_counts(spark, sf):
    n = lambda p: F.regexp_count("text", F.lit(p))
    return table(spark, sf, "documents").select("doc_id", n(r"[#$%&*]{3}").alias("marks"), n(r"(?i)\bthe\b").alias("the"), n(r"\n").alias("lines"), n("[0-9a-f]{40}").alias("keys"))


@query(r"""
select doc_id, md5(regexp_replace(text, '(?i)[^.!?\n]*\bidiot\b[^.!?\n]*[.!?]?', '[masked]', 'g')) masked, regexp_matches(text, '(?i)\bidiot\b') hit from documents""")
def near_mask(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.mask_near(F.col("text"), "idiot", "[masked]").cast("binary")).alias("masked"), F.col("text").rlike(r"(?i)\bidiot\b").alias("hit"))


@query(r"""
with b as (select conv_id, turn, text t, position(' - ' in text) p, regexp_extract(text, '(?s)^(.*?[.!?])(?:\s|$)', 1) s from conversations where role = 'assistant'),
h as (select *, case when p > 1 and p - 1 <= 400 then 'bullet' when length(s) > 0 and length(s) <= 200 then 'sentence' else 'whole' end how from b)
select conv_id, turn, how, md5(trim(case how when 'bullet' then left(t, p - 1) when 'sentence' then s else t end, ' ')) answer,
 length(trim(case how when 'bullet' then substring(t, p + 3) when 'sentence' then substring(t, length(s) + 1) else '' end, ' '))::int reasoning_chars from h""")
def answer_reasoning_split(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", T.split_answer(F.col("text")).alias("s"))
    return c.select("conv_id", "turn", "s.how", F.md5(F.col("s.answer").cast("binary")).alias("answer"), F.length("s.reasoning").alias("reasoning_chars"))


@query("""
select event_id, (props->>'k')::int k, coalesce((props->>'missing')::int, -1) missing, json_valid(props) ok from events""")
def json_props(spark, sf):
    v = F.try_parse_json("props")
    return table(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.coalesce(F.try_variant_get(v, "$.missing", "int"), F.lit(-1)).alias("missing"), v.isNotNull().alias("ok"))


@query(r"""
with t as (select conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(text, '[.()\[\],:;!*#{}]', ' ', 'g'), '\s+'), lambda x: x <> '') k, text from conversations),
f as (select conv_id, turn, text, k, list_distinct(list_filter(k, lambda x: x in ('A', 'B', 'C', 'D'))) l from t)
select conv_id, turn, case when contains(text, 'Failed to obtain answer via API') then null when contains(text, 'Sorry, I can''t help with images of people yet.') or contains(text, 'I can''t process this file.')
 or contains(text, 'I''m sorry, but without the image provided') or contains(text, 'Cannot determine the answer') then 'Z' when len(l) = 1 and not (list_contains(k, 'A') and len(k) > 3) then l[1] when len(l) = 0 and list_contains(k, 'Z') then 'Z' end opt from f""")
def option_infer(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.infer_option(F.col("text"), ["A", "B", "C", "D"]).alias("opt"))


@query(r"""
with v as (select o_orderkey, case o_orderkey % 4 when 0 then left(o_orderpriority, 1) || '.' when 1 then ' b, A c. ' when 2 then 'Yes..' else o_orderpriority end a from orders),
t as (select o_orderkey, regexp_replace(trim(a, ' '), '\.+$', '') t from v),
p as (select o_orderkey, t, list_filter(regexp_split_to_array(t, '[,;\s]+|\band\b'), lambda x: x <> '') l from t)
select o_orderkey, case when len(l) > 0 and len(list_filter(l, lambda x: not regexp_matches(x, '^[A-Za-z]$'))) = 0 then array_to_string(list_sort(list_transform(l, lambda x: upper(x))), ',') else lower(t) end norm from p""")
def normalize_answer(spark, sf):
    k, pr = F.col("o_orderkey") % 4, F.col("o_orderpriority")
    a = F.when(k == 0, F.concat(F.left(pr, F.lit(1)), F.lit("."))).when(k == 1, " b, A c. ").when(k == 2, "Yes..").otherwise(pr)
    return table(spark, sf, "orders").select("o_orderkey", T.normalize_answer(a).alias("norm"))


@query(r"""
with b as (select conv_id, turn, trim(text, ' ') t, case turn % 4 when 0 then 'open_ended' when 1 then 'y_or_n' when 2 then 'num_count' else 'distance' end ty from conversations)
select conv_id, turn, case when t = '' then 'empty' when ty = 'y_or_n' and not regexp_matches(lower(t), '^(yes|no)\b') then 'not yes or no'
 when ty = 'num_count' and not regexp_matches(lower(t), '^(\d+|zero|one|two|three|four|five|six|seven|eight|nine|ten)$') then 'not a count'
 when ty = 'distance' and not regexp_matches(t, '\d') then 'no digit' when ty = 'open_ended' and length(t) < 2 then 'too short' end reason from b""")
def contract_validate(spark, sf):
    ty = F.element_at(F.array(*[F.lit(x) for x in ("open_ended", "y_or_n", "num_count", "distance")]), (F.col("turn") % 4 + 1).cast("int"))
    none = F.lit(None).cast("map<string,string>")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.contract_reason(ty, F.col("text"), none).alias("reason"))


@query("""
with r as (select l_orderkey, l_linenumber, l_returnflag f, (l_suppkey % 7 + 1)::int v, l_quantity::int q, l_linenumber * 3 n from lineitem)
select l_orderkey, l_linenumber, v as image, case when l_linenumber % 2 = 0 then f else '' end as label, case when q < 45 then q || ',' || n || ',' || 45 || ',' || (n + 25) end as box, q < 45 as ok from r where v <= 6""")
def ref_render_parse(spark, sf):
    """Rendered groundings read back: from JSON replies, and from broken ones by their tokens (here without a label)."""
    q, n, v = F.col("l_quantity").cast("int"), F.col("l_linenumber"), (F.col("l_suppkey") % 7 + 1).cast("int")
    ref = T.render_ref(F.col("l_returnflag"), [q, n * 3, F.lit(45), n * 3 + 25])
    whole = F.to_json(F.struct(F.lit("x").alias("reasoning"), F.array(F.struct(v.alias("image_idx"), F.lit("Front").alias("camera"), ref.alias("ref"))).alias("grounding")))
    broken = F.concat(F.lit('{"image_idx": '), v.cast("string"), F.lit(", oops "), F.regexp_replace(ref, T.LABEL, ""))
    first = F.slice(T.parse_refs(F.when(n % 2 == 0, whole).otherwise(broken)), 1, 1)
    # exploded, as a filter on a projected column would parse the text once more
    out = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.explode_outer(first).alias("r")).where("r is not null")
    return out.select("l_orderkey", "l_linenumber", "r.image", "r.label", F.when(F.col("r.box").isNotNull(), F.array_join(F.transform("r.box", lambda x: x.cast("string")), ",")).alias("box"), "r.ok")


@query(r"""
with h as (select page_id, unnest(regexp_extract_all(html, '(?is)<p[^>]*>.*?</p>')) p from pages)
select page_id, count(*) blocks, sum(length(trim(regexp_replace(p, '<[^>]+>', '', 'g'), ' ')))::bigint chars from h group by 1""")
def section_split(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?is)<p[^>]*>.*?</p>"), F.lit(0))).alias("p"))
    return p.groupBy("page_id").agg(F.count("*").alias("blocks"), F.sum(F.length(F.trim(F.regexp_replace("p", "<[^>]+>", "")))).alias("chars"))


@query("""
select doc_id, md5(case when position('the' in text) > 0 then left(text, position('the' in text) - 1) || '[x]' || substring(text, position('the' in text) + 3) else text end) h from documents""")
def replace_first(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.replace_first(F.col("text"), "the", "[x]").cast("binary")).alias("h"))


@query("""select event_id, md5(user_id || '|' || event_type || '|' || event_id) token, printf('s%04d_t%03d_p%s_%s', user_id, event_id % 7, event_id::varchar, case when event_id % 2 = 0 then 'pos' else 'con' end) qa_id from events""")
def provenance_ids(spark, sf):
    return table(spark, sf, "events").select("event_id", T.md5_token(F.col("user_id"), F.col("event_type"), F.col("event_id")).alias("token"), T.provenance(F.col("user_id"), F.col("event_id") % 7, F.col("event_id"), F.col("event_id") % 2 == 0).alias("qa_id"))


@query(r"""
select page_id, 'root/' || regexp_replace(regexp_replace('./data/' || page_id || '/' || coalesce(regexp_extract(url, '[^/]+$'), ''), '^\./', ''), '^data/', '') path, regexp_extract(url, '://([^/]+)', 1) host from pages""")
def path_normalize(spark, sf):
    raw = F.concat(F.lit("./data/"), F.col("page_id").cast("string"), F.lit("/"), F.regexp_extract("url", "[^/]+$", 0))
    return table(spark, sf, "pages").select("page_id", T.normalize_path(raw, "root").alias("path"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"))


#: What display cleaning repairs, behind each text: no table has it.
_BROKEN = "a\uFFFD~F~R b::\n:\nx::y ENUUU ENU U e xxected Supplement TARY Featuree objectt s 1.5]]\n m 2]] m  \r\n\n\n\nend \t"


@query(r"""
with t as (select doc_id, text, regexp_replace(text || ?, '\r\n?', E'\n', 'g') x from documents),
a as (select *, replace(replace(regexp_replace(x, '\x{FFFD}~[^\s]{1,20}', '', 'g'), '::' || chr(10) || ':' || chr(10), ':' || chr(10)), '::', ':') y from t),
b as (select *, regexp_replace(regexp_replace(y, '\bENUU+\b', 'ENU', 'g'), '\bENU\s*U\b', 'ENU', 'g') z from a),
c as (select *, regexp_replace(regexp_replace(z, 'E\s*X+\s*X*\s*E\s*C\s*T\s*E\s*D', 'EXPECTED', 'gi'), 'SUPPLEMENT\s*T+\s*ARY', 'SUPPLEMENTARY', 'gi') v from b),
d as (select *, regexp_replace(regexp_replace(v, '\bfeaturee\b', 'feature', 'gi'), '\bobjectt\s*s\b', 'objects', 'gi') w from c),
e as (select *, regexp_replace(regexp_replace(regexp_replace(w, '\]\]\s*\n\s*m\b', '] m', 'g'), '\]\]\s*m\b', '] m', 'g'), '\n{3,}', E'\n\n', 'g') u from d)
select doc_id, md5(regexp_replace(regexp_replace(u, '(?m)[ \t]+$', '', 'g'), '^\s+|\s+$', '', 'g')) h, md5(regexp_replace(text, '[\x00-\x08\x0B-\x0C\x0E-\x1F]', '', 'g')) safe from e""".replace("?,", "'" + _BROKEN.replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "',"))
def clean_display(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(T.clean_display(F.concat("text", F.lit(_BROKEN))).cast("binary")).alias("h"), F.md5(T.strip_control(F.col("text")).cast("binary")).alias("safe"))


@query("""
select o_orderkey, case o_orderkey % 8 when 0 then o_orderkey % 3 = 1 when 1 then false when 2 then o_orderkey % 3 = 2 when 3 then false when 4 then false when 5 then true when 6 then false else o_orderkey % 3 = 0 end as correct from orders""")
def post_check(spark, sf):
    """Responses that name a letter, an article, a text, nothing or too much, and free ones, against their answers."""
    o = table(spark, sf, "orders").select("o_orderkey")
    k, third = F.col("o_orderkey") % 8, F.col("o_orderkey") % 3
    said = F.when(k == 0, "It is (B).").when(k == 1, "A car is on the road").when(k == 2, "the GREEN truck, I think").when(k == 3, "Cannot determine the answer").when(k == 4, "red or blue").when(k == 5, "0.5").when(k == 6, "0.51").otherwise("A")
    choices = F.when((k == 5) | (k == 6), F.array().cast("array<string>")).otherwise(F.array(F.lit("red"), F.lit("blue"), F.lit("green")))
    right = F.when((k == 5) | (k == 6), "1/2").otherwise(F.chr(third + 65))
    return o.select("o_orderkey", M.post_check(said, right, choices).alias("correct"))


@query("""
select conv_id, array_to_string(list(role || '. ' || n order by role), E'\\n') options from (select conv_id, role, count(*) n from conversations group by all) group by 1""".replace("E'\\n'", "chr(10)"))
def render_options(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.count("*").cast("string").alias("n"))
    m = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("m"))
    return m.select("conv_id", T.render_options(F.col("m")).alias("options"))
