"""DuckDB SQL of those queries that SQL can state.

The others need XXH64 over shingles (op1), quantised n-gram probabilities (op2), a tokenizer (op3, op9), hashed n-gram
models (op4), keyed permutations (op5) or a fitted model (op8); tests hold them against brute force.
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP6 = f"""
with d as (select doc_id, {_ALNUM} w from documents),
b as (select item_id::varchar item, {_ALNUM} w from benchmark),
win as (select distinct item, size, array_to_string(list_slice(w, s, s + size - 1), ' ') k from
 (select item, w, least(len(w), 10) size, unnest(range(1, len(w) - least(len(w), 10) + 2)) s from b where len(w) > 0)),
sizes as (select distinct size from win),
dwin as (select doc_id, size, s, array_to_string(list_slice(w, s, s + size - 1), ' ') k from
 (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) s from d, sizes where len(w) >= size)),
hit as (select doc_id, s, size, item from dwin join win using (size, k)),
words as (select doc_id, count(distinct i) n from (select doc_id, unnest(range(s, s + size)) i from hit) group by 1),
found as (select doc_id, list_sort(list(distinct item)) l from hit group by 1)
select d.doc_id, len(d.w)::bigint n_words, coalesce(words.n, 0)::bigint n_hit, coalesce(len(found.l), 0)::bigint n_items,
 sha256(coalesce(array_to_string(found.l, ','), '')) items_sha256, coalesce(words.n, 0) > 0 contaminated
from d left join words using (doc_id) left join found using (doc_id)"""

OP7 = f"""
with d as (select doc_id, {_WORDS} w from documents),
win as (select doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') k from (select doc_id, w, unnest(range(1, len(w) - 18)) s from d where len(w) >= 20)),
later as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) r from win) where r > 1),
gone as (select distinct doc_id, unnest(range(s, s + 20)) i from later),
words as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) i from d),
kept as (select words.doc_id, string_agg(x, ' ' order by words.i) t, count(*) n from words left join gone on words.doc_id = gone.doc_id and words.i = gone.i where gone.i is null group by 1)
select d.doc_id, len(d.w)::bigint n_words, (len(d.w) - coalesce(kept.n, 0))::bigint n_removed, sha256(coalesce(kept.t, '')) kept_sha256
from d left join kept using (doc_id)"""

OP10 = """
with recursive v as (select vec_id, embedding::double[] e from embeddings where embedding is not null and len(embedding) > 0
 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select vec_id a, vec_id b from embeddings union select reach.a, pairs.b from reach join pairs on reach.b = pairs.a)
select e.vec_id, (select count(*) from pairs where pairs.a = e.vec_id)::bigint n_links, min(r.b) component_id, min(r.b) = e.vec_id kept
from embeddings e join reach r on r.a = e.vec_id group by e.vec_id"""

#: The level of the targets is found from the sources that reach their cap, as prefix sums over cap / weight say.
OP11 = rf"""
with d as (select doc_id, source, len({_WORDS}) size, ('0x' || left(md5('mix|' || coalesce(doc_id::varchar, '')), 15))::bigint k from documents),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 r from d group by 1),
w as (select source, source_size, [5.0, 2.0, 1.0][r % 3 + 1]::double weight, source_size * 3.0::double cap, r from s),
u as (select *, sum(cap) over o caps, sum(weight) over o weights, sum(weight) over () allw, (sum(source_size) over ())::double total from w window o as (order by cap / weight, r rows unbounded preceding)),
l as (select (max(total) - coalesce(sum(cap) filter (held), 0)) / nullif(max(allw) - coalesce(sum(weight) filter (held), 0), 0) level from (select *, caps + cap / weight * (allw - weights) <= total held from u)),
t as (select source, source_size, least(cap, coalesce(level, 'infinity'::double) * weight) target from w, l),
b as (select *, case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 0 end epochs, floor(target + 0.5)::bigint budget from t),
p as (select doc_id, source, size, coalesce(sum(size) over (partition by source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint place from d)
select doc_id, size::bigint size, b.source_size, b.target, (epochs * size + greatest(0, least(size, budget - epochs * b.source_size - place)))::bigint taken, p.source, place, epochs::bigint epochs
from p join b on p.source is not distinct from b.source"""

#: crc32 of the decimal doc_id from a table of its 256 steps; lags from pairs of places of a word; islands by the difference of
#: a match's place and its rank.
OP12 = rf"""
with recursive steps as (select i, i c, 0 b from range(256) t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b + 1 from steps where b < 8),
crc as (select list(c order by i) t from steps where b = 8),
d0 as (select row_number() over () row, doc_id, {_WORDS} w, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])) x from documents, crc),
d1 as (select row, doc_id, w, len(w) n, case when doc_id is not null then xor(x, 4294967295) end h from d0),
d2 as (select *, (h // 10) % n a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) p from d1 where h % 10 = 0 and n > 0),
d as (select row, doc_id, n, w from d1 where not coalesce(h % 10 = 0 and n > 0, false) union all select row, doc_id, n, list_concat(w[:a], list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1])) from d2),
words as (select row, n, unnest(w) x, unnest(range(n)) i from d),
hits as (select a.row, b.i - a.i q, a.i from words a join words b on a.row = b.row and a.x = b.x and b.i > a.i and b.i - a.i <= a.n // 3),
isl as (select row, q, min(i) s, max(i) + 1 + q e, count(*) m from (select *, i - row_number() over (partition by row, q order by i) g from hits) group by row, q, g having count(*) >= greatest(24 - q, 2 * q)),
runs as (select row, s, e - s length, min(q) period from isl group by row, s, e),
best as (select row, count(*) n_runs, arg_min({{'s': s, 'l': length, 'p': period}}, (-(length::double / period), s, period)) b, string_agg(s || ',' || length || ',' || period || chr(10), '' order by s, period) t from runs group by 1),
gone as (select distinct row, unnest(range(s + period, s + length)) i from runs),
kept as (select words.row, string_agg(x, ' ' order by words.i) t from words left join gone on words.row = gone.row and words.i = gone.i where gone.i is null group by 1)
select d.doc_id, coalesce(best.n_runs, 0) n_runs, b.s::bigint as start, b.l::bigint as length, b.p::bigint as period, (1000 * b.l // b.p)::bigint exponent_milli, sha256(coalesce(best.t, '')) runs_sha256, sha256(coalesce(kept.t, '')) collapsed_sha256
from d left join best using (row) left join kept using (row)"""

#: Survivors of every prefix of every order, counted anew for each.
OP13 = rf"""
with t as (select doc_id, coalesce(lang, '') part, coalesce(text, '') text, {_WORDS} w from documents),
m as (select text, min(doc_id) first from t group by 1),
f as (select part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] fails,
 coalesce(good, false) good, coalesce(toxic, false) toxic
 from t join m using (text) left join (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels where doc_id is not null group by 1) l using (doc_id)),
i as (select unnest(range(1, 6)) i),
o as (select [a.i, b.i, c.i, d.i, e.i] o from i a, i b, i c, i d, i e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
g as (select part, fails, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from f group by all),
s as (select g.*, o, step, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') filter_order, o[step] k, list_bool_or([fails[x] for x in o[:step - 1]]) gone from g, o, unnest(range(1, 6)) z(step)),
r as (select part, filter_order, step, k, sum(n) filter (not coalesce(gone, false) and not fails[k]) kept, sum(n) filter (not coalesce(gone, false) and fails[k]) removed, sum(n) filter (coalesce(gone, false) and fails[k]) redundant,
 sum(n) filter (fails[k] and len(list_filter(fails, lambda x: x)) = 1) unique_fails, sum(good) filter (not coalesce(gone, false) and fails[k]) good_lost, sum(toxic) filter (not coalesce(gone, false) and fails[k]) toxic_lost from s group by all)
select part, filter_order, step::int step, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant, coalesce(unique_fails, 0)::bigint unique_fails, coalesce(good_lost, 0)::bigint good_lost,
 coalesce(toxic_lost, 0)::bigint toxic_lost, coalesce(sum(removed) over (partition by part, k), 0)::bigint shapley from r"""

SQL = {"op6_decontamination": OP6, "op7_substrings": OP7, "op10_vectors": OP10, "op11_mixing": OP11, "op12_periodic": OP12, "op13_interaction": OP13}
