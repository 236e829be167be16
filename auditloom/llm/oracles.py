"""DuckDB SQL for the operators that SQL can express on whole tables."""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [hash(array_to_string(w, ' '))] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i+4], ' ')))) end s from w),
g as (select doc_id, len(s) n, unnest(s) g from s), o as (select a.doc_id x, b.doc_id y, a.n nx, b.n ny, count(*) c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from o where 100 * c >= 75 * (nx + ny - c)), e as (select x, y from l union all select y, x from l),
r(doc_id, c) as (select doc_id, doc_id from documents union select r.doc_id, e.y from r join e on r.c = e.x)
select s.doc_id, len(s.s)::bigint n_shingles, min(r.c) component_id from s join r using (doc_id) group by all""",
    "op4_mtree": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v from embeddings),
s as (select a.vec_id query_id, b.vec_id, list_dot_product(a.v, b.v)::bigint score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int "rank", vec_id, score from s qualify "rank" <= 10""",
    "op8_warc_zstd": """
with p as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) h from pages), m as (select h, payload_bytes, max(page_id) last from p group by all)
select page_id, payload_bytes::bigint payload_bytes, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (j // 8)::int * 10 + 1, 10))::bigint >> (35 - 5 * (j % 8))::int) & 31) + 1)::int, 1)), '') payload_digest,
case when page_id = last then 'response' else 'revisit' end record_type, case when page_id <> last then last end refers_to from p join m using (h, payload_bytes)""",
    "op6_pfair_mix": """
with recursive d as (select *, coalesce('s' || source, 'n') key, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 4))::int h from documents),
z as (select key, count(*) n from d group by key), w as (select key, n, greatest(1, round(pow(n, 0.5) / (select sum(pow(n, 0.5)) from z) * 200))::bigint w from z),
s as (select list(key order by key) keys, list(w order by key) ws, sum(w)::bigint p, count(*) c from w),
r as (select 0::bigint t, list_transform(keys, lambda x: 0::bigint) done, 0::bigint pick, 0::bigint turn from s
 union all select t + 1, list_transform(range(1, c + 1), lambda i: case when i = q.i then done[i::int] + 1 else done[i::int] end), q.i, done[q.i::int] from
 (select r.t, r.done, s.c, list_min(list_filter(list_transform(range(1, c + 1), lambda i: case when floor(done[i::int] * p / ws[i::int]) <= t then {'d': ceil((done[i::int] + 1) * p / ws[i::int]), 'i': i} end), lambda x: x is not null)).i i from r, s where t < p) q),
m as (select keys[pick::int] key, turn, t - 1 slot from r, s where t > 0),
b as (select d.doc_id, d.source, d.key, w.w, w.n, p, row_number() over (partition by d.key order by h, doc_id, text) - 1 i from d join w using (key), s),
lack as (select min(p * (((n + 15) // 16) // w) + m.slot) full_ from w join m on m.key = w.key and m.turn = ((n + 15) // 16) % w, s)
select doc_id, source, i // 16 block, floor((i // 16) * p / w)::bigint "release", ceil((i // 16 + 1) * p / w)::bigint deadline, p * ((i // 16) // w) + m.slot slot, (i % 16)::int place, p * ((i // 16) // w) + m.slot < full_ exact
from b join m on m.key = b.key and m.turn = (i // 16) % w, lack""",
    "op11_walsh_audit": r"""
with l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by all),
d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
f as (select part, coalesce(good, false) good, coalesce(toxic, false) toxic, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
 + 4 * (100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(min(doc_id) over (partition by t) < doc_id, false)::int m from d left join l using (doc_id)),
c as (select part, m, count(*) n, count(*) filter (good) g, count(*) filter (toxic) x from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) k, unnest([1, 2, 4, 8, 16]) b),
o as (select a.k || b.k || c.k || d.k || e.k filter_order from x a, x b, x c, x d, x e where a.b | b.b | c.b | d.b | e.b = 31),
s as (select filter_order, step, x.b own, (select sum(y.b)::int from x y where instr(filter_order, y.k) < step) past, x.k from o, range(1, 6) r(step), x where x.k = substr(filter_order, step::int, 1)),
r as (select part, filter_order, step::int step, k, coalesce(sum(n) filter (m & (own | coalesce(past, 0)) = 0), 0)::bigint kept, coalesce(sum(n) filter (m & own <> 0 and m & coalesce(past, 0) = 0), 0)::bigint removed,
 coalesce(sum(n) filter (m & own <> 0 and m & coalesce(past, 0) <> 0), 0)::bigint redundant, coalesce(sum(n) filter (m = own), 0)::bigint unique_fails,
 coalesce(sum(g) filter (m & own <> 0 and m & coalesce(past, 0) = 0), 0)::bigint good_lost, coalesce(sum(x) filter (m & own <> 0 and m & coalesce(past, 0) = 0), 0)::bigint toxic_lost from c, s group by all)
select * exclude (k), (sum(removed) over (partition by part, k))::bigint shapley from r""",
    "op12_url_automaton": r"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end r from pages),
h as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') path from u),
k as (select unnest(['allow', 'block', 'allow', 'block', 'block']) v, unnest(['com', 'example.com', 'www.example.com', 'net', 'net']) h, unnest(['/', '/en/', '/en/', '/es/', '/fr/']) p),
b as (select h.*, (select max({'n': length(k.h || k.p), 'h': length(k.h), 'rule': k.h || k.p, 'v': k.v}) from k where (host = k.h or ends_with(host, '.' || k.h)) and starts_with(path, k.p)) k from h)
select page_id, host, path, k.rule "rule", coalesce(k.v, case when regexp_matches(host, 'spam|pills|casino|porn|warez') then 'block' else 'allow' end) verdict from b""",
    "op13_source_divergence": r"""
with d as (select row_number() over () i, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
t as (select i, lang, source, unnest(w) term from d), k as (select lang, term, count(*) n from t group by all having count(distinct i) >= 30),
c as (select lang, source, term, count(*) n from t semi join k using (lang, term) group by all), g as (select distinct lang, source from d),
v as (select lang, count(*) v, sum(n) n from k group by all), m as (select lang, source, sum(n) n from c group by all),
s as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 5) // (coalesce(m.n, 0) + 5 * v.v) p, 1 + 1000000000::hugeint * (k.n + 5) // (v.n + 5 * v.v) q
 from g join k using (lang) join v using (lang) left join c on (c.lang, c.source, c.term) = (g.lang, g.source, k.term) left join m on (m.lang, m.source) = (g.lang, g.source)),
a as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
x as (select g.lang, g.source, 'pair' part, h.source item, coalesce(f, 0)::bigint "value" from g join g h on g.lang = h.lang and g.source <> h.source left join a on (a.lang, a.source, a.item) = (g.lang, g.source, h.source)
 union all select lang, source, 'term', term, (p - q)::bigint from s where n > 0 and p > q)
select *, (row_number() over (partition by lang, source, part order by "value" desc, item))::int "rank" from x qualify part = 'pair' or "rank" <= 50""",
}
