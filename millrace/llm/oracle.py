"""SQL for the queries that SQL can express, plainly, by another way than the operators."""

from __future__ import annotations

from .common import LOWER, SPACE_TOKEN, UPPER, WORD
from .licenses import COVERAGE, TEMPLATES, _postings, vocabulary

_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

#: All pairs that share a shingle are counted; components by recursion.
JACCARD = f"""with recursive w as (select doc_id, regexp_extract_all({_LOW}, '{SPACE_TOKEN}') w from documents),
 s as (select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) when len(w) > 0 then [array_to_string(w, ' ')] else [] end s from w),
 u as (select doc_id, len(s) n, unnest(s) x from s),
 l as (select a.doc_id a, b.doc_id b from u a join u b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
 r(doc_id, c) as (select doc_id, doc_id from documents union select l.b, r.c from r join l on l.a = r.doc_id)
 select doc_id, any_value(len(s.s))::bigint as n_shingles, min(c) as component_id from s join r using (doc_id) group by doc_id"""

#: Every window of an item's length is joined as text.
CONTAMINATION = f"""with d as (select doc_id, regexp_extract_all({_LOW}, '{WORD}') w from documents),
 b as (select item_id, regexp_extract_all({_LOW}, '{WORD}') w from benchmark where item_id is not null),
 v as (select item_id, w, least(13, len(w)) n from b where len(w) > 0),
 win as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') s from (select *, unnest(range(1, len(w) - n + 2)) i from v)),
 dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from win))),
 hit as (select doc_id, i, n, item_id from dw join win using (n, s)),
 pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by 1),
 own as (select doc_id, count(distinct item_id) n_items, array_to_string(list_sort(list_distinct(list(item_id::varchar))), ',') items from hit group by 1)
 select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join pos using (doc_id) left join own using (doc_id)"""

#: All pairs of vectors.
COSINE = """with recursive e as (select vec_id, embedding::double[] e from embeddings where embedding is not null),
 l as (select a.vec_id a, b.vec_id b from e a join e b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
 n as (select a vec_id, count(*) n from l group by 1), r(vec_id, c) as (select vec_id, vec_id from embeddings union select l.b, r.c from r join l on l.a = r.vec_id),
 m as (select vec_id, min(c) c from r group by 1)
 select vec_id, coalesce(n, 0)::bigint as n_links, c as component_id, vec_id = c as kept from m left join n using (vec_id)"""

#: The rule of ``queries.with_tool_calls`` said again; a call refers to one other at most, so its level is the length of its path.
TOOL_CALLS = """with recursive m as (select conv_id c, turn t, role, coalesce(text, '') x, conv_id + turn k from conversations),
 a as (select c, t, k, case when k % 11 = 0 then 'weather' when k % 3 = 0 then 'calculator' else 'search' end as name,
   'c' || case when c % 19 = 0 and t >= 3 then t - 2 else t end id, case when k % 7 = 0 then '"three"' else t::varchar end lim,
   case when c % 13 = 0 then 'c' || (case when t % 4 < 2 then t + 2 else t - 2 end) when t >= 2 and c % 3 = 0 then 'c' || (t - 2) end ref from m where role = 'assistant' and k % 29 <> 0),
 b as (select *, row_number() over (partition by c, id order by t) n, case when name = 'search' and k % 17 <> 0 then ref end need,
   case name when 'weather' then '{}' when 'calculator' then '{"expression":"' || c || '+' || t || '"' || case when k % 5 = 0 then ',"unit":"m"' else '' end || '}'
    else '{"limit":' || lim || case when k % 17 <> 0 then ',"query":"' || coalesce('$' || ref, 'turn ' || t) || '"' else '' end || '}' end args,
   case when name = 'weather' then 'unknown tool' when name = 'calculator' then case when k % 5 = 0 then 'unknown unit' end
    when k % 17 = 0 then 'missing query' when k % 7 = 0 then 'type of limit' when t > 6 then 'range of limit' end complaint from a),
 h as (select * from b where n = 1), e as (select h.c, h.id, h.need from h join h g on g.c = h.c and g.id = h.need),
 w(c, id, now, d) as (select c, id, id, 0 from h union all select w.c, w.id, e.need, d + 1 from w join e on e.c = w.c and e.id = w.now where d < 40),
 l as (select c, id, case when max(d) < 40 then max(d) end lv from w group by 1, 2),
 r as (select c, t, 'c' || case when c % 23 = 0 then t + 1 else t - 1 end id, length(x) n from m where role = 'user' and t > 0 and (c % 23 = 0 or c % 5 <> 0))
 select c as conv_id, t as turn, 0 as part, 'message' as kind, null::varchar as call_id, null::varchar as name, null::int as level, false as linked, null::varchar as problem, json_object('content', x, 'role', role)::varchar as canonical from m
 union all select c, t, 1, 'call', null, null, null, false, 'malformed', null from m where role = 'assistant' and k % 29 = 0
 union all select b.c, b.t, 1, 'call', b.id, b.name, (case when n = 1 then 2 * lv end)::int, n = 1 and q.id is not null,
  case when n > 1 then 'duplicate id' when complaint is not null then complaint when lv is null then 'cycle' when q.id is null then 'unanswered' end,
  '{"arguments":' || args || ',"id":"' || b.id || '","name":"' || name || '"}' from b join l on l.c = b.c and l.id = b.id left join (select distinct c, id from r) q on q.c = b.c and q.id = b.id
 union all select r.c, r.t, 1, 'result', r.id, h.name, (2 * lv + 1)::int, h.id is not null, case when h.id is null then 'orphan result' when r.t < h.t then 'result before its call' end,
  '{"content":' || r.n || ',"id":"' || r.id || '"}' from r left join h on h.c = r.c and h.id = r.id left join l on l.c = r.c and l.id = r.id"""

#: Every 400-byte window of every text is compared by its md5.
REPEATS = """with d as (select row_number() over () r, doc_id, encode(coalesce(text, '')) y from documents), e as (select *, hex(y) x, octet_length(y)::bigint n from d),
 w as (select r, i, md5_number(y[i + 1 : i + 400]) m from (select r, y, unnest(range(n - 399)) i from e)),
 s as (select r, i from w where m in (select m from w group by m having count(*) > 1)),
 g as (select r, i, sum(fresh) over (partition by r order by i) k from (select r, i, case when i <= lag(i) over (partition by r order by i) + 400 then 0 else 1 end fresh from s)),
 c as (select r, min(i) a, max(i) + 400 b from g group by r, k),
 p as (select r, coalesce(lag(b) over (partition by r order by a), 0) f, a t from c union all select r, max(b), 1000000000 from c group by r),
 o as (select r, string_agg(substr(x, 2 * f + 1, 2 * (t - f)), '' order by f) kept from p join e using (r) group by r),
 q as (select r, sum(b - a)::bigint gone, count(*) spans from c group by r)
 select doc_id, n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, x))) as kept_sha256 from e left join q using (r) left join o using (r)"""

#: Sources share all words by weight up to their cap; positions invert each source's demand.
MIXING = f"""with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{SPACE_TOKEN}')), 0)::bigint size, list_reduce(list_transform(string_split(md5(doc_id::varchar)[1:8], ''), lambda c: (instr('0123456789abcdef', c) - 1)::bigint), lambda a, b: a * 16 + b) % 512 bucket from documents),
 s as (select source, sum(size)::bigint ss, row_number() over (order by source is null, source) - 1 k from d group by 1),
 w as (select *, ([5.0, 2.0, 1.0]::double[])[k % 3 + 1] weight, ([-0.5, 0.0, 0.5]::double[])[k % 3 + 1] ramp, ss * 3.0::double own from s), a as (select *, own / weight cap from w),
 l as (select *, ((sum(ss) over ())::double - coalesce(sum(own) over (order by cap, source is null, source rows between unbounded preceding and 1 preceding), 0::double)) / sum(weight) over (order by cap, source is null, source rows between current row and unbounded following) level from a),
 x as (select min_by(level, cap) x from l where level <= cap), t as (select source, ss, ramp, coalesce(least(own, x * weight), own) target, coalesce(x * weight >= own, true) capped from l left join x on true),
 p as (select d.*, t.* exclude (source), coalesce(sum(size) over (partition by d.source order by bucket, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint b, case when capped then 3 else floor(target / greatest(ss, 1))::bigint end n from d join t on d.source is not distinct from t.source),
 q as (select *, n * size + greatest(0, least(size, round(target)::bigint - n * ss - b)) taken from p), r as (select *, case when size > 0 then ceil(taken / size)::int else 0 end passes from q)
 select doc_id, size, ss as source_size, target, taken::bigint as taken, source, passes, case when taken > 0 then list_transform(list_transform(range(greatest(passes, 1)), lambda e: least(1::double, (b + size / 2.0::double + e * ss) / target)),
  lambda u: case when ramp = 0 then u else (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u) - (1 - ramp)) / (2 * ramp) end) end as positions from r"""

_TEXT = ", ".join(f"({t}, '{label}', ' {key} ')" for t, (label, _, key) in enumerate(TEMPLATES))
_POSTINGS = ", ".join(f"('{w}', {t}, {p})" for w, t, p in _postings())
_VOCABULARY = ", ".join(f"('{w}')" for w in vocabulary())
#: Every place of a phrase, and every offset at which enough of a template's IDF agrees.
LICENCES = f"""with d as (select row_number() over () r, doc_id, regexp_extract_all({_LOW}, '{WORD}') w from documents), post(word, t, place) as (values {_POSTINGS}), tpl(t, label, phrase) as (values {_TEXT}), vocab(word) as (values {_VOCABULARY}),
 e as (select r, i - 1 pos, w[i] a, w[i + 1] b, w[i + 2] c from (select r, w, unnest(range(1, len(w) + 1)) i from d)),
 base as (select r, pos, case when a = 'mit' then 'mit' when a = 'apache' then 'apache' else 'gpl' end label from e where (a in ('mit', 'apache') and b = 'license') or (a = 'general' and b = 'public' and c = 'license')),
 df as (select word, count(distinct r) n from vocab left join e on a = word group by 1), idf as (select word, ln(1 + ((select count(*) from d) + 1)::double / (n + 1)) v from df),
 total as (select t, sum(v) total from post join idf using (word) group by 1),
 votes as (select r, t, sum(v) agreed from e join post on a = word join idf on idf.word = post.word group by r, t, pos - place),
 found as (select votes.r, label, agreed / total part from votes join total using (t) join tpl using (t) join d on d.r = votes.r where agreed >= {COVERAGE} * total and contains(' ' || array_to_string(w, ' ') || ' ', phrase)),
 more as (select r, list(label) labels, least(1.0, max(part)) covered from found group by 1), own as (select r, count(*) n, min(pos) a, max(pos) z, list(label) labels from base group by 1)
 select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_base, a::bigint as first_word, z::bigint as last_word, array_to_string(list_sort(list_distinct(coalesce(own.labels, []))), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(own.labels, []), coalesce(more.labels, [])))), ',') as labels, round(greatest(case when n > 0 then 1.0 else 0.0 end, coalesce(covered, 0)), 6)::double as score from d left join own using (r) left join more using (r)"""

#: Hexadecimal digits of a text as a number.
_HEX = "list_reduce(list_transform(string_split({}, ''), lambda c: (instr('0123456789abcdef', c) - 1)::bigint), lambda a, b: a * 16 + b)"

#: Units as one list, cut by slices.
FILL_IN_MIDDLE = f"""with d as (select doc_id, coalesce(text, '') x, sha256('42:' || coalesce(doc_id::varchar, '')) h, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') u from documents),
 k as (select doc_id, x, u, len(u) n, {_HEX.format("h[1:8]")} h1, {_HEX.format("h[9:16]")} h2, {_HEX.format("h[17:24]")} h3, {_HEX.format("h[25:32]")} h4 from d),
 f as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b, case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end form from k),
 p as (select *, array_to_string(u[1:a], '') pre, array_to_string(u[a + 1:b], '') mid, array_to_string(u[b + 1:], '') suf from f)
 select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre)::bigint end as prefix_chars, case when form <> 'plain' then length(mid)::bigint end as middle_chars,
  sha256(case form when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid else x end) as output_sha256, sha256(x) as restored_sha256 from p"""

_BYTE_STEP = "list_transform(range(256), lambda b: list_reduce(range(8), lambda r, i: case when r % 2 = 1 then xor(r // 2, 3988292384) else r // 2 end, b))"
_WORD_STEP = "list_reduce({}, lambda r, y: xor(r // 256, t[(xor(r, y) & 255) + 1]), {})"
#: The crc register goes on from word to word; each distinct run is hashed once.
IMPORTANCE = f"""with step as materialized (select {_BYTE_STEP} t),
 d as (select row_number() over () r, doc_id, regexp_extract_all({_LOW}, '{WORD}') w from documents),
 e as (select row_number() over () r, regexp_extract_all({_LOW}, '{WORD}') w from benchmark),
 seen as materialized (select 0 own, r, i, w[i] a, w[i + 1] b, w[i + 2] c from (select r, w, unnest(range(1, len(w) + 1)) i from d) union all select 1, r, i, w[i], w[i + 1], w[i + 2] from (select r, w, unnest(range(1, len(w) + 1)) i from e)),
 word as materialized (select a, list_transform(range(1, len(hex(encode(a))) + 1, 2), lambda i: ((instr('0123456789ABCDEF', hex(encode(a))[i]) - 1) * 16 + instr('0123456789ABCDEF', hex(encode(a))[i + 1]) - 1)::bigint) y from (select distinct a from seen)),
 one as materialized (select a, {_WORD_STEP.format("y", "4294967295")} v from word, step),
 two as materialized (select p.a, p.b, {_WORD_STEP.format("list_concat([32], y)", "v")} v from (select distinct a, b from seen where b is not null) p join one on one.a = p.a join word on word.a = p.b, step),
 three as materialized (select p.a, p.b, p.c, {_WORD_STEP.format("list_concat([32], y)", "v")} v from (select distinct a, b, c from seen where c is not null) p join two on two.a = p.a and two.b = p.b join word on word.a = p.c, step),
 hit as materialized (select own, r, xor(v, 4294967295) % 10000 k, count(*) n from (select own, r, v from seen join one using (a) union all select own, r, v from seen join two using (a, b) union all select own, r, v from seen join three using (a, b, c)) group by all),
 num as (select sum(n) filter (own = 0) s, sum(n) filter (own = 1) t from hit),
 gain as (select k, floor(1000 * ln((coalesce(sum(n) filter (own = 1), 0) + 1)::double * (coalesce(any_value(s), 0) + 10000)::double / ((coalesce(sum(n) filter (own = 0), 0) + 1)::double * (coalesce(any_value(t), 0) + 10000)::double)))::bigint g from hit, num group by k),
 x as (select r, sum(n * g)::bigint weight, sum(n)::bigint n from hit join gain using (k) where own = 0 group by r),
 y as (select doc_id, len(w) words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(({_HEX.format("sha256('42:' || coalesce(doc_id::varchar, ''))[1:8]")} + 0.5::double) / 4294967296::double)))::bigint as score from d left join x using (r)),
 z as (select *, row_number() over (partition by words >= 20 order by score desc, doc_id nulls first) rank, count(*) over (partition by words >= 20) of_all from y)
 select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score, case when words >= 20 and rank <= 5 * of_all // 100 then rank end as rank from z"""
