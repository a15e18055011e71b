"""DuckDB twins of the registered queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

#: Turns, loss and length of the formatted string follow from the rows: a turn adds 3 + 1 + 1 + 4 characters of
#: template, and each of the four escaped characters one more.
ORACLE["op4_chat_format"] = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o as (select *, row_number() over (partition by conv_id order by turn, role, text) as k from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(9 + 2 * length(role) + 2 * length(text) - length(translate(role, '\<[]', '')) - length(translate(text, '\<[]', ''))) as bigint) as formatted_chars
from o group by conv_id
"""

_SP = r"[\x20\x09-\x0D]+"
ORACLE["op1_quality_rules"] = r"""
with d as (
  select doc_id, lang, source, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents
), r as (
  select row_number() over () as rid, doc_id, lang, source, cast(len(w) as bigint) as n_words,
    cast(length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as bigint) as word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, w
  from d
), wi as (
  select rid, i, array_to_string(w[i:i+7], ' ') as s from (select rid, w, unnest(range(1, len(w) - 6)) as i from r where len(w) >= 8)
), hit as (
  select rid, i from (select rid, i, count(*) over (partition by rid, s) as c from wi) where c > 1
), cov as (
  select rid, cast(sum(least(8, coalesce(nxt - i, 8))) as bigint) as n_repeat_words
  from (select rid, i, lead(i) over (partition by rid order by i) as nxt from hit) group by rid
), m as (
  select r.rid, doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from r left join cov on r.rid = cov.rid
), q as (
  select *, case when word_chars > 0 then n_symbols / word_chars end as symbol_ratio,
    case when n_lines > 0 then n_dup_lines / n_lines end as dup_line_ratio,
    case when n_words > 0 then n_repeat_words / n_words end as repeat_ratio,
    case when n_words > 0 then word_chars / n_words end as word_length
  from m
), lng as (
  select lang, source, metric, x from q, lateral (values ('symbol_ratio', symbol_ratio, 0.02), ('dup_line_ratio', dup_line_ratio, 0.1),
    ('repeat_ratio', repeat_ratio, 0.05), ('word_length', word_length, 0.6)) v(metric, x, flr) where x is not null
), sk as (
  select lang, source, metric, case when x < 1e-6 then -10000 else cast(ceil(ln(x) / ln(1.01 / 0.99)) as integer) end as b, count(*) as n
  from lng group by all
), lev as (
  select 1 as lv, lang, source, metric, b, sum(n) as n from sk group by all
  union all select 2, lang, null, metric, b, sum(n) from sk group by all
  union all select 3, null, null, metric, b, sum(n) from sk group by all
), cum as (
  select *, sum(n) over (partition by lv, lang, source, metric order by b) as c, sum(n) over (partition by lv, lang, source, metric) as total,
    case when b = -10000 then 0.0 else 2 * pow(1.01 / 0.99, b) / (1.01 / 0.99 + 1) end as v
  from lev
), qt as (
  select lv, lang, source, metric, max(total) as docs, min(case when c >= 0.25 * total then v end) as q25, min(case when c >= 0.75 * total then v end) as q75
  from cum group by all
), lim as (
  select g.lang, g.source, g.metric, coalesce(o.q25, s.q25, e.q25) as lo, coalesce(o.q75, s.q75, e.q75) as hi,
    3.0 * greatest(hi - lo, case g.metric when 'symbol_ratio' then 0.02 when 'dup_line_ratio' then 0.1 when 'repeat_ratio' then 0.05 else 0.6 end) as sp
  from (select distinct lang, source, metric from sk) g
  left join qt o on o.lv = 1 and o.lang is not distinct from g.lang and o.source is not distinct from g.source and o.metric = g.metric and o.docs >= 100
  left join qt s on s.lv = 2 and s.lang is not distinct from g.lang and s.metric = g.metric and s.docs >= 100
  left join qt e on e.lv = 3 and e.metric = g.metric
), f as (
  select lang, source, max(case when metric = 'symbol_ratio' then hi + sp end) as a, max(case when metric = 'dup_line_ratio' then hi + sp end) as b,
    max(case when metric = 'repeat_ratio' then hi + sp end) as c, max(case when metric = 'word_length' then hi + sp end) as d,
    max(case when metric = 'word_length' then lo - sp end) as e
  from lim group by lang, source
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and coalesce(symbol_ratio <= a, true) and coalesce(dup_line_ratio <= b, true)
    and coalesce(repeat_ratio <= c, true) and coalesce(word_length <= d, true) and coalesce(word_length >= e, true) as kept
from q left join f on q.lang is not distinct from f.lang and q.source is not distinct from f.source
"""

#: Base 32 of a SHA-1: each five hexadecimal digits are four digits of base 32.
_DIGIT = " || ".join(f"lpad(to_base(cast('0x' || substr(s, {1 + 5 * i}, 5) as bigint), 32), 4, '0')" for i in range(8))
ORACLE["op12_warc"] = f"""
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as s from pages),
m as (select t, max(page_id) as last from p group by t)
select page_id, cast(octet_length(encode(t)) as bigint) as payload_bytes,
  translate({_DIGIT}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
  case when last is null or page_id is not distinct from last then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from last then last end as refers_to
from p join m using (t)
"""

ORACLE["op13_fill_in_middle"] = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
    sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents
), r as (
  select *, cast('0x' || substr(h, 1, 8) as bigint) % (len(u) + 1) as x, cast('0x' || substr(h, 9, 8) as bigint) % (len(u) + 1) as y,
    t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or cast('0x' || substr(h, 17, 8) as bigint) % 100 >= 90 as plain,
    cast('0x' || substr(h, 25, 8) as bigint) % 100 < 20 as spm
  from d
), c as (
  select *, coalesce(array_to_string(u[1:least(x, y)], ''), '') as p, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') as m,
    coalesce(array_to_string(u[greatest(x, y) + 1:], ''), '') as s
  from r
)
select doc_id, cast(len(u) as bigint) as n, case when plain then 'plain' when spm then 'spm' else 'psm' end as form,
  case when not plain then cast(length(p) as bigint) end as prefix_chars, case when not plain then cast(length(m) as bigint) end as middle_chars,
  sha256(case when plain then t when spm then '<S>' || s || '<P>' || p || '<M>' || m else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from c
"""
