"""DuckDB SQL for the queries that SQL can express."""

from . import quality, warc

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _share(table: str, keys: str, parent: str, join: str) -> str:
    """Water-filling of parent_budget among the children in table, as CTE text."""
    part = f"partition by {parent}" if parent else ""
    return f"""
{table}_o as (select *, capacity / weight as ratio,
    (parent_budget - coalesce(sum(capacity) over (w rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (w rows between current row and unbounded following) as level
  from (select * {join}) window w as ({part} order by capacity / weight, {keys})),
{table}_l as (select *, max(case when ratio > level then level end) over ({part}) as top from {table}_o),
{table}_b as (select * exclude (ratio, level, top),
    cast(least(capacity, coalesce(floor(top * weight), capacity)) as bigint) as budget from {table}_l)"""


OP1 = f"""
with counted as (
  select doc_id, coalesce('d' || cast(try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') as bigint) % 3 as varchar), 'other') as domain,
    lang, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as n_tokens from documents),
slim as (select * from counted where n_tokens > 0),
leaf as (select domain, lang, source, sum(n_tokens)::double as n_tokens, 2.0 * sum(n_tokens) as capacity, 1.0::double as weight from slim group by all),
lng as (select domain, lang, sum(capacity)::double as capacity, case lang when 'en' then 4 when 'de' then 2 when 'fr' then 2 when 'es' then 2 else 1 end::double as weight from leaf group by all),
dom as (select domain, sum(capacity)::double as capacity, case domain when 'd0' then 5 when 'd1' then 3 when 'd2' then 2 else 1 end::double as weight from lng group by all),
root as (select floor(sum(n_tokens) * 0.6::double)::double as b from slim),
{_share("dom", "domain", "", ", b as parent_budget from dom, root")},
{_share("lng", "domain, lang", "domain", ", up::double as parent_budget from lng join (select domain, budget as up from dom_b) using (domain)")},
{_share("leaf", "domain, lang, source", "domain, lang", ", up::double as parent_budget from leaf join (select domain, lang, budget as up from lng_b) using (domain, lang)")},
plan as (select domain, lang, source, budget // n_tokens::bigint as epochs, budget % n_tokens::bigint as part from leaf_b where budget > 0),
placed as (select s.*, epochs, part, coalesce(sum(n_tokens) over (partition by domain, lang, source order by md5('7:' || (epochs + 1) || ':' || coalesce(doc_id::varchar, '')), doc_id
    rows between unbounded preceding and 1 preceding), 0) as before from slim s join plan using (domain, lang, source))
select doc_id, domain, lang, source, n_tokens, epochs::bigint as epochs, last_tokens, (epochs * n_tokens + last_tokens)::bigint as tokens
from (select *, greatest(0, least(n_tokens, part - before))::bigint as last_tokens from placed) where epochs * n_tokens + last_tokens > 0"""

OP3 = f"""
with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (select *, translate(trim(line, {SPACES}), {UPPER}, {LOWER}) as key from lines),
gone as (select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
word as (select doc_id, (pos - 1) // 64 as word, (18446744073709551615::hugeint - sum(1::hugeint << ((pos - 1) % 64)::int))::ubigint as bits from keyed where key in (from gone) group by all),
bitmap as (select doc_id, string_agg(word || ':' || lpad(lower(hex(bits)), 16, '0'), ',' order by word) as keep_bitmap from word group by doc_id)
select doc_id, count(*)::bigint as n_lines, count(*) filter (key in (from gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (key not in (from gone)), '')) as kept_sha256, coalesce(any_value(keep_bitmap), '') as keep_bitmap
from keyed left join bitmap using (doc_id) group by doc_id"""


def _decoded(text: str) -> str:
    """SQL of text with its character references decoded."""
    names = f"map({list(warc.NAMES)}, {list(warc.NAMES.values())})"
    character = lambda code: f"chr(case when {code} between 1 and 55295 or {code} between 57344 and 1114111 then {code} else 65533 end::int)"
    one = f"""case when m[2] != '#' then case when {names}[m[2:-2]] is null then m else {character(f"{names}[m[2:-2]]")} end
      when lower(m[3]) = 'x' then {character("('0x' || m[4:-2])::bigint")} else {character("m[3:-2]::bigint")} end"""
    pieces, refs = f"string_split_regex({text}, '{warc.REFERENCE}')", f"regexp_extract_all({text}, '{warc.REFERENCE}')"
    return f"list_reduce(list_prepend('', list_transform(list_zip({pieces}, list_append(list_transform({refs}, lambda m: {one}), '')), lambda x: x[1] || x[2])), lambda x, y: x || y)"


_TEXT = f"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{warc.SKIPPED}', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), '{warc.BREAKS}', chr(10), 'g')"
_TEXT = f"regexp_replace(regexp_replace({_decoded(f"regexp_replace({_TEXT}, '{warc.TAGS}', '', 'g')")}, ' +', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
_TITLE = _decoded(f"regexp_extract(coalesce(html, ''), '{warc.TITLE}', 1)")


def _urn(text: str) -> str:
    h = f"md5({text})"
    cuts = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {cuts} || '>'"


OP8 = f"""
with src as (select page_id, coalesce(url, '') as target_uri, coalesce(html, '') as payload,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) as source_headers,
    trim({_TEXT}, ' ' || chr(10)) as text, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) as title,
    len(regexp_extract_all(coalesce(html, ''), '{warc.LINKS}')) as n_links from pages),
resp as (select *, 'sha256:' || sha256(payload) as source_digest,
    {_urn("'response' || chr(10) || coalesce(page_id::varchar, '') || chr(10) || target_uri || chr(10) || sha256(payload)")} as refers_to from src),
rec as (
  select *, 'metadata' as record_type, 'application/warc-fields' as content_type, 'title: ' || title || chr(13) || chr(10) || 'links: ' || n_links || chr(13) || chr(10)
    || 'source-payload-digest: ' || source_digest || chr(13) || chr(10) || 'source-' || replace(source_headers, chr(13) || chr(10), chr(13) || chr(10) || 'source-') || chr(13) || chr(10) as block from resp
  union all select *, 'conversion', 'text/plain', text from resp)
select page_id, record_type, {_urn("record_type || chr(10) || refers_to")} as record_id, refers_to, target_uri, content_type, strlen(block)::bigint as content_length,
  'sha256:' || sha256(block) as block_digest, source_digest, source_headers, block from rec"""


def _level(name: str, keys: str) -> str:
    """Quartiles of the sketches merged to keys."""
    by = ", ".join(filter(None, [keys, "metric"]))
    return f"""
{name}_m as (select {by}, bucket, sum(n) as n from sketch group by all),
{name}_u as (select *, sum(n) over (partition by {by} order by bucket nulls first) as upto, sum(n) over (partition by {by}) as total from {name}_m),
{name} as (select {by}, any_value(total) as total, min(v) filter (upto >= total * 0.25::double) as q1, min(v) filter (upto >= total * 0.75::double) as q3
  from (select *, coalesce(power(1.02::double, bucket) * {2 / (1.02 + 1)!r}::double, 0) as v from {name}_u) group by {by})"""


def _metric(i: int) -> str:
    return ", ".join(e[i] for e in quality.METRICS.values())


def _broken() -> str:
    out = []
    for m, (*_, low) in quality.METRICS.items():
        reach, doubt = "(q3 - q1) * 4.0::double", "sqrt(s) * 4.0::double"
        out.append(f"(metric = '{m}' and (x - {doubt} > (q3 + {reach}) * 1.02::double" + (f" or x + {doubt} < (q1 - {reach}) / 1.02::double" if low else "") + "))")
    return " or ".join(out)


OP2 = f"""
with w as (select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as l from documents),
win as (select doc_id, i, list_slice(w, i, i + 7) as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
twice as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
rep as (select doc_id, sum(least(8, d))::bigint as n from (select doc_id, coalesce(lead(i) over (partition by doc_id order by i) - i, 8) as d from twice) group by doc_id),
c as (select w.doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
    len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words from w left join rep using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c),
m as (select doc_id, lang, source, unnest(['symbol_share', 'dup_line_share', 'repeat_share', 'word_length']) as metric,
    unnest([{_metric(0)}]) as v, unnest([{_metric(1)}]) as x, unnest([{_metric(2)}]) as s from f where not base_failed),
sketch as (select lang, source, metric, case when v > 0 then ceil(ln(v) / ln(1.02::double)) end as bucket, count(*) as n from m group by all),
{_level("own", "lang, source")}, {_level("lng", "lang")}, {_level("corpus", "")},
fence as (select own.lang, own.source, own.metric, (own.total * own.q1 + 200 * ((lng.total * lng.q1 + 200 * corpus.q1) / (lng.total + 200))) / (own.total + 200) as q1,
    (own.total * own.q3 + 200 * ((lng.total * lng.q3 + 200 * corpus.q3) / (lng.total + 200))) / (own.total + 200) as q3
  from own join lng on own.lang is not distinct from lng.lang and own.metric = lng.metric join corpus on own.metric = corpus.metric),
bad as (select distinct doc_id from m join fence on m.lang is not distinct from fence.lang and m.source is not distinct from fence.source and m.metric = fence.metric where {_broken().replace("metric =", "m.metric =")})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (from bad) as kept from f"""


def op7(templates: dict[str, str], phrases: dict[str, str], words: str, share: float = 0.8) -> str:
    low = f"translate(coalesce(text, ''), {UPPER}, {LOWER})"
    base = " union all ".join(f"select doc_id, '{label}' as label, i - 1 as i from p where list_slice(w, i, i + {len(x.split()) - 1}) = {x.split()}" for x, label in phrases.items())
    rows = ", ".join(f"({sorted(set(t.split()))}, '{label}')" for t, label in templates.items())
    return f"""
with d as (select doc_id, regexp_extract_all({low}, '{words}') as w, {low} as t from documents),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
base as ({base}),
b as (select doc_id, count(*) as n, min(i) as a, max(i) as z, list_sort(list_distinct(list(label))) as labels from base group by doc_id),
l as (select doc_id, regexp_extract_all(unnest(string_split(t, chr(10))), '{words}') as w from d),
k as (select doc_id, w as b from l where len(w) <= 64 union all select doc_id, list_slice(w, i, i + 63) from (select doc_id, w, unnest(range(1, len(w) - 31, 32)) as i from l where len(w) > 64)
  union all select doc_id, list_slice(w, i, i + 63) from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 48) + 1, 16)) as i from d)),
tp(t, label) as (values {rows}),
met as (select doc_id, label, len(list_intersect(tp.t, k.b)) / len(tp.t) as share from k, tp),
s as (select doc_id, list(distinct label) as labels, max(share) as score from met where share >= {share}::double group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.a::bigint as first_word, b.z::bigint as last_word, coalesce(array_to_string(b.labels, ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(s.labels, [])))), ','), '') as labels, case when b.n > 0 then 1 else coalesce(score, 0) end::double as score
from d left join b using (doc_id) left join s using (doc_id)"""


OP11 = """
with recursive tab as (select list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as tab),
run as (select doc_id, run, count(*) as n from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents) group by all),
octets as (select run, n, hex(coalesce(doc_id::varchar, '') || ':' || run) as x from run),
crc as (select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) as h from octets, tab),
typed as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from crc),
w as (select word, sum(n)::bigint as n from typed where length(word) >= 6 group by word having sum(n) >= 5),
del as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as d from (select *, unnest(range(1, length(word) + 1)) as i from w)),
near as (select a.word, b.word as other, b.n from del a join del b on a.d = b.d and a.i = b.i and a.word != b.word
  union select a.word, b.word, b.n from del a join w b on a.d = b.word union select b.word, a.word, a.n from del a join w b on a.d = b.word),
best as (select word, count(*) as n_near, first(other order by n desc, other) as form, max(n) as form_n from near group by word),
forms as (select word, form, form_n from best join w using (word) where form_n >= 5 * w.n),
chain(word, root, step) as (select word, form, 1 from forms union all select c.word, f.form, step + 1 from chain c join forms f on c.root = f.word),
roots as (select word, max_by(root, step) as root from chain group by word)
select w.word, f.form, coalesce(r.root, w.word) as root, w.n, coalesce(b.n_near, 0)::bigint as n_near, f.form_n::bigint as form_n
from w left join best b using (word) left join forms f using (word) left join roots r using (word)"""


OP12 = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '{WORD}') as w from documents),
g as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) as gram from w),
n as (select doc_id, count(*) as n from g group by doc_id),
met as (select a.doc_id, b.doc_id as other, count(*) as common from g a join g b on a.gram = b.gram and a.doc_id != b.doc_id group by all),
link as (select met.doc_id, other from met join n a on a.doc_id = met.doc_id join n b on b.doc_id = other where 100 * common >= 80 * (a.n + b.n - common)),
reach(doc_id, other) as (select doc_id, other from link union select r.doc_id, l.other from reach r join link l on r.other = l.doc_id)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(r.low, w.doc_id)) as component_id
from w left join n using (doc_id) left join (select doc_id, min(other) as low from reach group by doc_id) r using (doc_id)"""


def _assigned(k: int) -> str:
    """Parts with the number of the nearest entry of book{k} and its distance, as CTE text."""
    return f"""
near{k} as (select vec_id, label, p.part, x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint * 64 + k) as best
  from p join book{k} b on p.part = b.part group by all)"""


def _trained(k: int) -> str:
    """book{k + 1} from the parts assigned to book{k}, as CTE text."""
    return f"""
mean{k} as (select part, k, list(m order by i) as m from (select part, best % 64 as k, i, floor(sum(x[i]) / count(*))::bigint as m
  from (select *, unnest(range(1, len(x) + 1)) as i from near{k}) group by all) group by all),
book{k + 1} as (select part, k, coalesce(m, c) as c from book{k} left join mean{k} using (part, k))"""


OP13 = f"""
with v as (select vec_id, label, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select vec_id, label, part, list_slice(e, part * (len(e) // 16) + 1, (part + 1) * (len(e) // 16)) as x from v, range(16) as t(part)),
book0 as (select part, k, x as c from p join (select vec_id, row_number() over (order by vec_id) - 1 as k from v order by vec_id limit 64) using (vec_id)),
{_assigned(0)}, {_trained(0)}, {_assigned(1)}, {_trained(1)}, {_assigned(2)},
coded as (select vec_id, label, string_agg(lpad(lower(hex(best % 64)), 2, '0'), '' order by part) as code, sum(best // 64)::bigint as error from near2 group by all),
sha as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, k)) as codebooks_sha256 from book2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded, sha"""


ALL = {"op11_spelling": OP11, "op12_ngram_join": OP12, "op13_vector_codes": OP13, "op1_mixing": OP1, "op2_quality_rules": OP2, "op3_line_dedup": OP3, "op8_warc_derivatives": OP8}
