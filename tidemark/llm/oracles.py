"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import license_scan, secrets

NGRAM_JOIN = r"""
with recursive words as (
    select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from documents where doc_id is not null),
shingles as (
    select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as s
    from words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as t(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
    select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
    select x, y, c = p.n and c = q.n as same from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y
    where c >= 0.8 * (p.n + q.n - c)),
reach as (
    select doc_id as x, doc_id as y from words union select r.x, l.y from reach r join links l on l.x = r.y),
classes as (select x as doc_id, min(y) as class_id from reach group by x),
counts as (select x as doc_id, count(*) as n_links, min(case when same then y end) as twin from links group by x)
select c.doc_id, c.class_id, least(c.doc_id, coalesce(twin, c.doc_id)) as rep_id, coalesce(n_links, 0) as n_links, c.class_id = c.doc_id as kept
from classes c left join counts using (doc_id)"""

MIXING = r"""
with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
           cast('0x' || md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, '')))[1:15] as bigint) as place from documents),
sources as (
    select source, cast(sum(size) as bigint) as source_size,
           [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from sized group by source),
limits as (select *, 2.0::double * source_size as most, 1.5::double * sum(source_size) over () as budget from sources),
filled as (
    select *, (budget - coalesce(sum(most) over (w rows between unbounded preceding and 1 preceding), 0))
              / sum(weight) over (w rows between current row and unbounded following) >= most / weight as is_full
    from limits window w as (order by most / weight, source nulls last)),
aims as (
    select source, source_size,
           case when is_full then most else weight * ((budget - sum(case when is_full then most else 0 end) over ())
                / sum(case when is_full then 0 else weight end) over ()) end as target from filled),
queued as (
    select s.*, a.source_size, a.target,
           sum(size) over (partition by s.source order by place, doc_id rows between unbounded preceding and current row) - size as before
    from sized s join aims a on s.source is not distinct from a.source)
select doc_id, cast(size as bigint) as size, source_size, cast(target as double) as target,
       cast(greatest(0, least(size, floor(target - before + 1e-6))) + greatest(0, least(size, floor(target - before - source_size + 1e-6))) as bigint) as taken
from queued"""

EMBEDDING_DEDUP = """
with recursive good as (
    select vec_id, embedding::double[] as e from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
    select a.vec_id as x, b.vec_id as y from good a join good b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (
    select vec_id as x, vec_id as y from embeddings union select r.x, l.y from reach r join links l on l.x = r.y),
classes as (select x as vec_id, min(y) as component_id from reach group by x),
counts as (select x as vec_id, count(*) as n_links from links group by x)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from classes left join counts using (vec_id)"""

SUFFIX_DEDUP = """
with texts as (select doc_id, encode(coalesce(text, '')) as b from documents),
sized as (select doc_id, b, hex(b) as x, octet_length(b) as n from texts),
windows as (
    select doc_id, i, md5(substr(x, 2 * i + 1, 200)) as w from sized, unnest(range(0, greatest(n - 99, 0))) as t(i)),
later as (
    select doc_id, i from (select doc_id, i, row_number() over (partition by w order by doc_id, i) as k from windows) where k > 1),
starts as (
    select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 100 or lag(i) over (partition by doc_id order by i) is null then 1 else 0 end as fresh from later),
runs as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as r from starts),
spans as (select doc_id, r, min(i) as lo, max(i) + 100 as hi from runs group by all),
edges as (
    select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as after, row_number() over (partition by doc_id order by lo desc) as back from spans),
kept as (
    select e.doc_id, sum(hi - lo) as gone, count(*) as n_spans,
           string_agg(substr(x, 2 * after + 1, 2 * (lo - after)), '' order by lo) || any_value(case when back = 1 then substr(x, 2 * hi + 1) end) as rest
    from edges e join sized using (doc_id) group by e.doc_id)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(case when rest is null then b else unhex(rest) end) as kept_sha256
from sized left join kept using (doc_id)"""


def _secrets() -> str:
    """Spans by kind from the pieces between matches; a weak span stays if a part that completes it is near.

    RE2 knows no lookbehind, so the patterns of weak kinds are put otherwise: a user name takes the character
    before it into the match, and a key is a whole run of its characters with all padding behind it, if the padding
    is short and no further run touches it."""
    user = r"""(^|[^A-Za-z0-9_])(?i:(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)"""
    kinds = (  # name, role, pattern, condition on match m, characters of the match before the span
        ("assign", "secret", secrets.STRONG["assign"][0], "length(regexp_extract(m, {p}, 2)) >= 6", "0"),
        ("access", "identifier", secrets.STRONG["access"][0], "length(m) >= 20", "0"),
        ("hex", "secret", secrets.STRONG["hex"][0], "length(m) >= 24", "0"),
        ("key", "secret", "[A-Za-z0-9+/]+=*", "length(rtrim(m, '=')) >= 40 and length(m) - length(rtrim(m, '=')) <= 2 and not (touched and m like '%=')", "0"),
        ("user", "identifier", user, "length(regexp_extract(m, {p}, 2)) >= 3", "length(regexp_extract(m, {p}, 1))"),
        ("endpoint", "endpoint", secrets.WEAK["endpoint"][0], "length(m) >= 10", "0"),
    )
    parts = []
    for k, (name, role, pattern, keep, skip) in enumerate(kinds):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""
    select doc_id, {k} as kind, '{name}' as name, '{role}' as role, lo + {skip.format(p=p)} as lo, lo + length(m) as hi from (
        select doc_id, ms[i] as m, i < len(ms) and gs[i + 1] = '' as touched, cast(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as bigint) as lo
        from (select doc_id, regexp_extract_all(t, {p}) as ms, string_split_regex(t, {p}) as gs from texts), unnest(range(1, len(ms) + 1)) as u(i)) where {keep.format(p=p)}""")
    return f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
found as ({" union all ".join(parts)}),
base as (select * from found where kind < 3),
weak as (
    select * from found w where kind >= 3 and not exists (select 1 from base b where b.doc_id = w.doc_id and b.lo < w.hi and w.lo < b.hi)),
parts as (select * from base union all select * from weak),
linked as (
    select distinct w.* from weak w join parts o on o.doc_id = w.doc_id and greatest(w.lo - o.hi, o.lo - w.hi) <= {secrets.SCOPE}
    and case w.role when 'secret' then o.role = 'identifier' when 'identifier' then o.role = 'secret' else o.role <> 'endpoint' end),
strings as (
    select doc_id, string_agg(name || ':' || lo || ':' || hi, ',' order by lo, kind) as s from base group by doc_id),
everything as (
    select doc_id, string_agg(name || ':' || lo || ':' || hi, ',' order by lo, kind, hi) as spans,
           count(case when name = 'assign' then 1 end) as n_assign, count(case when name = 'access' then 1 end) as n_access, count(case when name = 'hex' then 1 end) as n_hex
    from (select * from base union all select * from linked) group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(s, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join strings using (doc_id) left join everything using (doc_id)"""


def _licenses() -> str:
    """Dice coefficients of all units with all templates of fitting size."""
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in license_scan.TEMPLATES.items())
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    t = license_scan.THRESHOLD
    return rf"""
with texts as (select doc_id, lower(coalesce(text, '')) as t from documents),
lines as (select doc_id, unnest(string_split(t, chr(10))) as l from texts),
units as (
    select doc_id, t as u from texts union select doc_id, unnest(string_split_regex(t, '\n\s*\n')) from texts union select doc_id, l from lines
    union select doc_id, unnest(string_split(regexp_replace(l, '([.!?:;])\s+', '\1' || chr(1), 'g'), chr(1))) from lines),
words as (select doc_id, regexp_extract_all(u, '[\p{{L}}\p{{N}}]+') as w from units),
sets as (select distinct doc_id, {pairs} as a from words where len(w) >= 2),
templates as (select name, {pairs} as b from (select name, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') as w from (values {rows}) v(name, t))),
scored as (
    select doc_id, name, 2 * len(list_intersect(a, b)) / (len(a) + len(b)) as d from sets join templates
    on len(a) >= len(b) * {t / (2 - t) - 1e-9} and len(a) <= len(b) * {(2 - t) / t + 1e-9} and list_has_any(a, b)),
best as (select doc_id, name, max(d) as d from scored where d >= {t} group by doc_id, name),
found as (
    select doc_id, arg_min(name, (-d, name)) as license, max(d) as dice, count(*) as n_licenses, string_agg(name || ':' || printf('%.6f', d), ',' order by name) as licenses
    from best group by doc_id)
select doc_id, license, coalesce(dice, 0.0::double) as dice, coalesce(n_licenses, 0) as n_licenses, coalesce(licenses, '') as licenses
from texts left join found using (doc_id)"""


SQL = {"op2_ngram_join": NGRAM_JOIN, "op3_mixing": MIXING, "op5_license_scan": _licenses(), "op6_embedding_dedup": EMBEDDING_DEDUP, "op8_suffix_dedup": SUFFIX_DEDUP, "op10_secrets": _secrets()}
