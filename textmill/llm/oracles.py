"""SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from textmill.llm import quality

_lit = lambda x: "'" + x.replace("'", "''") + "'"
_VOCABULARY = "[" + ", ".join(_lit(v) for v in sorted({w for own in quality.COMMON.values() for w in own})) + "]"
_LANGS = ", ".join(map(_lit, quality.COMMON))
_count = lambda kept: f"length(regexp_replace(text, {_lit('[^' + kept + ']+')}, '', 'g'))"
_CLASSES = ", ".join(f"{_count(kept)} as {name}" for name, kept in quality.CLASSES)
_NAMES = [name for name, _ in quality.CLASSES]

QUALITY = rf"""
    with w as (select doc_id, case when lang in ({_LANGS}) then lang else '*' end as ref, coalesce(text, '') as text from documents),
    s as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda v: v <> '') as w, list_filter(string_split(text, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) as l, {_CLASSES} from w),
    c as (select *, len(w) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, length(text) as n_chars, len(l) - len(list_distinct(l)) as n_dup_lines,
        list_filter(list_transform(w, lambda x: lower(rtrim(x, {_lit(".,;:!?" + chr(34) + "')|#*$%&")}))), lambda x: list_contains({_VOCABULARY}, x)) as common from s),
    g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k from (select doc_id, w, unnest(range(1, n_words - 1)) as i from c where n_words >= 3)),
    d as (select doc_id, i from (select *, count(*) over (partition by doc_id, k) as n from g) where n > 1),
    r as (select doc_id, sum(step)::bigint as n_repeat_words from (select doc_id, least(3, coalesce(lead(i) over (partition by doc_id order by i) - i, 3)) as step from d) group by doc_id),
    b as (select c.*, coalesce(n_repeat_words, 0) as n_repeat_words, n_words < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * n_words as base_failed from c left join r using (doc_id)),
    h as (select doc_id, ref, base_failed, 'c' as kind, unnest([{", ".join(_NAMES)}, word_chars - {" - ".join(_NAMES)}, n_chars - word_chars]) as v, unnest(range({len(_NAMES) + 2})) as ix from b
        union all select doc_id, ref, base_failed, 'w', unnest(list_append(list_transform({_VOCABULARY}, lambda v: len(list_filter(common, lambda x: x = v))), n_words - len(common))), unnest(range(len({_VOCABULARY}) + 1)) from b),
    f as (select ref, kind, ix, sum(v)::double as q from h where not base_failed and ref <> '*' group by all union all select '*', kind, ix, sum(v)::double from h where not base_failed group by all),
    t as (select ref, kind, sum(q) as qs from f group by all),
    ok as (select ref from t where kind = 'w' and qs >= {quality.LEAST_REFERENCE}),
    n as (select doc_id, kind, sum(v)::double as ps from h group by all),
    m as (select doc_id, kind, v / ps as p, q / qs as q, (v / ps + q / qs) / 2 as m from h join n using (doc_id, kind) join f using (ref, kind, ix) join t using (ref, kind) where ps > 0 and qs > 0 and ref in (select ref from ok)),
    j as (select doc_id, kind, sqrt(greatest(0, sum(case when p > 0 then p * ln(p / m) else 0 end + case when q > 0 then q * ln(q / m) else 0 end) / (2 * ln(2)))) as d from m group by all),
    z as (select doc_id, max(d) filter (where kind = 'c') as dc, max(d) filter (where kind = 'w') as dw from j group by doc_id)
    select doc_id, n_words, word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols, n_dup_lines, n_repeat_words, base_failed,
        not base_failed and not coalesce(n_chars >= {quality.LEAST_CHARS} and dc > {quality.FAR_CHARS}, false) and not coalesce(n_words >= {quality.LEAST_WORDS} and dw > {quality.FAR_WORDS}, false) as kept
    from b left join z using (doc_id)"""

INFILL = r"""
    with l as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as l, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
    n as (select *, len(l) - (case when l[-1] = '' then 1 else 0 end) as n, list_transform(range(4), lambda i: ('0x' || h[8 * i + 1:8 * i + 8])::bigint) as d from l),
    c as (select *, least(d[1] % (n + 1), d[2] % (n + 1)) as a, greatest(d[1] % (n + 1), d[2] % (n + 1)) as b,
        case when text = '' or text like '%<P>%' or text like '%<S>%' or text like '%<M>%' then 'plain' when d[4] % 100 < 50 then 'spm' else 'psm' end as form from n),
    s as (select *, list_transform([a, b], lambda k: case when k = 0 then 0 when k = len(l) then length(text) else length(array_to_string(l[1:k], chr(10))) + 1 end) as k from c),
    p as (select *, substring(text, 1, k[1]) as x, substring(text, k[1] + 1, k[2] - k[1]) as y, substring(text, k[2] + 1) as z from s)
    select doc_id, n::bigint as n, form, case when form <> 'plain' then length(x) end as prefix_chars, case when form <> 'plain' then length(y) end as middle_chars,
        sha256(case form when 'plain' then text when 'psm' then concat('<P>', x, '<S>', z, '<M>', y) else concat('<S>', z, '<P>', x, '<M>', y) end) as output_sha256, sha256(text) as restored_sha256
    from p"""


def _clustering(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Every round spelled out: all distances, the nearest, floors of means."""
    squared = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    steps = [
        f"""with v as materialized (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
            where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        c0 as materialized (select row_number() over (order by sha256('2:' || vec_id)) - 1 as cluster, x from v qualify cluster < {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select v.vec_id, any_value(v.x) as x, min({{'d': {squared}, 'c': c.cluster}}) as m from v, c{r} c group by v.vec_id)")
        if r < rounds:
            steps.append(f"""t{r} as (select m.c as cluster, i, sum(x[i])::bigint as s, count(*) as n from a{r}, range(1, {dims + 1}) t(i) group by all),
                m{r} as (select cluster, list((s - ((s % n) + n) % n) // n order by i) as x from t{r} group by cluster),
                c{r + 1} as materialized (select cluster, coalesce(m.x, c.x) as x from c{r} c left join m{r} m using (cluster))""")
    last = f"""select vec_id, a.m.c::int as cluster, a.m.d as distance, (sum(a.m.d) over (partition by a.m.c))::bigint as cluster_inertia, (sum(a.m.d) over ())::bigint as inertia,
        sha256(array_to_string(c.x, ',')) as centroid_sha256 from a{rounds} a join c{rounds} c on a.m.c = c.cluster"""
    return ", ".join(steps) + last


CLUSTERING = _clustering()
