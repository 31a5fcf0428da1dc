"""The training-data queries and the SQL that checks them."""

from __future__ import annotations

from . import pipeline, queries
from .url_reputation import IPV4, SECOND_LEVELS

QUERIES = {k: f for k, f in vars(queries).items() if k.startswith("op") and callable(f)}
QUERIES["pipeline"] = pipeline.run

_TWO = rf"regexp_matches(host, '(^|\.)({'|'.join(SECOND_LEVELS)})\.[a-z]{{2}}$')"
_IPV4 = rf"regexp_matches(host, '{IPV4}')"
_MOMENTS = "sum(bad) as bad, sum(n) as n, cast(count(*) filter (n > 0) as double) as kids, sum(case when n > 0 then bad * bad / n end) as sq, sum(n * n) as nn"
_BETWEEN, _WITHIN = "((sq - bad * bad / n) / (kids - 1))", "((bad - sq) / (n - kids))"
_STRENGTH = f"""case when kids > 1 and n > kids then greatest(2.0, least(200.0, case when {_BETWEEN} - {_WITHIN} > 1e-9
    then ({_BETWEEN} + ((n - nn / n) / (kids - 1) - 1) * {_WITHIN}) / ({_BETWEEN} - {_WITHIN}) - 1 else 200.0 end)) else 2.0 end"""


def _cut(value: str) -> str:
    return f"(({value}) >> greatest(length(bin({value})) - 7, 0)) << greatest(length(bin({value})) - 7, 0)"


def _quality() -> str:
    """The measures, the sketches' quantiles by group, language and whole, and the verdicts."""
    ratio = {"mean_word": ("word_chars", "greatest(n_words, 1)"), "symbol_rate": ("n_symbols", "greatest(n_words, 1)"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "greatest(n_words, 1)")}
    value = {m: _cut(f"10000 * {a} // {of}") for m, (a, of) in ratio.items()}
    each = " union all ".join(f"select lang, source, '{m}' as m, {v} as v from base where not base_failed" for m, v in value.items())
    quantiles = ", ".join(f"min(case when m = '{m}' and 100 * upto >= {c} * n then v end) as q{c}_{m}" for m in ratio for c in (10, 50, 90, 99))
    ends = ", ".join(f"case when q50_{m} = 0 then q99_{m} else 3 * q90_{m} - 2 * q50_{m} end as hi_{m}, {f'greatest(3 * q10_{m} - 2 * q50_{m}, 0)' if m == 'mean_word' else '0'} as lo_{m}" for m in ratio)
    level = lambda name, by: f"""{name} as (select {by} n, {ends} from (select {by} max(n) as n, {quantiles} from (select {by} m, v, sum(c) over (partition by {by} m order by v) as upto, sum(c) over (partition by {by} m) as n
        from (select {by} m, v, count(*) as c from vals group by {by} m, v)) {"group by " + by.rstrip(", ") if by else ""}))"""  # noqa: E731
    shrunk = lambda e: (of_lang := f"coalesce((l.n * l.{e} + 20 * w.{e}) // (l.n + 20), w.{e})", f"coalesce((g.n * g.{e} + 20 * {of_lang}) // (g.n + 20), {of_lang})")[1]
    within = [f"({v} between {shrunk(f'lo_{m}')} and {shrunk(f'hi_{m}')})" for m, v in value.items()]
    return rf"""with t as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        wins as (select rid, i, list_aggregate(w[i : i + 7], 'string_agg', ' ') as x from t, unnest(range(1, len(w) - 6)) as u(i) where len(w) >= 8),
        again as (select rid, i from wins qualify count(*) over (partition by rid, x) > 1),
        covered as (select rid, count(distinct i + k) as n from again, range(8) as r(k) group by rid),
        dups as (select rid, count(*) - count(distinct x) as n from (select rid, unnest(string_split(text, chr(10))) as x from t) where regexp_matches(x, '[^\x20\x09-\x0D]') group by rid),
        base as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from (
            select doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
            cast(coalesce(dups.n, 0) as bigint) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words, cast(len(string_split(text, chr(10))) as bigint) as n_lines from t left join covered using (rid) left join dups using (rid))),
        vals as ({each}),
        {level("own", "lang, source, ")}, {level("by_lang", "lang, ")}, {level("whole", "")}
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({" and ".join(within)}, true) as kept
        from base d left join own g on d.lang is not distinct from g.lang and d.source is not distinct from g.source left join by_lang l on d.lang is not distinct from l.lang cross join whole w"""


ORACLES: dict[str, str] = {
    "op2_quality_rules": _quality(),
    "op5_warc": """with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages),
        q as (select *, min(page_id) over (partition by digest) as first from p)
        select page_id, n as payload_bytes, digest as payload_digest, case when n >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
        case when n >= 100 and first <> page_id then first end as refers_to, true as verified from q""",
    "op4_url_reputation": rf"""with u as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
        h as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from u),
        r as (select *, case when ('.' || host) like '%.example.com' and path like '/en/7%' then 'example.com/en/7' when ('.' || host) like '%.example.net' and path like '/de/8%' then 'example.net/de/8'
            when ('.' || host) like '%.com' and path like '/en/%' then 'com/en/' when ('.' || host) like '%.net' and path like '/de/%' then 'net/de/' when ('.' || host) like '%.org' and path like '/es/%' then 'org/es/' end as rule from h),
        v as (select *, case when rule in ('example.com/en/7', 'net/de/') then 'allow' when rule is not null then 'block' end as ruled, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') as bare from r),
        hosts as (select bare as host, cast(count(rule) as double) as n, cast(count(*) filter (ruled = 'block') as double) as bad from v group by bare),
        placed as (select host, n, bad, case when {_IPV4} then host when {_TWO} and len(l) > 2 then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end as domain,
            case when {_IPV4} then 'ipv4' when {_TWO} then array_to_string(l[-2:], '.') else l[-1] end as suffix from (select *, string_split(host, '.') as l from hosts)),
        domains as (select *, {_STRENGTH} as k from (select domain, suffix, {_MOMENTS} from placed group by 1, 2)),
        suffixes as (select *, {_STRENGTH} as k from (select suffix, {_MOMENTS} from domains group by 1)),
        whole as (select case when n > 0 then (bad + 0.5) / (n + 1) else 0.0 end as base, case when n > 0 then {_STRENGTH} else 2.0 end as k from (select {_MOMENTS} from suffixes)),
        s2 as (select suffix, (s.bad + base * w.k) / (s.n + w.k) as m1, s.k as k1 from suffixes s, whole w),
        d2 as (select domain, suffix, (bad + m1 * k1) / (n + k1) as m2, k as k2 from domains join s2 using (suffix)),
        rep as (select host as bare, n, bad + m2 * k2 as a, n - bad + (1 - m2) * k2 as b from placed join d2 using (domain, suffix))
        select page_id, host, path, rule, coalesce(ruled, case when a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= 0.5 then 'block' else 'allow' end) as verdict, cast(n as bigint) as labelled
        from v join rep using (bare)""",
}
