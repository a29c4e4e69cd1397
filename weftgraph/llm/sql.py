"""SQL for the results of the operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""with d as (select doc_id, {_LOWER} as t from documents), g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(t) as text_sha256 from d join g using (t)"""

OP3 = """with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, regexp_replace(role, '([<\\[])(\\\\*)(/?(?:s>|INST\\])|\\|[A-Za-z_]+\\|>)', '\\1\\\\\\2\\3', 'g') as er, regexp_replace(text, '([<\\[])(\\\\*)(/?(?:s>|INST\\])|\\|[A-Za-z_]+\\|>)', '\\1\\\\\\2\\3', 'g') as et from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
 cast(sum(length(er) + length(et) + length('<|turn|><|text|><|end|>')) as bigint) as formatted_chars from e group by conv_id"""

_SUFFIXES = "('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'gov.uk', 'ne.jp', 'or.jp', 'org.au', 'org.uk')"
_ADDRESS = "regexp_matches({0}, '^([0-9]+[.]){{3}}[0-9]+$|^\\[')"


def _last(site: str, n: int) -> str:
    return f"array_to_string(string_split({site}, '.')[-{n}:], '.')"


def _suffix(site: str) -> str:
    return f"case when {_ADDRESS.format(site)} then '' when {_last(site, 2)} in {_SUFFIXES} then {_last(site, 2)} else {_last(site, 1)} end"


def _domain(site: str) -> str:
    return f"case when {_ADDRESS.format(site)} then {site} when {_last(site, 2)} in {_SUFFIXES} then {_last(site, 3)} else {_last(site, 2)} end"


def _strength(units: str) -> str:
    """A level's prior strength by moments, between 1 and 10000."""
    return f"""(select case when coalesce(t.n, 0) = 0 or t.units < 2 or t.n * t.n = t.nn then 1.0 when t.k = 0 or t.k = t.n or t.between_ <= 0 then 1e4
  else least(1e4, greatest(1.0, (t.k / t.n) * (1 - t.k / t.n) / t.between_ - 1)) end as s
 from (select any_value(r.k) as k, any_value(r.n) as n, any_value(r.nn) as nn, any_value(r.units) as units,
   (sum(u.n * pow(u.k / u.n - r.k / r.n, 2)) - (any_value(r.units) - 1) * any_value((r.k / r.n) * (1 - r.k / r.n))) / nullif(any_value(r.n - r.nn / r.n), 0) as between_
  from {units} u cross join (select cast(sum(k) as double) as k, cast(sum(n) as double) as n, cast(sum(n * n) as double) as nn, count(*) as units from {units}) r) t)"""


def _posterior(name: str, units: str, prior: str, joined: str) -> str:
    return f"""{name} as (select u.*, a / (a + b) as rate, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound
 from (select u.*, u.k + s.s * {prior} as a, u.n - u.k + s.s * (1 - {prior}) as b from {units} u cross join {_strength(units)} s {joined}) u)"""


OP10 = f"""with seen as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
 sited as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), '[.]?(:[0-9]*)?$', '') as site from seen),
 outcome as (select site, quality = 0 or toxic = 1 as bad from sited join labels on try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[.]html|/)?$', 1) as bigint) = doc_id),
 uh as (select site as host, {_suffix("site")} as suffix, {_domain("site")} as domain, sum(cast(bad as int)) as k, count(*) as n from outcome where bad is not null group by site),
 ud as (select domain, {_suffix("domain")} as suffix, sum(k) as k, sum(n) as n from uh group by domain),
 us as (select suffix, sum(k) as k, sum(n) as n from uh group by suffix),
 top as (select coalesce(sum(k), 0) + 1.0 as a, coalesce(sum(n), 0) - coalesce(sum(k), 0) + 1.0 as b from uh),
 {_posterior("ps", "us", "p.m", "cross join (select cast(a as double) / (a + b) as m from top) p")},
 {_posterior("pd", "ud", "p.rate", "join ps p on p.suffix = u.suffix")},
 {_posterior("ph", "uh", "p.rate", "join pd p on p.domain = u.domain")},
 judged as (select page_id, sited.host, path, coalesce(ph.bound, pd.bound, ps.bound, (select a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) from top)) as bound,
  case when (sited.host = 'example.com' or ends_with(sited.host, '.example.com')) and starts_with(path, '/en/7') then 'example.com/en/7'
   when (sited.host = 'example.net' or ends_with(sited.host, '.example.net')) and starts_with(path, '/de/8') then 'example.net/de/8'
   when (sited.host = 'com' or ends_with(sited.host, '.com')) and starts_with(path, '/en/') then 'com/en/'
   when (sited.host = 'net' or ends_with(sited.host, '.net')) and starts_with(path, '/de/') then 'net/de/'
   when (sited.host = 'org' or ends_with(sited.host, '.org')) and starts_with(path, '/es/') then 'org/es/' end as rule
  from sited left join ph on ph.host = site left join pd on pd.domain = {_domain("site")} left join ps on ps.suffix = {_suffix("site")})
select page_id, host, path, rule, case when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block' when rule is not null then 'allow' when bound > 0.3 then 'block' else 'allow' end as verdict from judged"""
