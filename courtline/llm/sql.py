"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from courtline.llm import licenses, urls

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
_SUFFIXES = ", ".join(f"'{s}'" for s in urls.TWO_LABEL_SUFFIXES)


def _strength(level: str) -> str:
    """Prior strength by moments from the rows (n, bad, mean) of ``level``."""
    return f"""
      (select case when count(*) < 2 then 1 / {urls.LEAST_SHARE} - 1 else 1 / least(greatest(
         case when sum(n) - sum(n * n) / sum(n) - (count(*) - 1) > 0
              then (sum(n * pow(bad / n - mean, 2) / (mean * (1 - mean))) - (count(*) - 1))
                   / (sum(n) - sum(n * n) / sum(n) - (count(*) - 1))
              else {urls.LEAST_SHARE} end, {urls.LEAST_SHARE}), {urls.MOST_SHARE}) - 1 end
       from (select n::double n, bad::double bad, mean from {level}) where n > 0 and mean * (1 - mean) > 0)"""


URL_VERDICTS = f"""
with cut as (
  select page_id, url,
    case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
parts as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
  from cut),
rules(verdict, rule_host, rule_path) as (values {_RULES}),
fitting as (
  select distinct on (host, path) host, path, rule_host || rule_path as rule, verdict
  from (select distinct host, path from parts) join rules
    on (host = rule_host or suffix(host, '.' || rule_host)) and starts_with(path, rule_path)
  order by host, path, length(rule_host || rule_path) desc),
known as (
  select doc_id as page_id,
    max((coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1)::int) as bad
  from labels where doc_id is not null group by 1),
hosts0 as (
  select host, count(bad) as n, coalesce(sum(bad), 0) as bad, string_split(host, '.') as labels
  from parts left join known using (page_id) group by 1),
hosts1 as (
  select *, case when len(labels) >= 2 and array_to_string(labels[-2:], '.') in ({_SUFFIXES})
    then array_to_string(labels[-2:], '.') else labels[-1] end as suffix_
  from hosts0),
hosts2 as (
  select *, len(string_split(suffix_, '.')) + 1 as size,
    case when len(labels) <= len(string_split(suffix_, '.')) + 1 then host
         else array_to_string(labels[-(len(string_split(suffix_, '.')) + 1):], '.') end as domain_
  from hosts1),
domains0 as (select domain_, suffix_, sum(n) as n, sum(bad) as bad from hosts2 group by all),
suffixes0 as (select suffix_, sum(n) as n, sum(bad) as bad from domains0 group by all),
suffixes as (
  select suffix_, n, bad, (select coalesce(sum(bad)::double / nullif(sum(n), 0), 0) from suffixes0) as mean from suffixes0),
s_strength as (select {_strength('suffixes')} as k),
domains as (
  select d.domain_, d.n, d.bad, (s.mean * k + s.bad) / (k + s.n) as mean
  from domains0 d join suffixes s using (suffix_), s_strength),
d_strength as (select {_strength('domains')} as k),
hosts as (
  select h.host, h.n, h.bad, (d.mean * k + d.bad) / (k + d.n) as mean
  from hosts2 h join domains d using (domain_), d_strength),
h_strength as (select {_strength('hosts')} as k),
rates as (select host, n, k, (mean * k + bad) / (k + n) as rate from hosts, h_strength),
standing as (select host, rate - {urls.BOUND} * sqrt(rate * (1 - rate) / (k + n + 1)) >= {urls.CUT} as shady from rates)
select page_id, p.host, p.path, rule, coalesce(verdict, case when shady then 'block' end, 'allow') as verdict
from parts p left join fitting f on p.host = f.host and p.path = f.path left join standing s on p.host = s.host
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _doubled(pattern: str) -> str:
    """A pattern over words that have a blank of their own on either side."""
    return " " + pattern.replace(" ", "  ") + " "


_SIGNATURES = ", ".join(
    f"({n}, {_quoted(label)}, {priority}, {_quoted('  ' + keyword.replace(' ', '  '))}, {_quoted(_doubled(pattern))})"
    for n, (label, priority, keyword, pattern) in enumerate(licenses.rules())
)
_PHRASES = ", ".join(f"({_quoted(label)}, {_quoted(_doubled(phrase))})" for phrase, label in licenses.BASE)
_LINE = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _intervals(patterns: str, columns: str) -> str:
    """Every match of every pattern in every line, with its first word and the word beyond its last."""
    return f"""
      select doc_id, {columns}, first, first + (length(found[j]) - length(replace(found[j], ' ', ''))) // 2 as last
      from (
        select *, (list_sum(blanks[:j]) + coalesce(list_sum(inside[:j - 1]), 0)) // 2 as first
        from (
          select *, list_transform(pieces, lambda p: length(p) - length(replace(p, ' ', ''))) as blanks,
            list_transform(found, lambda p: length(p) - length(replace(p, ' ', ''))) as inside,
            unnest(range(1, len(found) + 1)) as j
          from (
            select doc_id, {columns}, regexp_extract_all(line, pattern) as found,
              regexp_split_to_array(line, pattern) as pieces
            from lines join {patterns})))"""


LICENSES = f"""
with words as (select doc_id, {_LINE} as words from documents),
lines as (
  select doc_id, ' ' || array_to_string(words, '  ') || ' ' as line from words where len(words) > 0),
phrases(label, pattern) as (values {_PHRASES}),
signatures(rule, label, priority, keyword, pattern) as (values {_SIGNATURES}),
base as ({_intervals("phrases on contains(line, pattern)", "label")}),
found as ({_intervals("signatures on contains(' ' || line, keyword)", "label, rule, priority")}),
standing as (
  select * from found d where not exists (
    select 1 from found e where e.doc_id = d.doc_id and e.first <= d.first and e.last >= d.last
      and (e.priority > d.priority or (e.priority = d.priority and (e.last - e.first > d.last - d.first
        or (e.last - e.first = d.last - d.first and e.rule < d.rule)))))),
b as (
  select doc_id, count(*) as n_base, min(first) as first_word, max(first) as last_word,
    array_to_string(list_sort(list(distinct label)), ',') as base_labels
  from base group by 1),
l as (
  select doc_id, array_to_string(list_sort(list(distinct label)), ',') as labels
  from (select doc_id, label from base union all select doc_id, label from standing) group by 1),
s as (select doc_id, max(priority) / {licenses.MOST_PRIORITY} as score from standing group by 1)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
  last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  coalesce(score, 0)::double as score
from words left join b using (doc_id) left join l using (doc_id) left join s using (doc_id)
"""
