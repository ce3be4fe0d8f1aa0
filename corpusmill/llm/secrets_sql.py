"""DuckDB SQL for the secret scans.  RE2 has no lookaround, so runs and their character classes are tested apart."""

ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _kind(number: int, pattern: str, group: int, least: int) -> str:
    return f"""select rid, {number} as kind, start, start + length(m) as "end", v from (
  select rid, m, v, (sum(length(gap) + length(m)) over (partition by rid order by i) - length(m))::bigint as start from (
    select rid, i, gaps[i] as gap, ms[i] as m, vs[i] as v from (
      select rid, unnest(range(1, len(ms) + 1)) as i, ms, vs, gaps from (
        select rid, regexp_extract_all(t, '{pattern}') as ms, regexp_extract_all(t, '{pattern}', {group}) as vs, regexp_split_to_array(t, '{pattern}') as gaps from base))))
  where length(v) >= {least}"""


OP2 = f"""with base as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, coalesce(source, chr(1)) as repo, split_part(coalesce(source, chr(1)), '/', 1) as owner from documents),
spans as ({_kind(0, ASSIGN, 2, 6)} union all {_kind(1, "AKIA[A-Z0-9]+", 0, 20)} union all {_kind(2, "[0-9a-f]{24,}", 0, 24)}
 union all select * from ({_kind(3, "[A-Za-z0-9+/_-]{20,}", 0, 20)}) where regexp_matches(v, '[0-9]') and
  ((length(v) >= 32 and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]')) or (not regexp_matches(v, '[+/_-]') and regexp_matches(v, '[A-Za-z]')))),
live as (select v, count(distinct owner) <= 1 and count(distinct repo) <= 10 as live from spans join base using (rid) group by v),
judged as (select rid, kind, start, "end", live, concat(['assign', 'access', 'hex', 'owned'][kind + 1], ':', start, ':', "end") as s from spans join live using (v)),
by_doc as (select rid, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
  coalesce(string_agg(s, ',' order by start, kind) filter (kind < 3), '') as b, coalesce(string_agg(s, ',' order by start, kind) filter (kind < 3 or live), '') as spans,
  count(*) filter (live) as n_owner_specific, count(*) filter (not live) as n_copied from judged group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_owner_specific, 0)::bigint as n_owner_specific, coalesce(n_copied, 0)::bigint as n_copied from base left join by_doc using (rid)"""
