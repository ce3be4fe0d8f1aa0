"""DuckDB SQL for the n-gram join, benchmark decontamination and substring dedup, over whole tables and texts."""

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _worded(table: str, columns: str, lower: bool) -> str:
    text = f"translate(text, '{_CAPITALS}', '{_SMALL}')" if lower else "text"
    return rf"select row_number() over () as rid, {columns}, list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from {table}"


OP1 = f"""with recursive d as ({_worded("documents", "doc_id", True)}),
g as (select distinct rid, array_to_string(w[i:i + 2], ' ') as g from (select *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)),
sets as (select rid, count(*) as n, md5(string_agg(g, chr(10) order by g)) as class from g group by rid),
classes as (select class, min(rid) as rid, min(n) as n from sets group by class),
col as (select class, n, g from classes join g using (rid)),
pairs as (select a.class as u, b.class as v, count(*) as shared, min(a.n) + min(b.n) as total from col a join col b on a.g = b.g and a.class < b.class group by all),
edges as (select u, v from pairs where 100 * shared >= 90 * (total - shared)),
ways as (select u, v from edges union all select v, u from edges),
reach(u, v) as (select class, class from classes union select r.u, w.v from reach r join ways w on r.v = w.u),
least_id as (select class, min(doc_id) as doc_id from sets join d using (rid) group by class),
component as (select u as class, min(doc_id) as component_id from reach join least_id on v = least_id.class group by u),
degree as (select u as class, count(*) as n_links from ways group by u)
select doc_id, coalesce(n, 0)::bigint as n_shingles, case when doc_id is not null then coalesce(component_id, doc_id) end as component_id, coalesce(n_links, 0)::bigint as n_links
from d left join sets using (rid) left join component using (class) left join degree using (class)"""

#: An item of fewer than five words is one shingle of its own length.
OP3 = f"""with d as ({_worded("documents", "doc_id", True)}), items as ({_worded("(select distinct item_id, text from benchmark where item_id is not null)", "item_id", True)}),
sized as (select rid, item_id, w, least(5, len(w)) as k from items where len(w) > 0),
s as (select distinct rid, item_id, k, array_to_string(w[i:i + k - 1], ' ') as g from (select *, unnest(range(1, len(w) - k + 2)) as i from sized)),
n as (select rid, count(*) as n_item from s group by rid),
ks as (select distinct k from sized),
dg as (select distinct rid, doc_id, k, array_to_string(w[i:i + k - 1], ' ') as g from (select *, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
hits as (select dg.rid as drid, s.rid as rid, doc_id, item_id, count(*) as n_shared from dg join s on dg.k = s.k and dg.g = s.g group by all)
select doc_id, item_id, n_item::bigint as n_item, n_shared::bigint as n_shared from hits join n using (rid) where 10 * n_shared >= 8 * n_item"""

OP4 = f"""with d as ({_worded("documents", "doc_id", False)}),
wins as (select rid, coalesce(doc_id, 9223372036854775807) as doc, i, md5(array_to_string(w[i:i + 19], ' ')) as g from (select *, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
late as (select rid, i from (select *, min((doc, i)) over (partition by g) as first from wins) where (doc, i) <> first),
gone as (select distinct rid, i + k as at from late, (select unnest(range(0, 20)) as k)),
words as (select rid, i, w[i] as word from (select rid, w, unnest(range(1, len(w) + 1)) as i from d)),
kept as (select words.rid, count(*) as n, string_agg(word, ' ' order by i) as t from words anti join gone on words.rid = gone.rid and words.i = gone.at group by words.rid)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (rid)"""
