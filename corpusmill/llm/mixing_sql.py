"""DuckDB SQL for the mixture."""

#: ``{docs}`` in; the CTE ``taken`` has rid, doc_id, size, source_size, target, taken.
PLAN = r"""
sized as (select row_number() over () as rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from {docs}),
src as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w from src),
capped as (select *, coalesce(sum(2 * source_size) over before, 0)::bigint as c, (sum(w) over () - coalesce(sum(w) over before, 0))::bigint as rest, (sum(source_size) over ())::bigint as total
  from weighed window before as (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding)),
levels as (select *, (1.5::double * total - c) / rest as level from capped),
level as (select arg_min(level, (source_size / w, source is null, source)) as level from levels where level * w <= 2 * source_size),
goal as (select source, source_size, least((2 * source_size)::double, coalesce(level.level * w, 'inf'::double)) as target from weighed left join level on true),
placed as (select sized.*, source_size, target, (sum(size) over (partition by sized.source order by md5('0|' || coalesce(doc_id::varchar, 'null|' || size)), doc_id, size rows unbounded preceding) - size)::bigint as before
  from sized join goal on sized.source is not distinct from goal.source),
taken as (select *, case when source_size > 0 then (floor(target)::bigint // source_size) else 0 end as epochs from placed),
mixture as (select rid, doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::bigint - epochs * source_size - before)))::bigint as taken from taken)
"""
OP8 = "with " + PLAN.replace("{docs}", "documents") + "select doc_id, size, source_size, target, taken from mixture"
