"""DuckDB SQL for the host-level quality rules."""

from corpusmill.llm.quality import EXCESS, Z

#: Measures of ``{docs}``; a row number stands for the row, as ids may repeat.
MEASURES = r"""
base as (select row_number() over () as rid, * from (select doc_id, source, coalesce(text, '') as text from {docs})),
worded as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from base),
wins as (select rid, i, w[i:i + 4] as g from (select rid, w, unnest(range(1, len(w) - 3)) as i from worded where len(w) >= 5)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from wins) where c > 1),
rep as (select rid, sum(least(5, coalesce(nxt - i, 5))) as n_repeat_words from (select rid, i, lead(i) over (partition by rid order by i) as nxt from twice) group by rid),
measures as (select rid, doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words from worded left join rep using (rid)),
flags as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from measures),
failing as (select *, base_failed or 10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines or word_chars < 2 * n_words or word_chars > 15 * n_words as failed from flags),
host as (select source, count(*) as n, sum(failed::bigint) as f, sum(failed::bigint) / count(*) as r from failing group by source),
prior as (select m, pooled, case when v > 0 and v < m * (1 - m) then m * (1 - m) / v - 1 else 1e6 end as s from (select avg(r) as m, var_pop(r) as v, sum(f) / sum(n) as pooled from host)),
rated as (select source, n + s as weight, (f + m * s) / (n + s) as rate, pooled from host, prior),
verdict as (select source, rate - {z} * sqrt(rate * (1 - rate) / (weight + 1)) > {excess} * pooled as bad from rated),
judged as (select failing.*, not (base_failed or (bad and failed)) as kept from failing join verdict on failing.source is not distinct from verdict.source)
"""

OP9 = "with " + MEASURES.replace("{docs}", "documents").replace("{z}", str(Z)).replace("{excess}", str(EXCESS)) + "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from judged"
