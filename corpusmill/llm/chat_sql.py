"""DuckDB SQL for chat formatting."""

_ESC = r"regexp_replace({}, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')"
OP10 = f"""with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from
  (select conv_id, turn, role, text from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(12 + length(replace(replace({_ESC.format("role")}, '%', '%25'), chr(10), '%0A')) + 1 + length({_ESC.format("text")}) + 11)::bigint as formatted_chars
from r group by conv_id"""
