"""Registered queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions import scalars as S
from corpusmill.operators import choices, extract, generate, metrics, mix, profile, prompts, render, responses, snippets, traces, validate
from corpusmill.plans import tables as T
from corpusmill.sources import files, repository

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _key(seed: int, of: str) -> str:
    return f"md5('{seed}|' || {of}::varchar)"


# Normalising

@query("norm_messages_last", f"with {T.TURNS} select conv_id, 'qa' as type, q as question, a as answer from c")
def norm_messages_last(spark, d):
    m = T.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return mix.normalised(m).select("conv_id", "type", "question", "answer")


@query("norm_instruction", """select doc_id, 'qa' as type, split_part(text, chr(10), 1) || case when instr(text, chr(10)) > 0 and length(substring(text, instr(text, chr(10)) + 1)) > 0 then (case when split_part(text, chr(10), 1) = '' then '' else chr(10) end) || substring(text, instr(text, chr(10)) + 1) else '' end as question, lang as answer from documents""")
def norm_instruction(spark, d):
    docs = T.table(spark, d, "documents")
    rows = docs.select("doc_id", F.substring_index("text", "\n", 1).alias("instruction"), F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\\n') + 1)")).otherwise("").alias("input"), F.col("lang").alias("output"))
    return mix.normalised(rows).select("doc_id", "type", "question", "answer")


# Validation

@query("failure_reason_counts", f"with {T.JUDGED} select coalesce(stage, 'valid') as stage, coalesce(reason, '') as reason, count(*) as n from judged group by all")
def failure_reason_counts(spark, d):
    return validate.failure_counts(T.samples(spark, d))


@query("valid_samples", f"with {T.JUDGED} select ord, type from judged where stage is null")
def valid_samples(spark, d):
    return validate.validate(T.samples(spark, d)).select(F.col("_ord").alias("ord"), "type")


@query("failed_samples", f"with {T.JUDGED} select ord, stage, reason from judged where stage is not null")
def failed_samples(spark, d):
    return validate.failures(T.samples(spark, d), strict=True).select(F.col("_ord").alias("ord"), F.col("failed_stage").alias("stage"), F.col("reasons")[0].alias("reason"))


@query("filter_basic_lenient", f"with {T.SAMPLES} select ord from s where length(ask) >= 10 and length(reply) >= 20 and length(trace_text) >= 30")
def filter_basic_lenient(spark, d):
    return T.samples(spark, d).where(validate.basic_reason(strict=False).isNull()).select(F.col("_ord").alias("ord"))


@query("logic_overlap", f"with {T.SAMPLES}, k as (select *, {T.sql_keywords('ask')} as kw from s) select ord, len(kw) = 0 or len(list_filter(list_slice(kw, 1, 3), lambda w: contains(lower(reply), w))) > 0 as passes from k")
def logic_overlap(spark, d):
    return T.samples(spark, d).select(F.col("_ord").alias("ord"), validate.overlaps(strict=False).alias("passes"))


@query("snippet_check", f"with {T.SAMPLES} select ord, bare or (length({T.sql_strip('code')}) >= 10 and line_start > 0 and line_end >= line_start) as strict, not bare and length({T.sql_strip('code')}) >= 10 and not (line_end > 0 and line_end < line_start) as lenient from s")
def snippet_check(spark, d):
    return T.samples(spark, d).select(F.col("_ord").alias("ord"), validate.snippets_fit(True).alias("strict"), validate.snippets_fit(False).alias("lenient"))


@query("core_question_dedup", f"with {T.SAMPLES}, k as (select ord, ask, {T.sql_strip('split_part(' + T.sql_strip('lower(ask)') + chr(44) + chr(39) + '(variant' + chr(39) + ', 1)')} as k from s where type = 'qa') select ord from (select *, row_number() over (partition by k order by ord) as n from k) where n = 1 or contains(lower(ask), '(variant')")
def core_question_dedup(spark, d):
    return validate.first_of_its_kind(T.samples(spark, d).where("type = 'qa'")).where("not _dup").select(F.col("_ord").alias("ord"))


@query("demand_dedup", f"with {T.SAMPLES} select min(ord) as ord from s where type = 'design' group by {T.sql_strip('lower(ask)')}")
def demand_dedup(spark, d):
    return validate.first_of_its_kind(T.samples(spark, d).where("type = 'design'")).where("not _dup").select(F.col("_ord").alias("ord"))


# Scalars

@query("keywords_top5", f"select doc_id, array_to_string({T.sql_keywords('text')}, ' ') as kw from documents")
def keywords_top5(spark, d):
    return T.table(spark, d, "documents").select("doc_id", F.array_join(S.keywords(F.col("text")), " ").alias("kw"))


@query("code_heads", """select doc_id, substring(array_to_string(list_slice(string_split(text, chr(10)), 1, 20), chr(10)), 1, 500) as head, least(20, len(string_split(text, chr(10)))) as line_end,
  array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) as part, case when len(string_split(text, chr(10))) < 20 then 'simple' when len(string_split(text, chr(10))) < 100 then 'medium' else 'complex' end as complexity from documents""")
def code_heads(spark, d):
    t = F.col("text")
    return T.table(spark, d, "documents").select("doc_id", S.head(t).alias("head"), F.least(F.lit(20), F.size(S.lines(t))).cast("long").alias("line_end"), S.line_slice(t, F.lit(2), F.lit(4)).alias("part"), S.complexity(t).alias("complexity"))


@query("paths_and_languages", r"""with p as (select page_id, split_part(split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1), '#', 1) || case page_id % 4 when 0 then '.py' when 1 then '.h' when 2 then '.ts' else '' end as path from pages)
select page_id, case when regexp_matches(path, '[^/]\.py$') then 'python' when regexp_matches(path, '[^/]\.h$') then 'c' when regexp_matches(path, '[^/]\.ts$') then 'typescript' else 'unknown' end as by_extension, case when path like '%.py' then 'python' when path like '%.ts' then 'typescript' else 'unknown' end as by_path,
  split_part(path, '/', -1) as base, case when instr(path, '/') > 0 then substring(path, 1, length(path) - length(split_part(path, '/', -1)) - 1) else '' end as folder from p""")
def paths_and_languages(spark, d):
    path = F.expr("concat(split_part(split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1), '#', 1), case page_id % 4 when 0 then '.py' when 1 then '.h' when 2 then '.ts' else '' end)")
    p = T.table(spark, d, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", S.language_of_extension(F.col("path")).alias("by_extension"), S.language_of_path(F.col("path")).alias("by_path"), S.basename(F.col("path")).alias("base"), S.dirname(F.col("path")).alias("folder"))


@query("name_regex", r"""select doc_id, regexp_extract(code, 'def\s+(\w+)', 1) as f, regexp_extract(code, 'class\s+(\w+)', 1) as c, regexp_extract(code, 'if\s+([^:]+):', 1) as cond, ((length(code) - length(replace(code, 'def ', ''))) / 4)::bigint as n_def
  from (select doc_id, 'class K' || doc_id || '(B):' || chr(10) || ' def f' || doc_id % 7 || '(self):' || chr(10) || '  if x >' || doc_id || ':' || chr(10) || text as code from documents)""")
def name_regex(spark, d):
    code = F.expr("concat('class K', doc_id, '(B):\\n def f', doc_id % 7, '(self):\\n  if x >', doc_id, ':\\n', text)")
    c = T.table(spark, d, "documents").select("doc_id", code.alias("code"))
    return c.select("doc_id", S.first_function(F.col("code")).alias("f"), S.first_class(F.col("code")).alias("c"), S.first_condition(F.col("code")).alias("cond"), S.occurrences(F.col("code"), "def ").alias("n_def"))


@query("durations", """select event_id, case when v < 60 then printf('%.1f秒', v) when v < 3600 then printf('%d分%d秒', floor(v / 60)::int, floor(v)::int % 60) else printf('%d小时%d分%d秒', floor(v / 3600)::int, floor(floor(v)::int % 3600 / 60)::int, floor(v)::int % 60) end as shown from (select event_id, (event_id * 7.25)::double as v from events)""")
def durations(spark, d):
    return T.table(spark, d, "events").select("event_id", S.duration((F.col("event_id") * 7.25).cast("double")).alias("shown"))


# Profiles

@query("type_counts", "select coalesce(lang, 'unknown') as type, count(*) as n from documents group by all")
def type_counts(spark, d):
    return profile.counts(T.table(spark, d, "documents"), F.col("lang"))


@query("nested_type_counts", "select source as rule_type, count(*) as n from documents group by all order by 1")
def nested_type_counts(spark, d):
    m = T.table(spark, d, "documents").select(F.struct(F.col("source").alias("rule_type")).alias("metadata"))
    return profile.counts(m, F.col("metadata.rule_type"), "rule_type").orderBy("rule_type")


@query("cond_counts", f"with {T.SAMPLES} select count(*) as total, count(*) filter (type = 'qa') as qa, count(*) filter (type = 'design') as design from s")
def cond_counts(spark, d):
    return files.dataset_info(T.samples(spark, d))


@query("diversity_profile", f"""with {T.SAMPLES} select count(*) as total_samples, count(*) filter (type = 'qa') as qa_count, count(*) filter (type = 'design') as design_count, case when count(*) filter (not bare) > 0 then 1 else 0 end as unique_files, 'python' as languages,
  count(*) filter (type = 'qa' and contains(lower(ask), 'what')) as n_what, count(*) filter (type = 'qa' and not contains(lower(ask), 'what') and contains(lower(ask), 'how')) as n_how,
  count(*) filter (type = 'qa' and not contains(lower(ask), 'what') and not contains(lower(ask), 'how') and contains(lower(ask), 'why')) as n_why from s""")
def diversity_profile(spark, d):
    return validate.diversity(T.samples(spark, d)).withColumn("languages", F.array_join("languages", ","))


@query("primary_language_mode", "select lang from (select lang, count(*) as n, min(doc_id) as o from documents where lang is not null group by lang) order by n desc, o limit 1")
def primary_language_mode(spark, d):
    return profile.mode(T.table(spark, d, "documents"), "lang", "doc_id", "python")


@query("complexity_buckets", "select complexity, coalesce(n, 0) as n from (values ('simple'), ('medium'), ('complex')) v(complexity) left join (select case when len(string_split(text, chr(10))) < 20 then 'simple' when len(string_split(text, chr(10))) < 100 then 'medium' else 'complex' end as complexity, count(*) as n from documents group by 1) using (complexity)")
def complexity_buckets(spark, d):
    return profile.distribution(T.table(spark, d, "documents").select(S.complexity(F.col("text")).alias("complexity")), "complexity", ["simple", "medium", "complex"])


_CATEGORIES = [("first", ["the ", "of "]), ("second", ["que", "und "])]


@query("demand_category", "select category, count(*) as n from (select case when contains(text, 'the ') or contains(text, 'of ') then 'first' when contains(text, 'que') or contains(text, 'und ') then 'second' else 'other' end as category from benchmark) group by category")
def demand_category(spark, d):
    return T.table(spark, d, "benchmark").select(profile.category(F.col("text"), _CATEGORIES).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("relevant_snippets", f"""with k as (select item_id as demand_id, {T.sql_keywords('text')} as kw from benchmark), five as (select doc_id as ord, text as code, row_number() over (order by doc_id) as k from documents order by doc_id limit 5),
hits as (select demand_id, ord, k, len(list_filter(kw, lambda w: contains(lower(code), w))) > 0 as hit from k, five) select demand_id, ord from (select *, bool_or(hit) over (partition by demand_id) as found from hits) where hit or (not found and k <= 3)""")
def relevant_snippets(spark, d):
    demands = T.table(spark, d, "benchmark").select(F.col("item_id").alias("demand_id"), S.keywords(F.col("text")).alias("keywords"))
    return profile.relevant(demands, T.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("code")), fallback=3)


@query("architecture", "select string_agg(distinct lang, ',' order by lang) filter (doc_id % 2 = 0) as base_classes, count(*) filter (doc_id % 2 = 0) as inheritance, count(*) filter (regexp_matches(lower(source), 'adapter|handler')) as adapters, count(*) filter (contains(lower(source), 'base')) as bases, count(*) as modular_functions from documents")
def architecture(spark, d):
    docs = T.table(spark, d, "documents")
    some = F.when(F.col("doc_id") % 2 == 0, F.array("lang")).otherwise(F.expr("cast(array() as array<string>)"))
    rows = docs.select(F.col("source").alias("file_path"), F.array(F.struct(F.col("source").alias("name"))).alias("functions"), F.array(F.struct(F.col("source").alias("name"), some.alias("bases"))).alias("classes"))
    return profile.architecture(rows).withColumn("base_classes", F.array_join("base_classes", ","))


# Sampling, mixing, splitting

@query("fixed_sample", f"select doc_id from documents order by {_key(42, 'doc_id')} limit 100")
def fixed_sample(spark, d):
    return mix.fixed_sample(T.table(spark, d, "documents").select("doc_id"), 100, 42, "doc_id")


@query("shuffle_rank", f"select doc_id, row_number() over (order by {_key(42, 'doc_id')}, doc_id) as rank from documents")
def shuffle_rank(spark, d):
    return mix.ranked(T.table(spark, d, "documents").select("doc_id"), 42, "doc_id").withColumnRenamed("_rank", "rank").withColumn("rank", F.col("rank").cast("long"))


@query("mix_one_to_one", f"with n as (select least((select count(*) from documents), (select count(*) from pages)) as n) select id, 'a' as _source from (select doc_id as id, row_number() over (order by {_key(42, 'doc_id')}) as r from documents), n where r <= n union all select id, 'b' from (select page_id as id, row_number() over (order by {_key(43, 'page_id')}) as r from pages), n where r <= n")
def mix_one_to_one(spark, d):
    return mix.one_to_one(T.table(spark, d, "documents").select(F.col("doc_id").alias("id")), T.table(spark, d, "pages").select(F.col("page_id").alias("id")), "id")


@query("mix_ratio", "with n as (select least((select count(*) from documents), (select count(*) from pages)) as n) select s as _source, n, 0.5::double as share from n, (values ('a'), ('b')) v(s)")
def mix_ratio(spark, d):
    both = mix_one_to_one(spark, d).groupBy("_source").agg(F.count("*").alias("n"))
    return both.crossJoin(F.broadcast(both.agg(F.sum("n").alias("t")))).select("_source", "n", (F.col("n") / F.col("t")).alias("share"))


@query("mix_balance", "with n as (select least((select count(*) from documents), (select count(*) from pages)) as n) select n as a, n as b, 1.0::double as ratio, true as balanced from n")
def mix_balance(spark, d):
    return mix.balance(mix_one_to_one(spark, d))


@query("union_sources", "select _source, count(*) as n from (select 'docs' as _source from documents union all select 'turns' from conversations union all select 'items' from benchmark) group by all")
def union_sources(spark, d):
    return mix.united({"docs": T.table(spark, d, "documents"), "turns": T.table(spark, d, "conversations"), "items": T.table(spark, d, "benchmark")}).groupBy("_source").agg(F.count("*").alias("n"))


@query("train_val_split", f"with r as (select doc_id, row_number() over (order by {_key(42, 'doc_id')}, doc_id) as r, count(*) over () as n from documents) select doc_id, case when r <= n - greatest(1, floor(n * 0.1)) then 'train' else 'val' end as split from r")
def train_val_split(spark, d):
    return mix.split(T.table(spark, d, "documents").select("doc_id"), "doc_id")


@query("split_totals", "with n as (select count(*) as n from documents) select n - greatest(1, floor(n * 0.1))::bigint as train, greatest(1, floor(n * 0.1))::bigint as val, round(greatest(1, floor(n * 0.1)) / n, 9) as realised from n")
def split_totals(spark, d):
    t = train_val_split(spark, d).agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"))
    return t.withColumn("realised", F.round(F.col("val") / (F.col("train") + F.col("val")), 9))


@query("split_sizes", f"with r as (select text, row_number() over (order by {_key(42, 'doc_id')}, doc_id) as r, count(*) over () as n from documents) select case when r <= n - greatest(1, floor(n * 0.1)) then 'train' else 'val' end as split, count(*) as n, round(sum(octet_length(encode(text)) + 1) / 1024, 6) as kb from r group by 1")
def split_sizes(spark, d):
    s = mix.split(T.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return s.groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum(F.octet_length("text") + 1) / 1024, 6).alias("kb"))


@query("split_at_ratio", f"with r as (select doc_id, row_number() over (order by {_key(7, 'doc_id')}, doc_id) as r, count(*) over () as n from documents) select doc_id, case when r <= floor(n * 0.8) then 'train' else 'val' end as split from r")
def split_at_ratio(spark, d):
    return mix.split_at(T.table(spark, d, "documents").select("doc_id"), "doc_id", seed=7)


_TYPES, _LEVELS = [("en", 0.30), ("fr", 0.30), ("de", 0.25), ("es", 0.15)], fixed.COMPLEXITY_RATIOS


@query("stratified_sample", f"""with d as (select doc_id, lang, case when len(string_split(text, chr(10))) < 20 then 'simple' when len(string_split(text, chr(10))) < 100 then 'medium' else 'complex' end as complexity from documents),
a as (select doc_id from (select doc_id, lang, row_number() over (partition by lang order by {_key(42, 'doc_id')}, doc_id) as r from d) where r <= case lang when 'en' then 60 when 'fr' then 60 when 'de' then 50 when 'es' then 30 else 0 end),
m as (select 200 - count(*) as m from a), rest as (select * from d where doc_id not in (select doc_id from a)),
b as (select doc_id from (select doc_id, complexity, row_number() over (partition by complexity order by {_key(43, 'doc_id')}, doc_id) as r from rest), m where r <= case complexity when 'simple' then floor(m * 0.4) when 'medium' then floor(m * 0.45) else floor(m * 0.15) end),
c as (select doc_id from (select doc_id, row_number() over (order by {_key(44, 'doc_id')}) as r from rest where doc_id not in (select doc_id from b)), m where r <= m - (select count(*) from b))
select doc_id, 'type' as _pass from a union all select doc_id, 'level' from b union all select doc_id, 'any' from c""")
def stratified_sample(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "lang", S.complexity(F.col("text")).alias("complexity"))
    return mix.stratified(docs, 200, _TYPES, _LEVELS, "doc_id", type_col="lang").select("doc_id", "_pass")


@query("category_sample", f"select doc_id, source from (select doc_id, source, row_number() over (partition by source order by {_key(42, 'doc_id')}, doc_id) as r from documents) where r <= 3")
def category_sample(spark, d):
    return mix.by_category(T.table(spark, d, "documents").select("doc_id", "source"), 60, "source", 20, "doc_id")


@query("replicate_variants", "select item_id, variant from benchmark, (select unnest(range(0, 3))::int as variant) order by variant, item_id limit 100")
def replicate_variants(spark, d):
    items = T.table(spark, d, "benchmark").select("item_id")
    rows = items.count()
    return mix.replicated(items, min(100, rows * 3), rows, F.col("item_id").asc_nulls_last())


@query("anti_selected", "select doc_id from documents where doc_id not in (select doc_id from labels where quality = 1)")
def anti_selected(spark, d):
    return mix.without(T.table(spark, d, "documents").select("doc_id"), T.table(spark, d, "labels").where("quality = 1"), "doc_id")


@query("pair_train_val", "with f as (select distinct 'out/' || source || case when doc_id // 20 % 2 = 0 then '_train' else '_val' end || '.jsonl' as path from documents), g as (select path, replace(replace(regexp_extract(path, '([^/]*)\\.jsonl', 1), '_train', ''), '_val', '') as dataset from f) select t.dataset, t.path as train, v.path as val from g t join g v on t.dataset = v.dataset where contains(t.path, '_train') and contains(v.path, '_val')")
def pair_train_val(spark, d):
    return mix.paired(T.table(spark, d, "documents").select(F.concat(F.lit("out/"), "source", F.when(F.floor(F.col("doc_id") / 20) % 2 == 0, "_train").otherwise("_val"), F.lit(".jsonl")).alias("path")).distinct())


# Rendering

_SNIP = "case when bare then '' else {h} || case when code = '' then '' else '文件: f.py' || chr(10) || '```python' || chr(10) || code || chr(10) || '```' || chr(10) || chr(10) end end"
_USER = "case when type = 'design' then " + _SNIP.format(h="chr(10) || '参考代码:' || chr(10)") + " || '设计需求: ' || ask else " + _SNIP.format(h="chr(10) || '相关代码:' || chr(10)") + " || ask end"


@query("chatml_text", f"with {T.SAMPLES} select ord, '<|im_start|>system' || chr(10) || '{fixed.SYSTEM_PROMPT}' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {_USER} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || reply || '<|im_end|>' as prompt from s where ask <> '' and reply <> ''")
def chatml_text(spark, d):
    return render.for_training(T.samples(spark, d)).select(F.col("_ord").alias("ord"), render.chatml(F.col("conversation")).alias("prompt"))


@query("sharegpt_train", f"with {T.SAMPLES} select ord, {_USER} as user, reply as assistant, 3 as n from s where ask <> '' and reply <> ''")
def sharegpt_train(spark, d):
    c = F.col("conversation")
    return render.for_training(T.samples(spark, d)).select(F.col("_ord").alias("ord"), c[1]["content"].alias("user"), c[2]["content"].alias("assistant"), F.size(c).alias("n"))


@query("sharegpt_eval", f"with {T.SAMPLES} select ord, {_SNIP.format(h='chr(10) || ' + chr(39) + '相关代码:' + chr(39) + ' || chr(10)')} || ask as user, reply as assistant from s where type = 'qa' and ask <> '' and reply <> ''")
def sharegpt_eval(spark, d):
    c = F.col("conversation")
    return render.for_evaluation(T.samples(spark, d)).select(F.col("_ord").alias("ord"), c[0]["content"].alias("user"), c[1]["content"].alias("assistant"))


@query("dataset_registry", """select distinct source as name, '{"file_name":"' || source || '.json","columns":{"messages":"conversation"},"formatting":"sharegpt","tags":{"role_tag":"role","content_tag":"content","user_tag":"user","assistant_tag":"assistant","system_tag":"system"}}' as entry from documents""")
def dataset_registry(spark, d):
    return render.registry(T.table(spark, d, "documents").select(F.col("source").alias("name"), F.concat("source", F.lit(".json")).alias("file_name")).distinct())


# Generation

def _case(cases: list[tuple[list[str], str]], low: str, **values: str) -> str:
    def text(t: str) -> str:
        out = "'" + t.replace("'", "''") + "'"
        for k, v in values.items():
            out = out.replace("{" + k + "}", f"' || {v} || '")
        return out

    return "case " + " ".join(f"when {' or '.join(f'contains({low}, {chr(39)}{w}{chr(39)})' for w in ws)} then {text(t)}" for ws, t in cases) + " end"


def _pick(kind: str, **values: str) -> str:
    ts = fixed.QUESTIONS[kind]
    whole = lambda t: _case([([""], t)], "''", **values)
    return f"case ('0x' || substring(k, 1, 8))::bigint % {len(ts)} " + " ".join(f"when {i} then {whole(t)}" for i, t in enumerate(ts)) + " end"


_RULES = r"""r as (select doc_id, ['conditional_rule', 'function_rule', 'class_rule'][(doc_id % 3 + 1)::int] as type, coalesce(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda x: x <> '')[1], 'x') as name, substring(text, 1, 20) as cond, doc_id % 2 = 0 as even, lang, source,
  source || '/' || lang || '.py' as file_path, text as code, case when doc_id % 5 = 0 then replace(substring(text, 1, 30), chr(10), ' ') else '' end as doc, md5('42|' || source || '/' || lang || '.py_' || doc_id || '|' || ['conditional_rule', 'function_rule', 'class_rule'][(doc_id % 3 + 1)::int] || '|0') as k, ((length(text) - length(replace(text, 'def ', ''))) / 4)::bigint as n_def from documents)"""


@query("template_choice_answer", f"""with {_RULES} select file_path || '_' || doc_id as rule_id,
case type when 'conditional_rule' then {_pick("conditional_rule", condition="cond", file_path="file_path")} when 'function_rule' then {_pick("function_rule", function_name="name", file_path="file_path")} else {_pick("class_rule", class_name="name", file_path="file_path")} end as question,
case type when 'conditional_rule' then {_case(fixed.CONDITION_ANSWERS, "lower(code)", condition="cond")}
 when 'function_rule' then 'The function ' || name || ' accepts parameters ' || case when even then lang || ', ' || source else 'no parameters' end || case when contains(lower(code), 'return') then ' and returns a value' else '' end || '. ' || case when doc <> '' then doc || '{fixed.FUNCTION_DOCUMENTED}' else {_case(fixed.FUNCTION_ANSWERS, "lower(name)")} end
 else 'The class ' || name || ' ' || case when even then 'inherits from ' || lang else 'is a standalone class' end || case when n_def > 0 then ' with ' || n_def || ' methods' else '' end || '. ' || case when doc <> '' then doc || '{fixed.CLASS_DOCUMENTED}' else {_case(fixed.CLASS_ANSWERS, "lower(name)")} end end as answer from r""")
def template_choice_answer(spark, d):
    s = generate.samples(T.rules(spark, d), "r")
    return s.select(S.rule_id(F.col("code_snippets")[0]["file_path"], F.col("code_snippets")[0]["line_start"]).alias("rule_id"), "question", "answer")


@query("design_demands", "select ord::int as ord, ds[(ord % 10 + 1)::int] || case when ord >= 10 then ' (variant ' || (ord // 10) || ')' else '' end as demand from (select unnest(range(0, 25)) as ord, [" + ", ".join(f"'{x}'" for x in fixed.DEMANDS) + "] as ds)")
def design_demands(spark, d):
    return generate.demands(spark, 25)


@query("mcq_options", "with o as (select item_id, text as r, [text, 'wrong ' || item_id, 'other', 'none'] as os from benchmark), p as (select item_id, r, list_transform(list_sort(list_transform(os, lambda x: {k: md5('42|' || item_id || '|' || x), o: x})), lambda y: y.o) as options from o) select item_id, array_to_string(options, '/') as options, ['A', 'B', 'C', 'D'][list_position(options, r)] as correct_answer from p")
def mcq_options(spark, d):
    b = T.table(spark, d, "benchmark").select("item_id", F.col("text").alias("right"))
    wrong = F.array(F.concat(F.lit("wrong "), F.col("item_id").cast("string")), F.lit("other"), F.lit("none"), F.lit("never"))
    return generate.options(b, "right", wrong, 42, "item_id").select("item_id", F.array_join("options", "/").alias("options"), "correct_answer")


def _fill(t: str, **values: str) -> str:
    return _case([([""], t)], "''", **values)


def _kinds(ts: dict[str, str], **values: str) -> str:
    return "case type " + " ".join(f"when '{k}' then {_fill(ts[k], **values)}" for k in ("conditional_rule", "function_rule", "class_rule")) + " end"


_MCQ = {"condition": "cond", "name": "name", "file_path": "file_path", "params": "(case when even then lang || ', ' || source else 'no parameters' end)", "bases": "(case when even then 'inherits from ' || lang else 'is a standalone class' end)"}


@query("mcq_samples", f"""with {_RULES}, a as (select doc_id, file_path, {_kinds(fixed.CHOICE_QUESTIONS, **_MCQ)} as question, {_kinds(fixed.EXPLANATIONS, **_MCQ)} as explanation,
 case type when 'conditional_rule' then {_case(fixed.CHOICE_CONDITION, "lower(code)", **_MCQ)} when 'function_rule' then case when doc <> '' then {_fill(fixed.CHOICE_FUNCTION[0], **_MCQ)} else {_fill(fixed.CHOICE_FUNCTION[1], **_MCQ)} end else {_fill(fixed.CHOICE_CLASS, **_MCQ)} end as r,
 [{", ".join(_kinds({k: ts[i] for k, ts in fixed.WRONG_ANSWERS.items()}, **_MCQ) for i in range(3))}] as wrong from r),
p as (select *, list_transform(list_sort(list_transform(list_concat([r], wrong), lambda x: {{k: md5('42|' || file_path || '|' || doc_id || '|' || x), o: x}})), lambda y: y.o) as options from a)
select file_path || '_' || doc_id as rule_id, question, array_to_string(options, '/') as options, ['A', 'B', 'C', 'D'][list_position(options, r)] as correct_answer, explanation from p""")
def mcq_samples(spark, d):
    q = choices.questions(T.rules(spark, d))
    return q.select(S.rule_id(F.col("file_path"), F.col("line_start")).alias("rule_id"), "question", F.array_join("options", "/").alias("options"), "correct_answer", "explanation")


def _scheme(kind: str, place: str, file: str = "") -> str:
    return "'" + fixed.SCHEMES[kind].replace("{place}", fixed.PLACES[place][0].replace("{file}", file)).replace("'", "''") + "'"


@query("design_schemes", "with d as (select ord::int as ord, ds[(ord % 10 + 1)::int] || case when ord >= 10 then ' (variant ' || (ord // 10) || ')' else '' end as demand from (select unnest(range(0, 20)) as ord, [" + ", ".join(f"'{x}'" for x in fixed.DEMANDS) + f"""] as ds)) select ord, demand,
 case when contains(lower(demand), 'authentication') then {_scheme("auth_adapter", "auth_adapter", "src/auth.py")} when contains(lower(demand), 'rate-limiting') then {_scheme("rate_adapter", "rate_adapter", "src/adapters.py")}
 when contains(lower(demand), 'logging') then {_scheme("logging", "logging")} when contains(lower(demand), 'caching') then {_scheme("caching", "caching")} when contains(lower(demand), 'error') then {_scheme("error", "error_file", "src/exceptions.py")} else {_scheme("inheritance", "folder", "src0")} end as scheme,
 case when contains(lower(demand), 'auth') then 'Create new file: src/auth_extended.py or extend existing src/auth.py' when contains(lower(demand), 'rate') or contains(lower(demand), 'limit') then 'Create new file: rate_limiter.py or integrate into src/adapters.py'
 when contains(lower(demand), 'log') then 'Create new file: logging_handler.py or utils/logging.py' when contains(lower(demand), 'cache') then 'Create new file: cache_manager.py or utils/cache.py' when contains(lower(demand), 'error') then 'Extend existing src/exceptions.py or create error_handler.py'
 else 'Create new file in src0/ or extend ' || (select lang from documents where doc_id = 0) || '.py' end as storage from d""")
def design_schemes(spark, d):
    path = F.expr("case doc_id when 3 then 'src/auth.py' when 5 then 'src/adapters.py' when 7 then 'src/exceptions.py' else concat(source, '/', lang, '.py') end")
    files = T.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), path.alias("file_path"))
    arch = spark.range(1).select(F.lit(1).alias("adapters"), F.lit(1).alias("inheritance"))
    return choices.schemes(generate.demands(spark, 20), choices.file_facts(files), arch)


_BARE = {k: "'" + fixed.SCHEMES[k].replace("{place}", fixed.PLACES[p][0].replace("{file}", fixed.PLACES[p][1])).replace("'", "''") + "'" for k, p in (("auth", "auth"), ("rate", "rate"), ("logging", "logging"), ("caching", "caching"), ("error", "error"), ("generic", "none"))}


@query("design_schemes_bare", "with d as (select ord::int as ord, ds[(ord + 1)::int] as demand from (select unnest(range(0, 20)) as ord, [" + ", ".join(f"'{x}'" for x in [*fixed.DEMANDS, *fixed.MORE_DEMANDS]) + f"""] as ds)) select ord, case when contains(lower(demand), 'authentication') then {_BARE["auth"]}
 when contains(lower(demand), 'rate-limiting') or contains(lower(demand), 'rate limiting') then {_BARE["rate"]} when contains(lower(demand), 'logging') then {_BARE["logging"]} when contains(lower(demand), 'caching') then {_BARE["caching"]}
 when contains(lower(demand), 'error') then {_BARE["error"]} else {_BARE["generic"]} end as scheme, null::varchar as storage from d""")
def design_schemes_bare(spark, d):
    """A repository without files, adapters or base classes."""
    none = choices.file_facts(spark.createDataFrame([], "ord long, file_path string"))
    arch = spark.range(1).select(F.lit(0).alias("adapters"), F.lit(0).alias("inheritance"))
    return choices.schemes(generate.demands(spark, 20, extended=True), none, arch).drop("demand")


@query("demand_keywords", "select item_id, case when contains(lower(text), 'auth') then 'auth,authentication,token,credential' when contains(lower(text), 'rate') then 'adapter,handler,send,request' when contains(lower(text), 'log') then 'log,logger,debug' when contains(lower(text), 'cache') then 'cache,store,memory' else 'base,class,handler' end as kw from benchmark")
def demand_keywords(spark, d):
    return T.table(spark, d, "benchmark").select("item_id", F.array_join(choices.demand_keywords(F.col("text")), ",").alias("kw"))


@query("mcq_dedup", "select min(doc_id) as doc_id from (select doc_id, 'What is ' || lang || ' of ' || source as q from documents) group by lower(q)")
def mcq_dedup(spark, d):
    q = T.table(spark, d, "documents").select("doc_id", F.concat(F.lit("What is "), "lang", F.lit(" of "), "source").alias("question"))
    return choices.distinct_questions(q, "doc_id").select("doc_id")


@query("distractor_pairs", f"with r as (select item_id::varchar as rule_id, item_id % 3 as type from benchmark) select rule_id, coalesce(lead(rule_id) over w, first(rule_id) over (partition by type order by {_key(42, 'rule_id')} rows between unbounded preceding and unbounded following)) as other from r window w as (partition by type order by {_key(42, 'rule_id')})")
def distractor_pairs(spark, d):
    return generate.distractors(T.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("rule_id"), (F.col("item_id") % 3).alias("type")), 42)


def _vague_sql() -> str:
    out = "t"
    for term, to in fixed.VAGUE_TERMS:
        value = "'" + to.replace("{file_path}", "' || p || '").replace("{line_start}", "' || a || '").replace("{line_end}", "' || b || '").replace("{function}", "' || '函数' || f || '") + "'"
        out = f"replace({out}, '{term}', {value})"
    return out


@query("vague_rewrite", f"with x0 as (select doc_id, text || '这段代码，该函数。此处' || (case when doc_id % 3 = 0 then '此文件' else '' end) as t0, source || '/' || lang || '.py' as p, doc_id as a, doc_id + 3 as b, 'f' || doc_id % 5 as f, text from documents), x as (select *, case when doc_id % 5 = 1 then text || '。end' else t0 end as t from x0), y as (select *, {_vague_sql()} as o from x) select doc_id, case when not contains(o, p) and length(o) > 20 and not (contains(o, '文件') or contains(o, 'file') or contains(o, split_part(p, '/', -1))) and instr(o, '。') > 0 then substring(o, 1, instr(o, '。')) || '在' || p || '文件的第' || a || '行，' || substring(o, instr(o, '。') + 1) else o end as out from y")
def vague_rewrite(spark, d):
    x = T.table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("这段代码，该函数。此处"), F.when(F.col("doc_id") % 3 == 0, "此文件").otherwise("")).alias("t0"), "text", F.concat("source", F.lit("/"), "lang", F.lit(".py")).alias("file_path"), F.col("doc_id").alias("line_start"), (F.col("doc_id") + 3).alias("line_end"), F.concat(F.lit("f"), F.col("doc_id") % 5).alias("f"))
    x = x.withColumn("t", F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit("。end"))).otherwise(F.col("t0")))
    return x.select("doc_id", generate.explicit(F.col("t"), F.col("f")).alias("out"))


# Responses

@query("json_extract_repair", "select event_id, (props->>'k')::int as k from events")
def json_extract_repair(spark, d):
    # A trailing comma behind a fence; an object within one; quotes to mend; both, with a brace in a string before.
    k, n = F.get_json_object("props", "$.k"), F.col("event_id") % 4
    flat = F.concat(F.lit("Here it is: ```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n``` done"))
    nested = F.concat(F.lit('x {"o": {"p": [1, {}]}, "s": "a } b", "k": '), k, F.lit("} y"))
    quoted = F.concat(F.lit("{'k': "), k, F.lit(", 's': 'a'} // no more"))
    both = F.concat(F.lit("{ not this } {'o': {'p': 1,}, 'k': "), k, F.lit(",}"))
    e = T.table(spark, d, "events").select("event_id", F.when(n == 0, flat).when(n == 1, nested).when(n == 2, quoted).otherwise(both).alias("response"))
    return responses.found_json(e, "response").select("event_id", F.get_json_object("json", "$.k").cast("int").alias("k"))


@query("labelled_text", f"with {T.TURNS} select conv_id, {T.sql_strip('q')} as question, {T.sql_strip('a')} as answer from c")
def labelled_text(spark, d):
    t = T.turns(spark, d).select("conv_id", F.concat(F.lit("Question: "), "q", F.lit("\nAnswer: "), "a").alias("t"))
    return t.select("conv_id", responses.labelled(F.col("t")).alias("l")).select("conv_id", "l.question", "l.answer")


@query("structured_trace", f"""with {T.TURNS}, t as (select conv_id, 'Step one' || chr(10) || q || chr(10) || 'THEN ' || a as t from c), l as (select conv_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: {T.sql_strip("x")}), lambda x: x <> '') as ls from t),
m as (select *, list_filter(range(1, least(len(ls), 5) + 1), lambda i: regexp_matches(lower(ls[i]), 'step|步骤|first|首先|then|然后')) as marks from l)
select conv_id, array_to_string(list_transform(marks, lambda i: substring(ls[i], 1, 100)), '|') as actions, array_to_string(list_transform(marks, lambda i: case when i >= len(ls) then '代码分析' else 'f.py 第' || conv_id || '行' end), '|') as evidence,
 array_to_string(list_transform(marks, lambda i: substring(coalesce(ls[i + 1], '基于代码分析得出结论'), 1, 200)), '|') as conclusions, substring(t, 1, 300) as summary from m""")
def structured_trace(spark, d):
    t = T.turns(spark, d).select("conv_id", F.concat(F.lit("Step one\n"), "q", F.lit("\nTHEN "), "a").alias("t"))
    s = t.select("conv_id", traces.of_text(F.col("t"), F.lit("f.py"), F.col("conv_id")).alias("s"))
    part = lambda f: F.array_join(F.transform("s.steps", lambda x: x[f]), "|")
    return s.select("conv_id", part("action").alias("actions"), part("evidence").alias("evidence"), part("conclusion").alias("conclusions"), F.col("s.summary").alias("summary"))


@query("failure_feedback", "with f as (select user_id as rule_id, event_id as attempt, event_type as reason, row_number() over (partition by user_id order by event_id desc) as n from events) select rule_id, string_agg(reason, '; ' order by attempt) as feedback from f where n <= 3 group by rule_id")
def failure_feedback(spark, d):
    e = T.table(spark, d, "events").select(F.col("user_id").alias("rule_id"), F.col("event_id").alias("attempt"), F.array("event_type").alias("reasons"))
    return profile.latest_failures(e)


# Metrics and logs

def _bleu_sql() -> str:
    toks = lambda x: f"list_filter(regexp_split_to_array({x}, '[\\s\\p{{Z}}]+'), lambda x: x <> '')"
    grams = lambda s: f"select conv_id, n, gram, count(*) as k from (select conv_id, n, array_to_string(list_slice({s}, i, i + n - 1), chr(1)) as gram from (select *, unnest(range(1, greatest(len({s}) - n + 2, 1))) as i from t, (select unnest(range(1, 5)) as n))) group by all"
    m = ", ".join(f"sum(least(a.k, b.k)) filter (n = {n}) as m{n}" for n in range(1, 5))
    part = " + ".join(f"ln((case when coalesce(m{n}, 0) = 0 then 0.1::double else m{n} end) / greatest(1, len(c) - {n - 1}))" for n in range(1, 5))
    return f"t as (select conv_id, {toks('q')} as r, {toks('a')} as c from c), a as ({grams('c')}), b as ({grams('r')}), m as (select conv_id, {m} from a join b using (conv_id, n, gram) group by conv_id), bleu as (select conv_id, round(case when coalesce(m1, 0) = 0 then 0 else (case when len(c) > len(r) then 1 else exp(1 - len(r) / len(c)) end) * exp(({part}) / 4) end, 9) as bleu from t left join m using (conv_id))"


@query("bleu_pairs", f"with {T.TURNS}, {_bleu_sql()} select conv_id, bleu from bleu")
def bleu_pairs(spark, d):
    t = T.turns(spark, d).select("conv_id", F.col("q").alias("reference"), F.col("a").alias("candidate"))
    return metrics.bleu()(t).select("conv_id", F.round("bleu", 9).alias("bleu"))


@query("perplexity_mean", "select lang as model, source as test_set, round(coalesce(avg(b), 0.0::double), 9) as bleu, round(coalesce(avg(p) filter (p < 'inf'::double), 'inf'::double), 9) as ppl, count(b) as num_samples from (select lang, source, case when doc_id % 4 > 0 then n_chars / 1000.0::double end as b, case when n < 2 then 'inf'::double else exp(n_chars::double / 100 / n) end as p from (select *, len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda x: x <> '')) as n from documents)) group by all")
def perplexity_mean(spark, d):
    p = T.table(spark, d, "documents").select(F.col("lang").alias("model"), F.col("source").alias("test_set"), F.when(F.col("doc_id") % 4 > 0, F.col("n_chars") / 1000).alias("bleu"), metrics.perplexity(F.col("n_chars") / 100, F.size(S.tokens(F.col("text")))).alias("ppl"))
    return metrics.evaluated(p).withColumns({"ppl": F.round("ppl", 9), "bleu": F.round("bleu", 9)})


_SETS = [*(f"src{k}" for k in range(20)), "none"]


@query("report_pivot", "select model, " + ", ".join(f"coalesce(printf('%.4f', max(b) filter (t = '{t}')), 'N/A') as {t}" for t in _SETS) + " from (select lang as model, source as t, count(*) / 7 as b from documents group by all) group by model")
def report_pivot(spark, d):
    r = T.table(spark, d, "documents").groupBy(F.col("lang").alias("model"), F.col("source").alias("test_set")).agg((F.count("*") / 7).alias("bleu"))
    return metrics.pivoted(r, _SETS, "bleu")


@query("model_grid", "select model, test_set from (select distinct lang as model from documents), (select distinct source as test_set from documents) where exists (select 1 from documents join labels using (doc_id) where lang = model and source = test_set and toxic = 1)")
def model_grid(spark, d):
    docs = T.table(spark, d, "documents").select(F.col("lang").alias("model"), F.col("source").alias("test_set"), "doc_id")
    return metrics.grid(docs.select("model").distinct(), docs.select("test_set").distinct(), docs.join(T.table(spark, d, "labels").where("toxic = 1"), "doc_id"))


_LOG = "e as (select user_id % 10 as run, event_id, case when event_id % 5 = 0 then null else value end as loss, case when event_id % 5 < 2 then value + 1 end as eval_loss, case when event_id % 7 = 0 then null else event_id end as step from events), k as (select *, case when eval_loss is not null then 'eval' when loss is not null then 'train' end as kind from e), l as (select run, kind, coalesce(step, row_number() over (partition by run, kind order by event_id) - 1) as step, coalesce(eval_loss, loss) as loss from k where kind is not null)"


def _states(spark, d):
    e = T.table(spark, d, "events")
    entry = F.struct(F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("step"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("loss"), F.when(F.col("event_id") % 5 < 2, F.col("value") + 1).alias("eval_loss"))
    return e.groupBy((F.col("user_id") % 10).alias("run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("x")))), lambda s: s["x"]).alias("log_history"))


@query("loss_series", f"with {_LOG} select run, kind, step, loss from l")
def loss_series(spark, d):
    return metrics.loss_series(_states(spark, d))


@query("min_eval_loss", f"with {_LOG} select run, min(loss) as min_eval_loss from l where kind = 'eval' group by run")
def min_eval_loss(spark, d):
    return metrics.best(metrics.loss_series(_states(spark, d)))


@query("batch_pass_rate", f"with {T.JUDGED} select type, round(avg((stage is null)::int), 9) as pass_rate from judged group by type")
def batch_pass_rate(spark, d):
    return validate.judged(T.samples(spark, d)).groupBy("type").agg(F.round(F.avg(F.col("failed_stage").isNull().cast("int")), 9).alias("pass_rate"))


# Files

_FILES = "f as (select page_id, split_part(split_part(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '?', 1), '#', 1) || case page_id % 3 when 0 then '.py' when 1 then '/src/x.js' else '/test_y.go' end as path, length(html) * 20 as size from pages)"


def _files(spark, d):
    path = F.expr("concat(split_part(split_part(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '?', 1), '#', 1), case page_id % 3 when 0 then '.py' when 1 then '/src/x.js' else '/test_y.go' end)")
    return T.table(spark, d, "pages").select("page_id", path.alias("path"), (F.length("html") * 20).cast("long").alias("size"))


@query("repo_scan_rank", f"with {_FILES} select path, size from f where page_id % 3 < 2 and regexp_matches(path, '[^/]\\.[^./]+$') and size between 1 and 102400 order by case when contains(lower(path), 'src') then 0 else 1 end, size, path limit 50")
def repo_scan_rank(spark, d):
    return repository.first_files(_files(spark, d).where(repository.wanted()), 50).select("path", "size")


@query("file_routing_plan", f"""with {_FILES}, t as (select page_id || '/' || path as src, split_part(path, '/', -1) as name, case when regexp_matches(split_part(path, '/', -1), '\\.py$') then 'out/py' when regexp_matches(split_part(path, '/', -1), '^x\\.') then 'out/x' end as folder, size / 1048576 as size_mb from f), n as (select *, row_number() over (partition by folder, name order by src) - 1 as n from t)
select src, case when folder is not null then folder || '/' || case when n = 0 then name else substring(name, 1, length(name) - length(regexp_extract(name, '[^.](\\.[^.]*)$', 1))) || '_' || n || regexp_extract(name, '[^.](\\.[^.]*)$', 1) end end as dst, case when folder is null then 'keep' else 'move' end as action, size_mb from n""")
def file_routing_plan(spark, d):
    return profile.routed(_files(spark, d).withColumn("path", F.concat_ws("/", F.col("page_id").cast("string"), "path")), [(r"\.py$", "out/py"), (r"^x\.", "out/x")])


_CODE = "class K{0}(Base, m.Other):\n    '''Doc.'''\n    def run(self, a):\n        if a > {0}:\n            return a\n\ndef top(x, y):\n    import os\n"


def _python(spark, d):
    n = F.col("item_id").cast("string")
    return T.table(spark, d, "benchmark").select(F.concat(F.lit("m"), n, F.lit(".py")).alias("path"), F.when(F.col("item_id") % 4 == 3, F.lit("x = (\n# TODO close\n")).otherwise(F.replace(F.lit(_CODE), F.lit("{0}"), n)).alias("code"))


@query("ast_rules", """select 'm' || item_id || '.py' as file_path, t.type, t.name, case when t.type = 'conditional_rule' then 'a > ' || item_id end as condition, t.line_start, t.line_end from benchmark, (values ('class_rule', 'K', 1, 5), ('function_rule', 'run', 3, 5), ('function_rule', 'top', 7, 8), ('conditional_rule', null, 4, 5)) t(type, name0, line_start, line_end), lateral (select case when t.name0 = 'K' then 'K' || item_id else t.name0 end as name) where item_id % 4 <> 3 union all select 'm' || item_id || '.py', 'comment_rule', null, null, 2, 2 from benchmark where item_id % 4 = 3""".replace("t.name,", "name,"))
def ast_rules(spark, d):
    return extract.rules(_python(spark, d)).select("file_path", "type", "name", "condition", "line_start", "line_end")


@query("ast_structure", "select 'm' || item_id || '.py' as file_path, 'top,run' as functions, 'K' || item_id || ':Base' as classes, 'os' as imports from benchmark where item_id % 4 <> 3")
def ast_structure(spark, d):
    s = extract.structures(_python(spark, d))
    return s.select("file_path", F.array_join(F.transform("functions", lambda f: f["name"]), ",").alias("functions"), F.array_join(F.transform("classes", lambda c: F.concat(c["name"], F.lit(":"), F.array_join(c["bases"], "+"))), ",").alias("classes"), F.array_join("imports", ",").alias("imports"))


# Prompts, designs and snippets

_PROMPT = {
    "kind": "['条件规则', '函数规则', '类规则'][(doc_id % 3 + 1)::int]", "file_path": "file_path", "line_start": "doc_id", "line_end": "(doc_id + 3)", "name": "name", "class_name": "''", "class_line": "''", "function_line": "('函数名: ' || name)",
    "context": "('函数名: ' || name || case when cond <> '' then chr(10) || '条件表达式: ' || cond else '' end)", "code": "substring(code, 1, 1000)",
}


@query("qa_prompts", f"with {_RULES} select doc_id, {_fill(fixed.QA_PROMPT, **_PROMPT)} || case when even then {_fill(fixed.FEEDBACK, feedback=chr(39) + 'too short' + chr(39))} else '' end as prompt from r")
def qa_prompts(spark, d):
    feedback = F.when(F.col("doc_id") % 2 == 0, "too short")
    return prompts.for_rules(T.rules(spark, d), feedback).select("doc_id", "prompt")


def _structures(spark, d):
    names = lambda *cs: F.array(*(F.struct(c.alias("name")) for c in cs))
    none = F.expr("cast(array() as array<struct<name: string>>)")
    docs = T.table(spark, d, "documents")
    classes = F.when(F.col("doc_id") % 3 > 0, names(F.col("lang"), F.col("source"), F.lit("C"), F.lit("D"))).otherwise(none)
    functions = F.when(F.col("doc_id") % 4 > 1, names(F.col("source"), F.lit("g"))).otherwise(none)
    return docs.select(F.col("doc_id").alias("ord"), F.col("source").alias("file_path"), classes.alias("classes"), functions.alias("functions"))


_ARCHITECTURE = """arch as (select coalesce(string_agg(part, chr(10) order by doc_id), '无架构信息') as architecture from (select doc_id, '文件: ' || source || case when doc_id % 3 > 0 then chr(10) || '  类: ' || lang || ', ' || source || ', C' else '' end
 || case when doc_id % 4 > 1 then chr(10) || '  函数: ' || source || ', g' else '' end as part from (select * from documents order by doc_id limit 5) where doc_id % 3 > 0 or doc_id % 4 > 1))"""


@query("architecture_text", f"with {_ARCHITECTURE} select architecture from arch")
def architecture_text(spark, d):
    return profile.architecture_text(_structures(spark, d))


@query("class_count", "select (count(*) filter (doc_id % 3 > 0) * 4)::bigint as n_classes, count(*) filter (doc_id % 3 > 0) * 4 > 5 as many from (select * from documents order by doc_id limit 10)")
def class_count(spark, d):
    return profile.many_classes(_structures(spark, d))


_SHOWN = "'文件: m' || item_id || '.py' || chr(10) || '代码:' || chr(10) || substring(text, 1, 300)"


@query("design_prompts", f"with {_ARCHITECTURE} select item_id, {_fill(fixed.DESIGN_PROMPT, demand='text', architecture='architecture', context=f'(case when item_id % 2 = 0 then {_SHOWN} else {chr(39) * 2} end)')} as prompt from benchmark, arch")
def design_prompts(spark, d):
    none = F.expr("cast(array() as array<struct<file_path: string, code: string>>)")
    snippet = F.array(F.struct(F.concat(F.lit("m"), "item_id", F.lit(".py")).alias("file_path"), F.col("text").alias("code")))
    b = T.table(spark, d, "benchmark").select("item_id", F.col("text").alias("demand"), F.when(F.col("item_id") % 2 == 0, snippet).otherwise(none).alias("code_snippets"))
    return prompts.for_designs(b, profile.architecture_text(_structures(spark, d))).select("item_id", "prompt")


_R = {k: v.replace("'", "''") for k, v in fixed.REASONING.items()}


def _listed(kind: str, value: str) -> str:
    return _fill(fixed.REASONING[kind], list=value)


@query("design_reasoning", f"""select item_id, case when item_id % 3 = 0 then {_listed("patterns", "'adapter, handler'")} else {_listed("patterns", "'modular design'")} end
 || case when item_id % 4 = 0 then {_listed("bases", "array_to_string(list_sort(list_distinct(list_slice(w, 1, 3))), ', ')")} when item_id % 4 = 1 then {_listed("points", "'p1, p2'")} else '{_R["neither"]}' end
 || case when item_id % 5 > 0 then {_listed("files", "('a' || item_id || '.py, c.py')")} else '' end || '{_R["rest"]}' || case when item_id % 2 = 0 then {_listed("storage", "('lib/' || item_id)")} else '' end || '{_R["end"]}' as trace_text
 from (select *, list_filter(regexp_split_to_array(text, '[\\s\\p{{Z}}]+'), lambda x: x <> '') as w from benchmark)""")
def design_reasoning(spark, d):
    none = F.expr("cast(array() as array<string>)")
    n = F.col("item_id")
    words = lambda *ws: F.array(*(F.lit(w) for w in ws))
    b = T.table(spark, d, "benchmark").select(
        "item_id", F.when(n % 3 == 0, words("handler", "adapter", "handler")).otherwise(none).alias("patterns"), F.when(n % 4 == 0, S.tokens(F.col("text"))).otherwise(none).alias("base_classes"),
        F.when(n % 4 <= 1, words("p2", "p1")).otherwise(none).alias("extension_points"), F.when(n % 5 > 0, F.array(F.concat(F.lit("src/a"), n, F.lit(".py")), F.lit(""), F.lit("c.py"), F.lit("d.py"))).otherwise(none).alias("files"),
        F.when(n % 2 == 0, F.concat(F.lit("lib/"), n)).otherwise("").alias("storage"),
    )
    return choices.reasoning(b).select("item_id", "trace_text")


_SNIPPETS = "sn as (select doc_id as ord, source || '/m.py' as file_path, case doc_id % 4 when 0 then 'def f' || doc_id || '(x):' || chr(10) || ' if x > ' || lang || ':' || chr(10) when 1 then 'class K' || doc_id || ':' || chr(10) else '' end || text as code, case when doc_id % 4 = 3 then 'go' else 'python' end as language from documents), nm as (select *, regexp_extract(code, 'def\\s+([\\p{L}\\p{N}_]+)', 1) as f, regexp_extract(code, 'class\\s+([\\p{L}\\p{N}_]+)', 1) as c from sn)"
_HEAD = "substring(array_to_string(list_slice(string_split(code, chr(10)), 1, 20), chr(10)), 1, 500)"


def _snippets(spark, d):
    n = F.col("doc_id")
    start = F.when(n % 4 == 0, F.concat(F.lit("def f"), n, F.lit("(x):\n if x > "), "lang", F.lit(":\n"))).when(n % 4 == 1, F.concat(F.lit("class K"), n, F.lit(":\n"))).otherwise("")
    return T.table(spark, d, "documents").select(n.alias("ord"), F.concat("source", F.lit("/m.py")).alias("file_path"), F.concat(start, "text").alias("code"), F.when(n % 4 == 3, "go").otherwise("python").alias("language"))


def _snippet_case(k: int) -> str:
    t = {x: _fill(v[k], name=n, file_path="file_path") for (x, v), n in zip(fixed.SNIPPET_QA.items(), ("f", "c", "''", "''"), strict=True)}
    return f"case when language <> 'python' then {t['other']} when f <> '' then {t['function']} when c <> '' then {t['class']} else {t['code']} end"


@query("snippet_samples", f"with {_SNIPPETS} select ord, {_snippet_case(0)} as question, {_snippet_case(1)} as answer, {_HEAD} as code, least(20, len(string_split(code, chr(10)))) as line_end, {_fill(fixed.SNIPPET_TRACE, file_path='file_path')} as trace_text from nm")
def snippet_samples(spark, d):
    s = snippets.samples(_snippets(spark, d))
    return s.select("ord", "question", "answer", F.col("code_snippets")[0]["code"].alias("code"), F.col("code_snippets")[0]["line_end"].cast("long").alias("line_end"), "trace_text")


def _typed_sql(kind: str, name: str) -> str:
    q, a = (_fill(t, name=name, file_path="file_path") for t in fixed.SNIPPET_RULES[kind])
    return f"select ord, '{kind}' as rule_type, {q} as question, {a} as answer from nm where language = 'python' and {name} <> ''"


_CONDITION = T.sql_strip("regexp_extract(code, 'if\\s+([^:]+):', 1)")


@query("snippet_typed", f"with {_SNIPPETS} {_typed_sql('conditional_rule', _CONDITION)} union all {_typed_sql('function_rule', 'f')} union all {_typed_sql('class_rule', 'c')}")
def snippet_typed(spark, d):
    every = [snippets.typed(_snippets(spark, d), k) for k in ("conditional_rule", "function_rule", "class_rule")]
    return every[0].union(every[1]).union(every[2]).select("ord", "rule_type", "question", "answer")


def _mcq_side(kind: str, name: str) -> str:
    v = {"name": name, "file_path": "file_path"}
    return f"select ord, file_path, {_fill(fixed.SNIPPET_QA[kind][0], **v)} as question, {_fill(fixed.SNIPPET_RIGHT[kind], **v)} as r, [{', '.join(_fill(t, **v) for t in fixed.SNIPPET_WRONG[kind])}] as wrong from nm where language = 'python' and " + ("f <> ''" if kind == "function" else "f = '' and c <> ''")


@query("snippet_questions", f"""with {_SNIPPETS}, a as ({_mcq_side("function", "f")} union all {_mcq_side("class", "c")}),
 p as (select *, list_transform(list_sort(list_transform(list_concat([r], wrong), lambda x: {{k: md5('42|' || file_path || '|' || ord || '|' || x), o: x}})), lambda y: y.o) as options from a)
 select ord, question, array_to_string(options, '/') as options, ['A', 'B', 'C', 'D'][list_position(options, r)] as correct_answer, {_fill(fixed.SNIPPET_EXPLANATION, file_path="file_path")} as explanation from p""")
def snippet_questions(spark, d):
    return snippets.questions(_snippets(spark, d)).select("ord", "question", F.array_join("options", "/").alias("options"), "correct_answer", "explanation")


_DEMANDS = ", ".join(f"'{x}'" for x in [*fixed.DEMANDS, *fixed.MORE_DEMANDS])


@query("extended_demands", f"select ord::int as ord, case when ord < 20 then ds[(ord + 1)::int] else ds[(ord % 10 + 1)::int] || ' (variant ' || (ord // 10 - 1) || ')' end as demand from (select unnest(range(0, 45)) as ord, [{_DEMANDS}] as ds)")
def extended_demands(spark, d):
    return generate.demands(spark, 45, extended=True)


@query("mix_combined", "with g as (select doc_id as id, 'general' as p from documents), w as (select page_id as id, 'rule' as p from pages union all select item_id, 'llm' from benchmark), n as (select least((select count(*) from g), (select count(*) from w)) as n) select id, p as part from (select *, row_number() over (order by md5('42|' || p || '|' || id), p, id) as r from g), n where r <= n union all select id, p from (select *, row_number() over (order by md5('43|' || p || '|' || id), p, id) as r from w), n where r <= n")
def mix_combined(spark, d):
    ids = lambda t, c: T.table(spark, d, t).select(F.col(c).alias("id"))
    return mix.combined("all", ids("documents", "doc_id"), ids("pages", "page_id"), ids("benchmark", "item_id"), "id").select("id", F.col("_part").alias("part"))


@query("integration_points", "select item_id, array_to_string(list_transform(list_slice(w, 1, 5), lambda x: x || '|Integration point: ' || x || '|Based on architecture analysis'), ';') as points from (select item_id, list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda x: x <> '') as w from benchmark)")
def integration_points(spark, d):
    b = T.table(spark, d, "benchmark").select("item_id", traces.points(S.tokens(F.col("text"))).alias("p"))
    return b.select("item_id", F.array_join(F.transform("p", lambda p: F.concat_ws("|", p["file"], p["description"], p["rationale"])), ";").alias("points"))


@query("design_responses", """select item_id, case item_id % 3 when 0 then 'scheme ' || item_id when 1 then text else substring('{bad ' || text || '}', 1, 500) end as scheme, case item_id % 3 when 0 then (case when item_id % 2 = 0 then 'a.py' else 'b.py|c.py' end) else '' end as points,
 case when item_id % 3 = 0 and item_id % 2 = 0 then 1 else 3 end as n_steps from benchmark""")
def design_responses(spark, d):
    n = F.col("item_id")
    objects = F.concat(F.lit('Sure: {"scheme": "scheme '), n, F.lit('", "reasoning_trace": {"steps": [{"step": 1, "action": "a", "evidence": "e", "conclusion": "c"}], "summary": "s"}, "integration_points": [{"file": "a.py", "description": "d", "rationale": "r"}]}'))
    strings = F.concat(F.lit("```json\n{'scheme': 'scheme "), n, F.lit("', 'reasoning_trace': 'as text', 'integration_points': [\"b.py\", \"c.py\",]}\n```"))
    response = F.when(n % 3 == 0, F.when(n % 2 == 0, objects).otherwise(strings)).when(n % 3 == 1, F.col("text")).otherwise(F.concat(F.lit("{bad "), "text", F.lit("}")))
    r = responses.read_designs(T.table(spark, d, "benchmark").select("item_id", response.alias("response"), F.expr("cast(array() as array<struct<file_path: string>>)").alias("code_snippets")))
    return r.select("item_id", "scheme", F.array_join("rules_extracted", "|").alias("points"), F.size("trace.steps").alias("n_steps"))


@query("sharegpt_skipped", f"with {T.SAMPLES} select count(*) filter (ask <> '' and reply <> '') as converted, count(*) filter (ask = '' or reply = '') as skipped from s")
def sharegpt_skipped(spark, d):
    return render.skipped(T.samples(spark, d))


@query("eval_prefix", f"with {T.SAMPLES} select ord, reply as assistant from s where type = 'qa' and ask <> '' and reply <> '' order by ord limit 50")
def eval_prefix(spark, d):
    return render.for_evaluation(T.samples(spark, d), 50).select(F.col("_ord").alias("ord"), F.col("conversation")[1]["content"].alias("assistant"))


@query("dataset_registries", """with p as (select distinct source as dataset from documents), f as (select dataset, string_agg('"' || dataset || '_' || part || '":{"file_name":"' || dataset || '_' || part || '.json","columns":{"messages":"conversation"},"formatting":"sharegpt","tags":{"role_tag":"role","content_tag":"content","user_tag":"user","assistant_tag":"assistant","system_tag":"system"}}', ',' order by part) as e from p, (values ('train'), ('val')) v(part) group by dataset)
 select a.dataset, '{' || string_agg(b.e, ',' order by b.dataset) || '}' as registry from f a join f b on b.dataset <= a.dataset group by a.dataset""")
def dataset_registries(spark, d):
    name = lambda part: F.concat("source", F.lit(f"_{part}.json")).alias(part)
    return render.registries(T.table(spark, d, "documents").select(F.col("source").alias("dataset"), name("train"), name("val")).distinct())
