"""Samples, rules, files and predictions drawn from the driver's tables, and the same in SQL, for the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions import scalars as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, q, a: the last user and the last assistant text of each conversation."""
    last = lambda role: F.coalesce(F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn"))), F.lit(""))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(last("user").alias("q"), last("assistant").alias("a"))


TURNS = "c as (select conv_id, coalesce(arg_max(text, turn) filter (role = 'user'), '') as q, coalesce(arg_max(text, turn) filter (role = 'assistant'), '') as a from conversations group by conv_id)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as samples, some repeated, marked as variants, without a repository, or with odd snippets."""
    c = turns(spark, sf_dir)
    c = c.withColumn("_ord", F.col("conv_id")).unionByName(c.where("conv_id % 5 = 0").withColumn("_ord", F.col("conv_id") + 100000))
    design = F.col("conv_id") % 4 == 3
    ask = F.concat("q", F.when(F.col("conv_id") % 10 == 7, " (variant 1)").otherwise(""))
    m = (F.col("conv_id") % 3).cast("int")
    snippet = F.struct(F.lit("f.py").alias("file_path"), m.alias("line_start"), (m + (F.col("conv_id") % 2).cast("int")).alias("line_end"), F.substr("a", F.lit(1), (F.col("conv_id") % 25).cast("int")).alias("code"))
    return c.select(
        "_ord", F.when(design, "design").otherwise("qa").alias("type"), F.when(~design, ask).alias("question"), F.when(~design, F.col("a")).alias("answer"), F.when(design, ask).alias("demand"), F.when(design, F.col("a")).alias("scheme"),
        F.substring("a", 1, 40).alias("trace_text"), F.expr("cast(null as struct<steps: array<struct<action: string, evidence: string, conclusion: string>>, summary: string>)").alias("trace"),
        F.when(F.col("conv_id") % 11 == 0, "").otherwise("r").alias("repository"), F.lit("python").alias("language"), F.when(F.col("conv_id") % 9 == 1, F.expr("cast(array() as array<struct<file_path: string, line_start: int, line_end: int, code: string>>)")).otherwise(F.array(snippet)).alias("code_snippets"),
    )


_STOP = "[" + ",".join(f"'{w}'" for w in fixed.STOP_WORDS) + "]"


def sql_keywords(text: str) -> str:
    return f"list_slice(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+') and length(w) > 3 and not list_contains({_STOP}, w)), 1, 5)"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


SAMPLES = (
    TURNS
    + """, o as (select *, conv_id as ord from c union all select *, conv_id + 100000 as ord from c where conv_id % 5 = 0),
s as (select ord, conv_id, case when conv_id % 4 = 3 then 'design' else 'qa' end as type, q || case when conv_id % 10 = 7 then ' (variant 1)' else '' end as ask, a as reply,
  substring(a, 1, 40) as trace_text, case when conv_id % 11 = 0 then '' else 'r' end as repository, conv_id % 9 = 1 as bare, conv_id % 3 as line_start, conv_id % 3 + conv_id % 2 as line_end, substring(a, 1, (conv_id % 25)::int) as code from o)"""
)

JUDGED = (
    SAMPLES
    + f""", b as (select *, case when length(ask) < 10 then 'question' when length(reply) < 20 then 'answer' when length(trace_text) < 30 then 'trace' when repository = '' then 'repository' end as basic,
  case when type = 'design' then {sql_strip("lower(ask)")} else {sql_strip("split_part(" + sql_strip("lower(ask)") + ", '(variant', 1)")} end as k, {sql_keywords("ask")} as kw from s),
d as (select *, row_number() over (partition by type, k order by ord) > 1 and not (type = 'qa' and contains(lower(ask), '(variant')) as dup from b where basic is null),
j as (select ord, type, case when dup then 'duplicate'
  when not (len(kw) = 0 or len(list_filter(list_slice(kw, 1, case when type = 'design' then 2 else 3 end), lambda w: contains(lower(reply), w))) > 0) then 'logic'
  when not (bare or (length({sql_strip("code")}) >= 10 and line_start > 0 and line_end >= line_start)) then 'code' end as stage from d),
judged as (select ord, type, stage, stage as reason from j union all select ord, type, 'basic', basic from b where basic is not null)"""
)


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rules of three kinds, in place of code."""
    d = table(spark, sf_dir, "documents")
    kind = F.get(F.array(*(F.lit(x) for x in ("conditional_rule", "function_rule", "class_rule"))), (F.col("doc_id") % 3).cast("int"))
    word = F.get(S.tokens(F.col("text")), F.lit(0))
    return d.select(
        "doc_id", kind.alias("type"), F.coalesce(word, F.lit("x")).alias("name"), F.substring("text", 1, 20).alias("condition"), F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.expr("cast(array() as array<string>)")).alias("parameters"),
        F.when(F.col("doc_id") % 2 == 0, F.array("lang")).otherwise(F.expr("cast(array() as array<string>)")).alias("bases"), F.concat("source", F.lit("/"), "lang", F.lit(".py")).alias("file_path"),
        F.col("doc_id").cast("int").alias("line_start"), (F.col("doc_id") + 3).cast("int").alias("line_end"), F.col("text").alias("code"), F.when(F.col("doc_id") % 5 == 0, F.substring("text", 1, 30)).otherwise("").alias("docstring"), F.col("lang").alias("description"),
    )
