"""Conversations and prompts from samples."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions import scalars as S


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_content(snippets: Column) -> Column:
    design = F.concat(S.fenced(snippets, fixed.DESIGN_HEADER), F.lit(fixed.DEMAND_PREFIX), S.text_of("demand"))
    return F.when(F.col("type") == "design", design).otherwise(F.concat(S.fenced(snippets, fixed.QA_HEADER), S.text_of("question")))


def _type() -> Column:
    return F.coalesce("type", F.lit("qa"))


def trainable() -> Column:
    qa = (_type() == "qa") & (S.text_of("question") != "") & (S.text_of("answer") != "")
    return qa | ((_type() == "design") & (S.text_of("demand") != "") & (S.text_of("scheme") != ""))


def for_training(samples: DataFrame, system: str = fixed.SYSTEM_PROMPT) -> DataFrame:
    """``samples`` that can be converted, with ``conversation``: system, user and assistant."""
    reply = F.when(_type() == "design", F.col("scheme")).otherwise(F.col("answer"))
    rows = samples.where(trainable()).withColumn("type", _type())
    return rows.withColumn("conversation", F.array(_message("system", F.lit(system)), _message("user", user_content(F.col("code_snippets"))), _message("assistant", reply)))


def skipped(samples: DataFrame) -> DataFrame:
    """One row: how many samples can be converted, and how many can't."""
    return samples.agg(F.count_if(F.coalesce(trainable(), F.lit(False))).alias("converted"), F.count_if(~F.coalesce(trainable(), F.lit(False))).alias("skipped"))


def for_evaluation(samples: DataFrame, most: int | None = None) -> DataFrame:
    """User and assistant, from question and answer whatever the type; of the first samples in order, where a number is given."""
    rows = samples.where(F.col("type").isin("qa", "design") & (S.text_of("question") != "") & (S.text_of("answer") != ""))
    user = F.concat(S.fenced(F.col("code_snippets"), fixed.QA_HEADER), F.col("question"))
    rows = rows.withColumn("conversation", F.array(_message("user", user), _message("assistant", F.col("answer"))))
    return rows if most is None else rows.orderBy("_ord").limit(most)


def chatml(conversation: Column, generation_prompt: bool = False) -> Column:
    turns = F.transform(conversation, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>")))
    return F.concat(F.array_join(turns, "\n"), F.lit("\n<|im_start|>assistant\n" if generation_prompt else ""))


def canonical(samples: DataFrame) -> DataFrame:
    """The fields of a sample in their fixed order, empty where they are missing."""
    have = set(samples.columns)
    text = lambda c: S.text_of(c) if c in have else F.lit("")
    return samples.select(*(text(c).alias(c) for c in ("type", "question", "answer", "demand", "scheme", "trace_text")), *(c for c in ("code_snippets", "trace", "metadata") if c in have))


def prompted(df: DataFrame, conversation: str = "conversation", template: Callable[[list[dict]], str] | None = None) -> DataFrame:
    """``df`` with ``prompt``: the user's and assistant's messages by a template that takes them as dicts, with the reply begun; ChatML where none is given."""
    messages = F.filter(conversation, lambda m: m["role"].isin("user", "assistant"))
    if template is None:
        return df.withColumn("prompt", chatml(messages, generation_prompt=True))

    @F.pandas_udf("string")
    def put(each: pd.Series) -> pd.Series:
        return pd.Series([template(json.loads(x)) for x in each], dtype=object)

    return df.withColumn("prompt", put(F.to_json(F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))))


def tokenised(df: DataFrame, text: str, tokenizer: Callable[[list[str]], list[list[int]]], max_length: int = 2048) -> DataFrame:
    """``df`` with input_ids, cut to a length, and labels, which are the same; any tokenizer that can be sent to the executors."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([x[:max_length] for x in tokenizer(texts.fillna("").tolist())])

    return df.withColumn("input_ids", ids(F.col(text))).withColumn("labels", F.col("input_ids"))


def registries(pairs: DataFrame) -> DataFrame:
    """A row for each pair of ``mix.paired`` (dataset, train, val), in order: the registry of its files and of those of all pairs before, as JSON.  For the few datasets of a run."""
    files = pairs.select("dataset", F.explode(F.array(F.struct(F.lit("train").alias("part"), F.col("train").alias("file_name")), F.struct(F.lit("val").alias("part"), F.col("val").alias("file_name")))).alias("f")).where("f.file_name is not null")
    entries = registry(files.select("dataset", F.concat_ws("_", "dataset", "f.part").alias("name"), "f.file_name"), "dataset")
    own = entries.groupBy("dataset").agg(F.array_sort(F.collect_list(F.concat(F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(":"), F.col("entry")))).alias("own"))
    upto = Window.orderBy("dataset").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("dataset", F.concat(F.lit("{"), F.array_join(F.flatten(F.collect_list("own").over(upto)), ","), F.lit("}")).alias("registry"))


def registry(datasets: DataFrame, *more: str) -> DataFrame:
    """One row a dataset (name, file_name) with the entry that trainers read."""
    entry = F.struct(
        "file_name", F.struct(F.lit("conversation").alias("messages")).alias("columns"), F.lit("sharegpt").alias("formatting"),
        F.struct(F.lit("role").alias("role_tag"), F.lit("content").alias("content_tag"), F.lit("user").alias("user_tag"), F.lit("assistant").alias("assistant_tag"), F.lit("system").alias("system_tag")).alias("tags"),
    )
    return datasets.select(*more, "name", F.to_json(entry).alias("entry"))
