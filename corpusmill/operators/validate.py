"""Validation, duplicates and keyword checks of samples, with the reason for each failure.

Samples have type, question, answer, demand, scheme, trace_text, trace, repository, code_snippets and an
ordinal (``_ord``).  A null counts as empty.  The order of the steps is part of the meaning: duplicates are ranked
among rows that pass the basic check, and a row that fails a later check still holds its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions import scalars as S


def ask(kind: str = "type") -> Column:
    return F.when(F.col(kind) == "design", S.text_of("demand")).otherwise(S.text_of("question"))


def reply(kind: str = "type") -> Column:
    return F.when(F.col(kind) == "design", S.text_of("scheme")).otherwise(S.text_of("answer"))


def basic_reason(strict: bool = True) -> Column:
    """Null where the row passes.  ``strict``: trace texts alone, and a repository; else structured traces too."""
    q, a, t = ask(), reply(), S.text_of("trace_text")
    known = F.coalesce(F.col("type").isin("qa", "design"), F.lit(False))
    steps, tr = F.when(F.col("type") == "design", 3).otherwise(2), F.col("trace")
    reason = F.when(~known, "type").when(F.length(q) < fixed.MIN_QUESTION, "question").when(F.length(a) < fixed.MIN_ANSWER, "answer")
    if strict:
        return reason.when(F.length(t) < fixed.MIN_TRACE, "trace").when(S.text_of("repository") == "", "repository")
    whole = F.forall(tr["steps"], lambda s: s["action"].isNotNull() & s["evidence"].isNotNull() & s["conclusion"].isNotNull())
    return (
        reason.when(tr.isNull() & (F.length(t) < fixed.MIN_TRACE), "trace")
        .when(tr.isNotNull() & (F.coalesce(F.size(tr["steps"]), F.lit(0)) < steps), "steps")
        .when(tr.isNotNull() & ~whole, "step fields")
        .when(tr.isNotNull() & (F.length(S.text_of(tr["summary"])) < 20), "summary")
    )


def key() -> Column:
    """What equal questions, or demands, have in common."""
    return F.when(F.col("type") == "design", S.strip(F.lower(ask()))).otherwise(S.core_question(ask()))


def variant() -> Column:
    """A question marked as a variant is no duplicate, though it holds its key."""
    return (F.col("type") == "qa") & F.contains(F.lower(ask()), F.lit("(variant"))


def first_of_its_kind(df: DataFrame) -> DataFrame:
    """``df`` with the boolean ``_dup``: an earlier row of its type has the key, and it is no marked variant.

    The least ordinal of a key is found by a partial aggregate and joined by key and ordinal, so a common
    question is no hot key.  Ordinals are those of the rows: no two are equal.
    """
    rows = df.withColumn("_key", key())
    first = rows.groupBy(F.col("type").alias("_t"), F.col("_key").alias("_k")).agg(F.min("_ord").alias("_o"))
    match = F.col("type").eqNullSafe(F.col("_t")) & F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_ord") == F.col("_o"))
    return rows.join(first, match, "left").withColumn("_dup", F.col("_o").isNull() & ~variant()).drop("_key", "_t", "_k", "_o")


def overlaps(strict: bool = True) -> Column:
    """Some of the first keywords (3; for designs 2 if strict) occurs in the reply; no keywords pass."""
    kw = S.keywords(ask())
    n = F.when(F.col("type") == "design", 2 if strict else 3).otherwise(3)
    low = F.lower(reply())
    return (F.size(kw) == 0) | F.exists(F.slice(kw, F.lit(1), n), lambda k: F.contains(low, k))


def snippets_fit(strict: bool = True) -> Column:
    """strict: none pass, lines count from 1 and are needed; else there must be one, and lines may be missing."""
    cs = F.coalesce(F.col("code_snippets"), F.expr("cast(array() as array<struct<file_path: string, line_start: int, line_end: int, code: string>>)"))

    def fits(s: Column) -> Column:
        first, last = F.coalesce(s["line_start"], F.lit(0)), F.coalesce(s["line_end"], F.lit(0))
        rows = ((first > 0) & (last >= first)) if strict else ((first >= 0) & ~((last > 0) & (last < first)))
        return (S.text_of(s["file_path"]) != "") & (F.length(S.strip(S.text_of(s["code"]))) >= fixed.MIN_CODE) & rows

    return F.forall(cs, fits) if strict else (F.size(cs) > 0) & F.forall(cs, fits)


def judged(samples: DataFrame, strict: bool = True) -> DataFrame:
    """``samples`` with failed_stage (null: valid) and reason."""
    df = samples.withColumn("_basic", basic_reason(strict))
    passed = first_of_its_kind(df.where("_basic is null"))
    stage = F.when(F.col("_dup"), "duplicate").when(~overlaps(strict), "logic").when(~snippets_fit(strict), "code")
    passed = passed.withColumn("failed_stage", stage).withColumn("reason", F.col("failed_stage")).drop("_dup")
    failed = df.where("_basic is not null").withColumn("failed_stage", F.lit("basic")).withColumn("reason", F.col("_basic"))
    return passed.unionByName(failed).drop("_basic")


def validate(samples: DataFrame, strict: bool = True) -> DataFrame:
    return judged(samples, strict).where("failed_stage is null").drop("failed_stage", "reason")


def failures(samples: DataFrame, strict: bool = False) -> DataFrame:
    return judged(samples, strict).where("failed_stage is not null").withColumn("reasons", F.array("reason")).drop("reason")


def failure_counts(samples: DataFrame, strict: bool = True) -> DataFrame:
    return judged(samples, strict).groupBy(F.coalesce("failed_stage", F.lit("valid")).alias("stage"), F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def diversity(samples: DataFrame) -> DataFrame:
    """One row: totals by type, distinct snippet files, languages and question classes."""
    files = F.explode_outer(F.transform("code_snippets", lambda s: S.text_of(s["file_path"])))
    n_files = samples.select(files.alias("f")).where("f != ''").agg(F.count_distinct("f").alias("unique_files"))
    q = F.when(F.col("type") == "qa", S.question_class(F.col("question")))
    counts = samples.agg(
        F.count("*").alias("total_samples"), F.count_if(F.col("type") == "qa").alias("qa_count"), F.count_if(F.col("type") == "design").alias("design_count"),
        F.array_sort(F.collect_set(F.nullif(F.col("language"), F.lit("")))).alias("languages"), *(F.count_if(q == k).alias(f"n_{k}") for k in ("what", "how", "why")),
    )
    return counts.crossJoin(n_files)
