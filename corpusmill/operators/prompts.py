"""What a model is asked: prompts for questions from rules and for designs, with the reasons of earlier failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions import scalars as S
from corpusmill.operators.generate import filled


def _with_feedback(prompt: Column, feedback: Column | None) -> Column:
    if feedback is None:
        return prompt
    return F.concat(prompt, F.when(S.text_of(feedback) != "", filled(fixed.FEEDBACK, {"feedback": S.text_of(feedback)})).otherwise(""))


def for_rules(rules: DataFrame, feedback: Column | None = None) -> DataFrame:
    """``rules`` with ``prompt``.  Fields that the rules haven't are empty; the first line is 1, the last ten lines on."""
    have = set(rules.columns)
    v = {c: S.text_of(c) if c in have else F.lit("") for c in ("file_path", "name", "class_name", "condition", "type")}
    start = F.coalesce(F.col("line_start"), F.lit(1)) if "line_start" in have else F.lit(1)
    end = F.coalesce(F.col("line_end"), start + 10) if "line_end" in have else start + 10
    line = lambda c: F.when(v[c] != "", F.concat(F.lit(fixed.CONTEXT_LINES[c]), v[c]))
    context = F.concat_ws("\n", *(line(c) for c in fixed.CONTEXT_LINES))
    kinds = F.create_map(*(F.lit(x) for kv in fixed.KINDS.items() for x in kv))
    v |= {
        "kind": F.coalesce(F.element_at(kinds, v["type"]), v["type"]), "line_start": start.cast("string"), "line_end": end.cast("string"), "code": F.substring(S.text_of("code"), 1, 1000),
        "context": F.when(context != "", context).otherwise(fixed.NO_CONTEXT), "function_line": F.coalesce(line("name"), F.lit("")), "class_line": F.when(v["class_name"] != "", F.concat(F.lit("类名: "), v["class_name"])).otherwise(""),
    }
    return rules.withColumn("prompt", _with_feedback(filled(fixed.QA_PROMPT, v), feedback))


def for_designs(demands: DataFrame, architecture: DataFrame, feedback: Column | None = None) -> DataFrame:
    """``demands`` (demand, code_snippets) with ``prompt``; ``architecture`` is one row (``profile.architecture_text``).  The first 300 characters of three snippets are shown."""
    snippet = lambda s: F.concat(F.lit("文件: "), S.text_of(s["file_path"]), F.lit("\n代码:\n"), F.substring(S.text_of(s["code"]), 1, 300))
    context = F.coalesce(F.array_join(F.transform(F.slice("code_snippets", 1, 3), snippet), "\n\n"), F.lit(""))
    rows = demands.crossJoin(F.broadcast(architecture.select(F.col("architecture").alias("_architecture"))))
    v = {"demand": S.text_of("demand"), "architecture": F.col("_architecture"), "context": context}
    return rows.withColumn("prompt", _with_feedback(filled(fixed.DESIGN_PROMPT, v), feedback)).drop("_architecture")
