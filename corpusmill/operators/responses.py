"""Model responses: JSON in free text found, repaired and read, with fallbacks; and the bounded generate-and-validate loop."""

from __future__ import annotations

import json
import re
import sys
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions import scalars as S
from corpusmill.operators import mix, traces

SAMPLE = "question string, answer string, trace struct<steps: array<struct<step: int, action: string, evidence: string, conclusion: string>>, summary: string>"


def repaired(c: Column) -> Column:
    """Without comments and trailing commas, single quotes of keys and values doubled.

    Comments go first, so that a comma before one is a trailing comma like any other; // in a quoted URL goes too.
    """
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)//.*?$", ""), r"(?s)/\*.*?\*/", "")
    c = F.regexp_replace(F.regexp_replace(c, r"'([^'\n]*)'(\s*:)", '"$1"$2'), r"(:\s*)'([^'\n]*)'", '$1"$2"')
    return F.regexp_replace(c, r",(\s*[}\]])", "$1")


def unfenced(c: Column) -> Column:
    return F.regexp_replace(S.text_of(c), r"```(?:json)?", "")


def balanced(text: str) -> Iterator[str]:
    """The spans from an opening brace to its match, strings read over, outermost first and in order."""
    depth = start = 0
    quoted = escaped = False
    for k, c in enumerate(text):
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start, depth = (k if not depth else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                yield text[start : k + 1]


def found_json(df: DataFrame, text: str, into: str = "json") -> DataFrame:
    """``df`` with the first balanced object in a text that can be parsed, as it is or repaired; else null.

    In built-ins where the text is an object, or holds one without braces inside; by a scan of the braces in Arrow batches for the others.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    @F.pandas_udf("string")
    def scan(texts: pd.Series, mended: pd.Series) -> pd.Series:
        def first(t: str | None) -> str | None:
            for span in balanced(t or ""):
                for s in (span, re.sub(r",(\s*[}\]])", r"\1", span)):
                    try:
                        json.loads(s)
                        return s
                    except ValueError:
                        continue
            return None

        return pd.Series([None if t is None else first(t) or first(m) for t, m in zip(texts, mended, strict=True)], dtype=object)

    d = df.withColumn("_t", unfenced(F.col(text)))
    flat = F.nullif(F.regexp_extract("_t", r"^[^{}]*(\{[^{}]*\})", 1), F.lit(""))
    ok = lambda c: F.try_parse_json(c).isNotNull()
    # Each generated once, so that what follows doesn't work it out again.
    once = lambda c: F.explode(F.array(c))
    d = d.withColumn("_flat", once(F.struct(flat.alias("a"), repaired(flat).alias("b"))))
    d = d.withColumn("_easy", once(F.when(ok(F.col("_flat.a")), F.col("_flat.a")).when(ok(F.col("_flat.b")), F.col("_flat.b"))))
    # The scan sees the texts that are left, as they are and repaired; the others are null to it.
    left = F.when(F.col("_easy").isNull(), F.struct(F.col("_t").alias("a"), repaired(F.col("_t")).alias("b")))
    return d.withColumn(into, F.coalesce("_easy", scan(left["a"], left["b"]))).drop("_t", "_flat", "_easy")


def labelled(c: Column) -> Column:
    """question and answer of plain text with such labels, in either language."""
    part = lambda own, nxt: S.strip(F.regexp_extract(S.text_of(c), rf"(?is)(?:^|\n)\s*(?:{own})\s*[:：]\s*(.*?)(?=\n\s*(?:{nxt})\s*[:：]|\z)", 1))
    every = "question|问题|answer|答案|reasoning|推理"
    return F.struct(part("question|问题", every).alias("question"), part("answer|答案", every).alias("answer"), part("reasoning|推理", every).alias("trace_text"))


def read_responses(df: DataFrame, text: str = "response", path: str = "file_path", line: str = "line_start") -> DataFrame:
    """``df`` with question, answer and trace: from JSON, else from labels, else the whole text as answer."""
    d = found_json(df, text, "_json")
    parsed = F.from_json("_json", SAMPLE)
    plain = labelled(F.col(text))
    blank = lambda c: F.nullif(c, F.lit(""))
    d = d.withColumns({"_p": parsed, "_l": plain})
    return d.withColumns({"question": F.coalesce(blank(F.col("_p.question")), F.col("_l.question")), "answer": F.coalesce(blank(F.col("_p.answer")), blank(F.col("_l.answer")), S.text_of(text)), "trace": F.coalesce("_p.trace", traces.of_rule(F.col(path), F.col(line) if line in df.columns else F.lit(1)))}).drop("_p", "_l", "_json")


def read_designs(df: DataFrame, text: str = "response", snippets: str = "code_snippets") -> DataFrame:
    """``df`` with scheme, trace, integration_points and rules_extracted: from JSON, else the text as scheme (its first 500
    characters where it looks like an object that can't be read) with the default trace.

    A trace without steps is the default one.  Points that are strings become objects, five at most.  Vague terms are named by the snippets' paths.
    """
    d = found_json(df, text, "_json")
    step = "struct<step: int, action: string, evidence: string, conclusion: string>"
    point = "array<struct<file: string, description: string, rationale: string>>"
    parsed = F.from_json("_json", f"scheme string, reasoning_trace struct<steps: array<{step}>, summary: string>, integration_points array<string>")
    paths = F.transform(F.coalesce(F.col(snippets), F.array().cast(df.schema[snippets].dataType)), lambda s: S.text_of(s["file_path"]))
    default = traces.of_design(F.get(paths, F.lit(0)))
    d = d.withColumn("_p", parsed).withColumn("_d", default).withColumn("_paths", paths)
    whole = F.when(S.text_of(text).rlike(r"(?s)\{.*\}"), F.substring(S.text_of(text), 1, 500)).otherwise(S.text_of(text))
    scheme = traces.explicit_design(F.when(F.col("_json").isNotNull(), S.text_of("_p.scheme")).otherwise(whole), F.col("_paths"))
    own = F.coalesce(F.size("_p.reasoning_trace.steps"), F.lit(0)) > 0
    trace = F.when(own, F.col("_p.reasoning_trace")).otherwise(F.struct(F.col("_d.steps").cast(f"array<{step}>").alias("steps"), F.col("_d.summary").alias("summary")))
    named = lambda c: traces.explicit_design(c, F.col("_paths"))
    steps = F.transform(trace["steps"], lambda s: s.withField("evidence", named(s["evidence"])).withField("conclusion", named(s["conclusion"])))
    points = F.coalesce("_p.integration_points", F.array().cast("array<string>"))
    objects = F.startswith(F.get(points, F.lit(0)), F.lit("{"))
    points = F.when(objects, F.from_json(F.concat(F.lit("["), F.array_join(points, ","), F.lit("]")), point)).otherwise(traces.points(points).cast(point))
    d = d.withColumns({"scheme": F.when(scheme != "", scheme).otherwise(fixed.SCHEME_DEFAULT), "trace": F.struct(steps.alias("steps"), named(trace["summary"]).alias("summary")), "integration_points": points})
    return d.withColumn("rules_extracted", F.transform(F.slice("integration_points", 1, 3), lambda p: p["file"])).drop("_json", "_p", "_d", "_paths")


def kept(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder that the session names; on a local master a temporary one serves."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith(("local[", "local*")) and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def unvalidated(prompts: DataFrame, model: Callable[[list[str]], list[str]], n: int, order: str, passes: int = 10) -> DataFrame:
    """n rows with a response at most, from as many passes over the prompts as that needs, ``passes`` at most; empty responses are left out."""
    rows = prompts.count()
    tries = mix.replicated(prompts, min(n, rows * passes), rows, order)
    return generated(tries, model).where("response != ''").orderBy("variant", order).limit(n)


def generated(prompts: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "prompt") -> DataFrame:
    """``prompts`` with ``response`` from a model that takes a list of prompts: any that can be sent to the executors."""

    @F.pandas_udf("string")
    def ask(p: pd.Series) -> pd.Series:
        return pd.Series(model(p.tolist()))

    return prompts.withColumn("response", ask(F.col(prompt)))


def until_valid(todo: DataFrame, step: Callable[[DataFrame, DataFrame | None], DataFrame], n: int, key: str = "rule_id", rounds: int = 3) -> DataFrame:
    """Rows that ``step(rows, failures)`` marks ``ok``, n at most, from at most ``rounds`` passes over what has failed.

    ``failures`` has the key, attempt and reasons of earlier rounds.  Each round's rows are checkpointed, so the
    model isn't asked again.
    """
    good, failures = None, None
    for attempt in range(rounds):
        out = kept(step(todo, failures))
        passed = out.where("ok").drop("ok", "reasons")
        good = passed if good is None else good.unionByName(passed)
        failed = out.where("not ok").select(key, F.lit(attempt).alias("attempt"), "reasons")
        failures = failed if failures is None else failures.unionByName(failed)
        if good.count() >= n or not failed.limit(1).count():
            break
        todo = todo.join(failed.select(key).distinct(), key, "left_semi")
    return good.limit(n)
