"""Structured traces: defaults, and those read from plain text; vague terms of designs named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions import scalars as S
from corpusmill.operators.generate import filled


def _steps(steps: list[tuple[str, str, str]], values: dict[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("step"), filled(a, values).alias("action"), filled(e, values).alias("evidence"), filled(c, values).alias("conclusion")) for k, (a, e, c) in enumerate(steps, 1)))


def of_rule(file_path: Column, line_start: Column) -> Column:
    values = {"file_path": S.text_of(file_path), "line_start": F.coalesce(line_start, F.lit(1)).cast("string")}
    return F.struct(_steps(fixed.RULE_STEPS, values).alias("steps"), F.lit(fixed.RULE_SUMMARY).alias("summary"))


def of_design(file_path: Column) -> Column:
    path = S.text_of(file_path)
    file, description, rationale = fixed.INTEGRATION_POINT
    point = F.struct(F.when(path != "", path).otherwise(file).alias("file"), F.lit(description).alias("description"), F.lit(rationale).alias("rationale"))
    return F.struct(_steps(fixed.DESIGN_STEPS, {"file_path": path}).alias("steps"), F.array(point).alias("integration_points"), F.lit(fixed.DESIGN_SUMMARY).alias("summary"))


def of_text(text: Column, file_path: Column, line_start: Column, most: int = 5) -> Column:
    """Steps are the lines, of the first few, that hold a step word; the line after concludes."""
    t = S.text_of(text)
    lines = F.array_remove(F.transform(F.split(t, "\n"), S.strip), "")
    place = filled(fixed.PLACE_FORMAT, {"file_path": S.text_of(file_path), "line_start": F.coalesce(line_start, F.lit(1)).cast("string")})
    marked = F.filter(F.transform(F.slice(lines, 1, most), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.lower(s["x"]).rlike("|".join(fixed.STEP_WORDS)))

    def step(s: Column, k: Column) -> Column:
        last = s["i"] >= F.size(lines) - 1
        conclusion = F.coalesce(F.get(lines, s["i"] + 1), F.lit(fixed.STEP_CONCLUSION))
        return F.struct((k + 1).alias("step"), F.substring(s["x"], 1, 100).alias("action"), F.when(last, fixed.STEP_EVIDENCE).otherwise(place).alias("evidence"), F.substring(conclusion, 1, 200).alias("conclusion"))

    only = F.array(F.struct(F.lit(1).alias("step"), F.lit(fixed.ONLY_STEP).alias("action"), place.alias("evidence"), F.when(t != "", F.substring(t, 1, 200)).otherwise(fixed.ONLY_CONCLUSION).alias("conclusion")))
    return F.struct(F.when(F.size(marked) > 0, F.transform(marked, step)).otherwise(only).alias("steps"), F.substring(t, 1, 300).alias("summary"))


def points(texts: Column, most: int = 5) -> Column:
    """Integration points from plain strings: the first few."""
    return F.transform(F.slice(texts, 1, most), lambda p: F.struct(p.alias("file"), filled(fixed.POINT_DESCRIPTION, {"file": p}).alias("description"), F.lit(fixed.POINT_RATIONALE).alias("rationale")))


def explicit_design(text: Column, paths: Column) -> Column:
    """Vague terms of a design text, named by the paths of its snippets; as it is without any."""
    some = F.array_remove(paths, "")
    values = {"file_path": S.text_of(F.get(paths, F.lit(0))), "files": F.array_join(F.slice(some, 1, 3), ", ")}
    out = S.text_of(text)
    for term, to in fixed.VAGUE_DESIGN_TERMS:
        value = filled(to, values) if term != "相关文件" else F.when(F.size(some) > 0, filled(to, values)).otherwise(term)
        out = F.replace(out, F.lit(term), value)
    return F.when(F.coalesce(F.size(paths), F.lit(0)) > 0, out).otherwise(S.text_of(text))
