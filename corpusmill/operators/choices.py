"""Multiple-choice questions from rules, and design schemes for demands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions import scalars as S
from corpusmill.operators.generate import _first, filled, options


def _by_type(of: dict[str, Column]) -> Column:
    out = of["comment_rule"]
    for kind in ("class_rule", "function_rule", "conditional_rule"):
        out = F.when(F.col("type") == kind, of[kind]).otherwise(out)
    return out


def questions(rules: DataFrame, seed: int = 42, *ids: str) -> DataFrame:
    """Rules with question, right, wrong (the fixed answers in order), options, correct_answer, explanation, code_snippets (500 characters), rule_type and language."""
    v = {c: S.text_of(c) for c in ("condition", "name", "file_path", "description")}
    v["params"] = F.when(F.coalesce(F.size("parameters"), F.lit(0)) > 0, F.array_join("parameters", ", ")).otherwise(fixed.NO_PARAMETERS)
    v["bases"] = F.when(F.coalesce(F.size("bases"), F.lit(0)) > 0, filled(fixed.INHERITS, {"bases": F.array_join("bases", ", ")})).otherwise(fixed.STANDALONE)
    documented, plain = (filled(t, v) for t in fixed.CHOICE_FUNCTION)
    right = {
        "conditional_rule": _first(fixed.CHOICE_CONDITION, F.lower(S.text_of("code")), v), "function_rule": F.when(S.text_of("docstring") != "", documented).otherwise(plain),
        "class_rule": filled(fixed.CHOICE_CLASS, v), "comment_rule": filled(fixed.COMMENT_ANSWER, v),
    }
    fill = lambda ts: _by_type({k: filled(t, v) for k, t in ts.items()})
    wrong = _by_type({k: F.array(*(filled(t, v) for t in ts)) for k, ts in fixed.WRONG_ANSWERS.items()})
    rows = rules.withColumns({"question": fill(fixed.CHOICE_QUESTIONS), "right": _by_type(right), "wrong": wrong, "explanation": fill(fixed.EXPLANATIONS), "rule_type": F.col("type"), "language": S.language_of_path(F.col("file_path"))})
    rows = rows.withColumn("code_snippets", F.array(F.struct("file_path", "line_start", "line_end", F.substring(S.text_of("code"), 1, 500).alias("code"))))
    return options(rows, "right", F.col("wrong"), seed, *(ids or ("file_path", "line_start")))


def distinct_questions(rows: DataFrame, order: str) -> DataFrame:
    """The first row of each question, case and space at the ends aside."""
    key = S.strip(F.lower("question"))
    first = rows.groupBy(key.alias("_k")).agg(F.min(order).alias("_o"))
    return rows.withColumn("_k", key).join(first.withColumnRenamed("_k", "_k2"), (F.col("_k") == F.col("_k2")) & (F.col(order) == F.col("_o")), "left_semi").drop("_k")


def demand_keywords(demand: Column) -> Column:
    out = F.array(*(F.lit(k) for k in fixed.DESIGN_KEYWORDS[-1][1]))
    for words, kw in reversed(fixed.DESIGN_KEYWORDS[:-1]):
        out = F.when(F.contains(F.lower(demand), F.lit(words[0])), F.array(*(F.lit(k) for k in kw))).otherwise(out)
    return out


def reasoning(demands: DataFrame) -> DataFrame:
    """``demands`` (arrays patterns, extension_points, base_classes, files; storage) with ``trace_text``: steps by what there is, each list's values once and in order."""
    r = fixed.REASONING
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    listed = lambda kind, c: filled(r[kind], {"list": F.array_join(c, ", ")})
    known = lambda c: F.array_sort(F.array_distinct(c))
    files = F.transform(F.slice(F.array_remove(F.slice("files", 1, 3), ""), 1, 2), S.basename)
    text = F.concat(
        F.when(some("patterns"), listed("patterns", known("patterns"))).otherwise(filled(r["patterns"], {"list": F.lit(r["no patterns"])})),
        F.when(some("base_classes"), listed("bases", known(F.slice("base_classes", 1, 3)))).when(some("extension_points"), listed("points", known("extension_points"))).otherwise(r["neither"]),
        F.when(some(files), listed("files", files)).otherwise(""), F.lit(r["rest"]),
        F.when(S.text_of("storage") != "", filled(r["storage"], {"list": F.col("storage")})).otherwise(""), F.lit(r["end"]),
    )
    return demands.withColumn("trace_text", text)


def file_facts(snippets: DataFrame) -> DataFrame:
    """One row of (ord, file_path): the first path of all, and those that name auth, adapters and errors; null where there is none."""
    p = F.lower("file_path")
    first = lambda test: F.min_by("file_path", F.when(test, F.col("ord")))
    return snippets.agg(F.min_by("file_path", "ord").alias("first_file"), first(F.contains(p, F.lit("auth"))).alias("auth_file"), first(p.rlike("adapter|handler")).alias("adapter_file"), first(p.rlike("exception|error")).alias("error_file"))


def schemes(demands: DataFrame, facts: DataFrame, architecture: DataFrame) -> DataFrame:
    """``demands`` (demand) with scheme and storage, from one row of file facts and one of ``profile.architecture``."""
    low = F.lower("demand")
    has = lambda *ws: low.rlike("|".join(ws))

    def text(scheme: str, place: str, file: Column | None = None) -> Column:
        template, other = fixed.PLACES[place]
        return filled(fixed.SCHEMES[scheme], {"place": filled(template, {"file": F.coalesce(file, F.lit(other)) if file is not None else F.lit(other)})})

    adapter, auth, error = F.col("adapters") > 0, F.col("auth_file"), F.col("error_file")
    folder = F.when(F.contains("first_file", F.lit("/")), S.dirname(F.col("first_file"))).otherwise(".")
    rest = lambda kind: F.when(S.text_of("first_file") != "", text(kind, "folder", folder)).otherwise(text(kind, "none"))
    scheme = (
        F.when(has("authentication"), F.when(adapter, text("auth_adapter", "auth_adapter", auth)).otherwise(text("auth", "auth", auth)))
        .when(has("rate-limiting", "rate limiting"), F.when(adapter, text("rate_adapter", "rate_adapter", F.col("adapter_file"))).otherwise(text("rate", "rate")))
        .when(has("logging"), text("logging", "logging")).when(has("caching"), text("caching", "caching"))
        .when(has("error"), F.when(error.isNotNull(), text("error", "error_file", error)).otherwise(text("error", "error")))
        .when(F.col("inheritance") > 0, rest("inheritance")).otherwise(rest("generic"))
    )
    extended = F.replace(auth, F.lit(".py"), F.lit("_extended.py"))
    put = lambda kind, **values: filled(fixed.STORAGE[kind], values)
    storage = (
        F.when(F.col("first_file").isNull(), F.lit(None).cast("string"))
        .when(has("auth"), F.when(auth.isNotNull(), put("auth_file", extended=extended, file=auth)).otherwise(put("auth")))
        .when(has("rate", "limit"), F.when(F.col("adapter_file").isNotNull(), put("rate_file", file=F.col("adapter_file"))).otherwise(put("rate")))
        .when(has("log"), put("log")).when(has("cache"), put("cache"))
        .when(has("error", "exception"), F.when(error.isNotNull(), put("error_file", file=error)).otherwise(put("error")))
        .otherwise(put("folder", folder=folder, file=S.basename(F.col("first_file"))))
    )
    return demands.crossJoin(F.broadcast(facts)).crossJoin(F.broadcast(architecture)).withColumns({"scheme": scheme, "storage": storage}).select(*demands.columns, "scheme", "storage")
