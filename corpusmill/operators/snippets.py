"""Questions from snippets of code: (ord, file_path, code, language)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions import scalars as S
from corpusmill.operators import choices, generate, mix
from corpusmill.operators.generate import filled


def python_only(snippets: DataFrame) -> DataFrame:
    return snippets.where(F.coalesce("language", F.lit("python")) == "python")


def _named() -> tuple[Column, Column]:
    """function, class, code (or other, of another language), and the name found."""
    f, c = S.first_function(F.col("code")), S.first_class(F.col("code"))
    python = F.coalesce("language", F.lit("python")) == "python"
    return F.when(~python, "other").when(f != "", "function").when(c != "", "class").otherwise("code"), F.when(f != "", f).otherwise(c)


def _by(kind: Column, of: dict[str, Column]) -> Column:
    out = F.lit(None)
    for k, v in of.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def _shown() -> Column:
    """The first twenty lines, 500 characters at most, as a sample's snippets."""
    return F.array(F.struct(S.text_of("file_path").alias("file_path"), F.lit(1).alias("line_start"), F.least(F.lit(20), F.size(S.lines(F.col("code")))).alias("line_end"), S.head(F.col("code")).alias("code")))


def samples(snippets: DataFrame, repository: str = "") -> DataFrame:
    """A qa sample for each snippet, by what it holds first."""
    kind, name = _named()
    rows = snippets.withColumns({"_kind": kind, "_name": name})
    v = {"name": F.col("_name"), "file_path": S.text_of("file_path")}
    part = lambda k: _by(F.col("_kind"), {x: filled(t[k], v) for x, t in fixed.SNIPPET_QA.items()})
    return rows.select("ord", F.lit("qa").alias("type"), part(0).alias("question"), part(1).alias("answer"), filled(fixed.SNIPPET_TRACE, v).alias("trace_text"), _shown().alias("code_snippets"), F.lit(repository).alias("repository"), F.coalesce("language", F.lit("python")).alias("language"))


def typed(snippets: DataFrame, rule_type: str, repository: str = "") -> DataFrame:
    """A sample of one rule type for each Python snippet that holds such a rule."""
    find = {"conditional_rule": S.first_condition, "function_rule": S.first_function, "class_rule": S.first_class}
    if rule_type not in find:
        return samples(snippets.limit(0), repository).withColumn("rule_type", F.lit(rule_type))
    rows = python_only(snippets).withColumn("_name", find[rule_type](F.col("code"))).where("_name != ''")
    v = {"name": F.col("_name"), "file_path": S.text_of("file_path"), "rule_type": F.lit(rule_type)}
    q, a = fixed.SNIPPET_RULES[rule_type]
    return rows.select("ord", F.lit("qa").alias("type"), filled(q, v).alias("question"), filled(a, v).alias("answer"), filled(fixed.SNIPPET_RULE_TRACE, v).alias("trace_text"), _shown().alias("code_snippets"), F.lit(repository).alias("repository"), F.lit("python").alias("language"), F.lit(rule_type).alias("rule_type"))


def questions(snippets: DataFrame, seed: int = 42) -> DataFrame:
    """A multiple-choice question for each Python snippet with a function, else a class."""
    kind, name = _named()
    rows = python_only(snippets).withColumns({"_kind": kind, "_name": name}).where("_kind in ('function', 'class')")
    v = {"name": F.col("_name"), "file_path": S.text_of("file_path")}
    wrong = _by(F.col("_kind"), {k: F.array(*(filled(t, v) for t in ts)) for k, ts in fixed.SNIPPET_WRONG.items()})
    asked = _by(F.col("_kind"), {k: filled(fixed.SNIPPET_QA[k][0], v) for k in fixed.SNIPPET_WRONG})
    right = _by(F.col("_kind"), {k: filled(t, v) for k, t in fixed.SNIPPET_RIGHT.items()})
    rows = rows.withColumns({"question": asked, "_right": right, "explanation": filled(fixed.SNIPPET_EXPLANATION, v), "code_snippets": _shown()})
    return generate.options(rows, "_right", wrong, seed, "file_path", "ord").drop("_kind", "_name", "_right")


def cycled(rules: DataFrame, snippets: DataFrame, n: int, order: str = "ord", variations: int = 10, seed: int = 42) -> DataFrame:
    """n distinct questions at most: of the rules in order, then of their variations, then of the snippets.

    A variation adds (variant k) to the description, so only rules whose question names it give new ones.
    """
    marked = F.when(F.col("variant") > 0, F.concat(S.text_of("description"), F.lit(" (variant "), F.col("variant").cast("string"), F.lit(")"))).otherwise(S.text_of("description"))
    every = rules.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variations)))).withColumn("description", marked)
    columns = ["question", "options", "correct_answer", "explanation", F.col(order).alias("ord")]
    first = choices.questions(every, seed, "file_path", "line_start", "variant").select(*columns, "variant")
    then = questions(snippets, seed).select(*columns, F.lit(variations + 1).alias("variant"))
    place = F.struct("variant", "ord")
    rows = first.unionByName(then).withColumn("place", place)
    return choices.distinct_questions(rows, "place").orderBy("place").limit(n).drop("place")


def injected(rule_samples: DataFrame, snippet_samples: DataFrame, n: int, order: str, seed: int = 42) -> DataFrame:
    """n samples of few rules: every tenth from the second ten on is one of a snippet, picked by hash, as far as there are any."""
    more = mix.fixed_sample(snippet_samples, max(0, n - 1) // 10, seed, order)
    k = more.count()  # a tenth of n at most
    return rule_samples.orderBy(order).limit(n - k).unionByName(more, allowMissingColumns=True)


def halves(rules: DataFrame, snippets: DataFrame, n: int, seed: int = 42, repository: str = "") -> DataFrame:
    """n samples at most: as many as half of them from rules, the rest from snippets, either chosen by hash."""
    some = mix.fixed_sample(rules, n // 2, seed, "file_path", "line_start", "type")
    rest = n - some.count()  # n at most
    columns = ["type", "question", "answer", "trace_text", "code_snippets", "repository", "language"]
    return generate.samples(some, repository, seed).select(columns).unionByName(samples(mix.fixed_sample(snippets, rest, seed + 1, "file_path", "ord"), repository).select(columns))
