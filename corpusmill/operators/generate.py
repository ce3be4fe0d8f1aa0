"""Samples from rules: questions, answers and traces by template, variants, options; all choices by hash."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions import scalars as S
from corpusmill.operators.mix import ranked


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} places filled by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p] if k % 2 else F.lit(p) for k, p in enumerate(parts) if k % 2 or p))


def chosen(options: list[Column], key: Column) -> Column:
    """One of the options, by the first eight hex digits of a key."""
    return F.element_at(F.array(*options), (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % len(options)).cast("int") + 1)


def _first(cases: list[tuple[list[str], str]], low: Column, values: dict[str, Column]) -> Column:
    out = F.lit("")
    for words, answer in reversed(cases):
        test = F.lit(False)
        for w in words:
            test = test | F.contains(low, F.lit(w))
        out = F.when(test, filled(answer, values)).otherwise(out)
    return out


def answer() -> Column:
    """Of a rule row, by its type."""
    code, name = F.lower(S.text_of("code")), S.text_of("name")
    condition = _first(fixed.CONDITION_ANSWERS, code, {"condition": S.text_of("condition")})
    doc = F.replace(F.substring(S.text_of("docstring"), 1, 150), F.lit("\n"), F.lit(" "))
    params = F.when(F.coalesce(F.size("parameters"), F.lit(0)) > 0, F.array_join("parameters", ", ")).otherwise(fixed.NO_PARAMETERS)
    returns = F.when(F.contains(code, F.lit("return")), fixed.RETURNS).otherwise("")
    function = F.concat(filled(fixed.FUNCTION_START, {"name": name, "params": params, "returns": returns}), F.when(doc != "", F.concat(doc, F.lit(fixed.FUNCTION_DOCUMENTED))).otherwise(_first(fixed.FUNCTION_ANSWERS, F.lower(name), {})))
    bases = F.when(F.coalesce(F.size("bases"), F.lit(0)) > 0, filled(fixed.INHERITS, {"bases": F.array_join("bases", ", ")})).otherwise(fixed.STANDALONE)
    n = S.occurrences(F.col("code"), "def ")
    methods = F.when(n > 0, filled(fixed.METHODS, {"n": n.cast("string")})).otherwise("")
    cls = F.concat(filled(fixed.CLASS_START, {"name": name, "bases": bases, "methods": methods}), F.when(doc != "", F.concat(doc, F.lit(fixed.CLASS_DOCUMENTED))).otherwise(_first(fixed.CLASS_ANSWERS, F.lower(name), {})))
    comment = filled(fixed.COMMENT_ANSWER, {"description": S.text_of("description")})
    kind = F.col("type")
    return F.when(kind == "conditional_rule", condition).when(kind == "function_rule", function).when(kind == "class_rule", cls).otherwise(comment)


def question(key: Column) -> Column:
    values = {"condition": S.text_of("condition"), "file_path": S.text_of("file_path"), "function_name": S.text_of("name"), "class_name": S.text_of("name"), "description": S.text_of("description")}
    out = F.lit("")
    for kind, templates in fixed.QUESTIONS.items():
        out = F.when(F.col("type") == kind, chosen([filled(t, values) for t in templates], key)).otherwise(out)
    return out


def trace() -> Column:
    values = {"file_path": S.text_of("file_path"), "name": S.text_of("name")}
    out = filled(fixed.TRACES["comment_rule"], values)
    for kind, t in fixed.TRACES.items():
        out = F.when(F.col("type") == kind, filled(t, values)).otherwise(out)
    return out


def samples(rules: DataFrame, repository: str, seed: int = 42) -> DataFrame:
    """A qa sample for each rule; a rule's ``variant`` above 0 is named in its question, and as a context in its description."""
    v = F.col("variant") if "variant" in rules.columns else F.lit(0)
    described = S.text_of("description")
    rules = rules.withColumn("description", F.when((v > 0) & (described != ""), F.concat(described, F.lit(" (context "), v.cast("string"), F.lit(")"))).otherwise(described))
    key = S.order_key(seed, S.rule_id(F.col("file_path"), F.col("line_start")), F.col("type"), v.cast("string"))
    q = question(key)
    snippet = F.struct("file_path", "line_start", "line_end", F.substring(S.text_of("code"), 1, 500).alias("code"))
    return rules.select(
        F.lit("qa").alias("type"), F.when(v > 0, F.concat(q, F.lit(" (variant "), v.cast("string"), F.lit(")"))).otherwise(q).alias("question"), answer().alias("answer"),
        F.lit(None).cast("string").alias("demand"), F.lit(None).cast("string").alias("scheme"), trace().alias("trace_text"),
        F.array(snippet).alias("code_snippets"), F.lit(repository).alias("repository"), S.language_of_path(F.col("file_path")).alias("language"), F.col("type").alias("rule_type"),
        F.array(S.text_of("description")).alias("rules_extracted"),
    )


def demands(spark, n: int, extended: bool = False) -> DataFrame:
    """ord, demand: the fixed demands (``extended``: and ten more after the first pass), then with (variant k), n in all."""
    base = spark.createDataFrame(list(enumerate(fixed.DEMANDS)), "k int, demand string")
    passes = -(-n // len(fixed.DEMANDS))
    rows = base.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(max(passes - 1, 0)))))
    rows = rows.withColumn("demand", F.when(F.col("variant") > 0, F.concat("demand", F.lit(" (variant "), F.col("variant").cast("string"), F.lit(")"))).otherwise(F.col("demand")))
    more = len(fixed.MORE_DEMANDS) if extended else 0
    rows = rows.select((F.col("variant") * len(fixed.DEMANDS) + F.col("k") + F.when(F.col("variant") > 0, more).otherwise(0)).alias("ord"), "demand")
    if extended:
        rows = rows.union(spark.createDataFrame(list(enumerate(fixed.MORE_DEMANDS, len(fixed.DEMANDS))), "ord int, demand string"))
    return rows.orderBy("ord").limit(n)


def options(df: DataFrame, right: str, wrong: Column, seed: int, *ids: str) -> DataFrame:
    """``df`` with options (four, in hashed order) and correct_answer (the letter): the right one and the first three wrong ones."""
    every = F.concat(F.array(F.col(right)), F.slice(wrong, 1, 3))
    placed = F.array_sort(F.transform(every, lambda o: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids), o)).alias("k"), o.alias("o"))))
    letters = F.array(*(F.lit(x) for x in "ABCD"))
    df = df.withColumn("options", F.transform(placed, lambda x: x["o"]))
    return df.withColumn("correct_answer", F.element_at(letters, F.array_position("options", F.col(right)).cast("int")))


def distractors(rules: DataFrame, seed: int) -> DataFrame:
    """rule_id, other: another rule of the type for each rule, the next in hashed order (the last takes the first)."""
    # Types are few, so rules are ranked by ranges of the order and meet the next rank, not in a window of their type.
    rows = ranked(rules.select("rule_id", "type"), seed, "rule_id", by=["type"])
    last = rules.groupBy(F.col("type").alias("_type")).agg(F.count("*").alias("_last"))
    asked = rows.join(F.broadcast(last), F.col("type").eqNullSafe(F.col("_type"))).withColumn("_next", F.when(F.col("_rank") < F.col("_last"), F.col("_rank") + 1).otherwise(1))
    other = rows.select(F.col("rule_id").alias("other"), F.col("type").alias("_of"), F.col("_rank").alias("_at"))
    return asked.join(other, F.col("type").eqNullSafe(F.col("_of")) & (F.col("_next") == F.col("_at"))).where("other != rule_id").select("rule_id", "other")


def explicit(text: Column, function: Column) -> Column:
    """Vague terms of a text about a rule, named by its file, lines and function."""
    values = {"file_path": S.text_of("file_path"), "line_start": F.col("line_start").cast("string"), "line_end": F.col("line_end").cast("string")}
    values["function"] = F.when(S.text_of(function) != "", F.concat(F.lit("函数"), function)).otherwise(filled("{file_path}文件第{line_start}行的函数", values))
    out = S.text_of(text)
    for term, to in fixed.VAGUE_TERMS:
        out = F.replace(out, F.lit(term), filled(to, values))
    path = values["file_path"]
    named = F.contains(out, F.lit("文件")) | F.contains(out, F.lit("file")) | F.contains(out, S.basename(path))
    place = F.instr(out, "。")
    put = F.concat(F.substr(out, F.lit(1), place), filled("在{file_path}文件的第{line_start}行，", values), F.substr(out, place + 1))
    return F.when((path != "") & ~F.contains(out, path) & (F.length(out) > 20) & ~named & (place > 0), put).otherwise(out)
