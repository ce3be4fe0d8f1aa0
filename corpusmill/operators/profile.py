"""Counts, modes, totals and look-ups over rules, samples and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions import scalars as S


def counts(df: DataFrame, by: Column, name: str = "type", missing: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(by, F.lit(missing)).alias(name)).agg(F.count("*").alias("n"))


def mode(df: DataFrame, column: str, order: str, default: str) -> DataFrame:
    """One row: the most frequent value, of equals the first met; the default where there are no rows."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("o")).orderBy(F.desc("n"), "o").limit(1)
    return top.agg(F.coalesce(F.first(column), F.lit(default)).alias(column))


def distribution(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A row for each value, zero counts too."""
    every = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(df.groupBy(column).agg(F.count("*").alias("c")), column, "left").select(column, F.coalesce("c", F.lit(0)).alias("n"))


def architecture(structures: DataFrame) -> DataFrame:
    """One row from structures (file_path, functions, classes): base classes, and what the classes and files hint at."""
    classes = structures.select("file_path", F.explode("classes").alias("c"))
    bases = classes.select(F.explode("c.bases").alias("b")).distinct().agg(F.array_sort(F.collect_list("b")).alias("base_classes"))
    of = classes.agg(
        F.count_if(F.size("c.bases") > 0).alias("inheritance"),
        F.count_if(F.lower("c.name").rlike("adapter|handler")).alias("adapters"), F.count_if(F.contains(F.lower("c.name"), F.lit("base"))).alias("bases"),
    )
    files = structures.agg(F.count_if(F.size("functions") > 0).alias("modular_functions"))
    return bases.crossJoin(of).crossJoin(files)


def many_classes(structures: DataFrame, first: int = 10, least: int = 5) -> DataFrame:
    """One row: n_classes of the first structures (ord, classes), and whether they are more than ``least``."""
    n = F.coalesce(F.sum(F.coalesce(F.size("classes"), F.lit(0))), F.lit(0)).cast("long")
    return structures.orderBy("ord").limit(first).agg(n.alias("n_classes")).withColumn("many", F.col("n_classes") > least)


def architecture_text(structures: DataFrame, first: int = 5) -> DataFrame:
    """One row, ``architecture``: files, classes and functions of the first structures (ord, file_path, classes, functions) as lines."""
    names = lambda c, n: F.array_join(F.transform(F.slice(F.coalesce(F.transform(c, lambda x: S.text_of(x["name"])), F.expr("cast(array() as array<string>)")), 1, n), lambda x: x), ", ")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    lines = F.concat_ws(
        "\n", F.concat(F.lit("文件: "), S.text_of("file_path")), F.when(some("classes"), F.concat(F.lit("  类: "), names("classes", 3))), F.when(some("functions"), F.concat(F.lit("  函数: "), names("functions", 5)))
    )
    rows = structures.orderBy("ord").limit(first).select("ord", F.when(some("classes") | some("functions"), lines).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("ord", "part")))), lambda x: x["part"]), "\n")
    return rows.agg(joined.alias("t")).select(F.when(F.col("t") != "", F.col("t")).otherwise(fixed.NO_ARCHITECTURE).alias("architecture"))


def first_rows(df: DataFrame, n: int, order: str = "_ord") -> DataFrame:
    """What is shown of a dataset."""
    return df.orderBy(order).limit(n)


def category(text: Column, categories: list[tuple[str, list[str]]], other: str = "other") -> Column:
    """The first category of which some phrase is in the text."""
    out = F.lit(other)
    for name, phrases in reversed(categories):
        test = F.lit(False)
        for p in phrases:
            test = test | F.contains(text, F.lit(p))
        out = F.when(test, name).otherwise(out)
    return out


def relevant(demands: DataFrame, snippets: DataFrame, fallback: int = 1, first: int = 5) -> DataFrame:
    """demand_id, snippet of the first snippets that hold a keyword of the demand; the very first few where none does.

    ``demands`` has demand_id and keywords (an array), ``snippets`` has ord and code; only ``first`` snippets are looked at.
    """
    some = snippets.orderBy("ord").limit(first).withColumn("_k", F.row_number().over(Window.orderBy("ord")))
    pairs = demands.crossJoin(F.broadcast(some)).withColumn("_hit", F.exists("keywords", lambda k: F.contains(F.lower("code"), F.lower(k))))
    pairs = pairs.withColumn("_any", F.max("_hit").over(Window.partitionBy("demand_id")))
    return pairs.where(F.col("_hit") | (~F.col("_any") & (F.col("_k") <= fallback))).select("demand_id", "ord")


def latest_failures(failures: DataFrame, lists: int = 3, most: int = 5) -> DataFrame:
    """rule_id, feedback: the reasons of a rule's last attempts (rule_id, attempt, reasons), the first few joined."""
    last = failures.withColumn("_n", F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("attempt")))).where(F.col("_n") <= lists)
    listed = last.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("attempt", "reasons"))).alias("l"))
    return listed.select("rule_id", F.array_join(F.slice(F.flatten(F.transform("l", lambda x: x["reasons"])), 1, most), "; ").alias("feedback"))


def routed(files: DataFrame, rules: list[tuple[str, str]], deleted: tuple[str, ...] = ()) -> DataFrame:
    """src, dst, action of a file listing (path, size): the first rule (pattern, folder) that a name matches moves it; names that match a pattern of ``deleted`` are to go.

    Files of one name in one folder are numbered from the second on, before the ending.
    """
    name = S.basename(F.col("path"))
    folder = F.lit(None).cast("string")
    for pattern, to in reversed(rules):
        folder = F.when(name.rlike(pattern), to).otherwise(folder)
    gone = F.lit(False)
    for pattern in deleted:
        gone = gone | name.rlike(pattern)
    rows = files.select(F.col("path").alias("src"), name.alias("_name"), F.when(~gone, folder).alias("_to"), gone.alias("_gone"), (F.col("size") / 1048576).alias("size_mb"))
    n = F.row_number().over(Window.partitionBy("_to", "_name").orderBy("src")) - 1
    ending = F.regexp_extract("_name", r"[^.](\.[^.]*)$", 1)
    numbered = F.when(F.col("_n") == 0, F.col("_name")).otherwise(F.concat(F.substr("_name", F.lit(1), F.length("_name") - F.length(ending)), F.lit("_"), F.col("_n").cast("string"), ending))
    rows = rows.withColumn("_n", n)
    return rows.select("src", F.when(F.col("_to").isNotNull(), F.concat_ws("/", "_to", numbered)).alias("dst"), F.when(F.col("_gone"), "delete").when(F.col("_to").isNotNull(), "move").otherwise("keep").alias("action"), "size_mb")
