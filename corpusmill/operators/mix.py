"""Normalising, uniting, sampling, shuffling and splitting datasets, all by the order of a seeded MD5."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions import scalars as S


def last_content(messages: Column, role: str) -> Column:
    """What the last message of a role says; empty where there is none."""
    return F.coalesce(F.get(F.reverse(F.filter(messages, lambda m: m["role"] == role)), F.lit(0))["content"], F.lit(""))


def normalised(rows: DataFrame) -> DataFrame:
    """Rows with a type as they are; ``messages``, or instruction, input and output, as question and answer."""
    has = set(rows.columns)
    none = F.lit(None).cast("string")
    col = lambda c: F.col(c) if c in has else none
    join = lambda a, b: F.when(S.text_of(b) == "", S.text_of(a)).when(S.text_of(a) == "", S.text_of(b)).otherwise(F.concat(a, F.lit("\n"), b))
    question, answer = join(col("instruction"), col("input")), S.text_of(col("output"))
    if "messages" in has:
        question = F.when(F.col("messages").isNotNull(), last_content(F.col("messages"), "user")).otherwise(question)
        answer = F.when(F.col("messages").isNotNull(), last_content(F.col("messages"), "assistant")).otherwise(answer)
    typed = S.text_of(col("type")) != ""
    return rows.withColumns({"question": F.when(typed, col("question")).otherwise(question), "answer": F.when(typed, col("answer")).otherwise(answer), "type": F.when(typed, col("type")).otherwise("qa")})


def united(frames: dict[str, DataFrame]) -> DataFrame:
    """All rows, with the name of their dataset in ``_source``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.withColumn("_source", F.lit(n)) for n, f in frames.items()))


def fixed_sample(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """Exactly n rows, or all where there are fewer: a top-k, for numbers that are parameters."""
    return df.orderBy(S.order_key(seed, *ids), *ids).limit(n)


def sampled(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """The same rows by rank, for numbers that grow with the data."""
    return ranked(df, seed, *ids).where(F.col("_rank") <= n).drop("_rank")


def ranked(df: DataFrame, seed: int, *ids: str, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """``df`` with ``_rank`` from 1 in seeded order, over all rows or within groups.

    The order's first digits cut it into ranges that are counted and ranked by themselves, so
    that no task sorts all rows.
    """
    by = by or []
    rows = df.withColumn("_key", S.order_key(seed, *ids)).withColumn("_range", F.substring("_key", 1, digits))
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")).drop("_n")
    # At most 16^digits ranges a group: broadcast for all rows, joined otherwise.
    before = F.broadcast(before) if not by else before
    within = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_key", *ids))
    rows = rows.withColumn("_within", within)
    if by:
        renamed = before.select(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(by)), F.col("_range").alias("_r"), "_before")
        test = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(by))) & (F.col("_range") == F.col("_r"))
        joined = rows.join(renamed, test).drop(*(f"_g{k}" for k in range(len(by))), "_r")
    else:
        joined = rows.join(before, "_range")
    return joined.withColumn("_rank", F.col("_within") + F.col("_before")).drop("_key", "_range", "_within", "_before")


def shuffled(df: DataFrame, seed: int, *ids: str) -> DataFrame:
    return df.orderBy(S.order_key(seed, *ids), *ids)


def one_to_one(a: DataFrame, b: DataFrame, *ids: str, seeds: tuple[int, int] = (42, 43)) -> DataFrame:
    """As many rows of either side as the smaller one has, with ``_source`` a or b."""
    n = min(a.count(), b.count())
    return united({"a": sampled(a, n, seeds[0], *ids), "b": sampled(b, n, seeds[1], *ids)})


def balance(mixed: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: the rows of either side of ``_source`` (a or b), their ratio, and whether it is 1 within the tolerance."""
    counts = mixed.agg(F.count_if(F.col("_source") == "a").alias("a"), F.count_if(F.col("_source") == "b").alias("b"))
    ratio = F.when(F.col("b") > 0, F.col("a") / F.col("b"))
    return counts.withColumn("ratio", ratio).withColumn("balanced", F.coalesce(F.abs(ratio - 1) < tolerance, F.lit(False)))


def feasible(combinations: list[str], general: DataFrame, rule: DataFrame, llm: DataFrame) -> list[str]:
    """The combinations that can be made: without any rows an error, without generated rows no general_llm."""
    some = {name: not f.isEmpty() for name, f in (("general", general), ("rule", rule), ("llm", llm))}
    if not any(some.values()):
        raise ValueError("all datasets are empty")
    return [c for c in combinations if some["llm"] or c != "general_llm"]


def combined(which: str, general: DataFrame, rule: DataFrame, llm: DataFrame, *ids: str) -> DataFrame:
    """General rows and as many new ones, with ``_source`` and ``_part`` (general, rule or llm): ``all`` (rules and generated ones), ``general_rule`` or ``general_llm``.

    Without generated rows ``all`` is of rules alone, and ``general_llm`` is an error.  Each side has its own seed.
    """
    part = {n: f.withColumn("_part", F.lit(n)) for n, f in (("general", general), ("rule", rule), ("llm", llm))}
    if which not in ("all", "general_rule", "general_llm"):
        raise ValueError(f"no such combination: {which}")
    if which == "general_llm" and llm.isEmpty():
        raise ValueError("general_llm needs generated rows")
    new, seed = {"all": (part["rule"].unionByName(part["llm"], allowMissingColumns=True), 43), "general_rule": (part["rule"], 44), "general_llm": (part["llm"], 45)}[which]
    return one_to_one(part["general"], new, "_part", *ids, seeds=(42, seed))


def split(df: DataFrame, *ids: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the first of the seeded order are train, the last max(1, int(n ratio)) are val."""
    total = df.agg(F.count("*").alias("_total"))
    n_val = F.greatest(F.lit(1), F.floor(F.col("_total") * ratio))
    rows = ranked(df, seed, *ids).crossJoin(F.broadcast(total))
    return rows.withColumn("split", F.when(F.col("_rank") <= F.col("_total") - n_val, "train").otherwise("val")).drop("_rank", "_total")


def split_at(df: DataFrame, *ids: str, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the first int(n ratio) of the seeded order are train."""
    total = df.agg(F.count("*").alias("_total"))
    rows = ranked(df, seed, *ids).crossJoin(F.broadcast(total))
    return rows.withColumn("split", F.when(F.col("_rank") <= F.floor(F.col("_total") * ratio), "train").otherwise("val")).drop("_rank", "_total")


def stratified(df: DataFrame, n: int, types: list[tuple[str, float]], levels: list[tuple[str, float]], *ids: str, type_col: str = "type", level_col: str = "complexity", seed: int = 42) -> DataFrame:
    """n rows in three passes: quotas by type, then of the rest by level, then any; with ``_pass``."""
    quota = lambda parts, m: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, r in parts for x in (k, int(m * r)))), F.col("_of")), F.lit(0))
    first = ranked(df, seed, *ids, by=[type_col]).withColumn("_of", F.col(type_col)).where(F.col("_rank") <= quota(types, n)).drop("_rank", "_of")
    taken = first.count()
    rest = df.join(first.select(*ids), list(ids), "left_anti")
    second = ranked(rest, seed + 1, *ids, by=[level_col]).withColumn("_of", F.col(level_col)).where(F.col("_rank") <= quota(levels, max(0, n - taken))).drop("_rank", "_of")
    more = second.count()
    third = sampled(rest.join(second.select(*ids), list(ids), "left_anti"), max(0, n - taken - more), seed + 2, *ids)
    return united({"type": first, "level": second, "any": third}).withColumnRenamed("_source", "_pass").orderBy(S.order_key(seed + 3, *ids)).limit(n)


def by_category(df: DataFrame, n: int, category: str, categories: int, *ids: str, seed: int = 42) -> DataFrame:
    """max(1, n // categories) rows of each category."""
    return ranked(df, seed, *ids, by=[category]).where(F.col("_rank") <= max(1, n // categories)).drop("_rank")


def replicated(df: DataFrame, n: int, rows: int, *order: str | Column) -> DataFrame:
    """n rows: all of ``df`` (``rows`` many) again and again, with the number of the pass in ``variant``.

    Whole passes take every row; of the last one the first rows of the order, n - n // rows * rows < rows of them.
    """
    whole, more = divmod(n, rows) if rows else (0, 0)
    passes = df.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(whole - 1)))) if whole else df.limit(0).withColumn("variant", F.lit(0))
    return passes.unionByName(df.orderBy(*order).limit(more).withColumn("variant", F.lit(whole)))


def filled_up(chosen: DataFrame, every: DataFrame, n: int, demand: str, *ids: str, seed: int = 42) -> DataFrame:
    """n demands: those chosen (by category), and where they are too few any of ``every`` with a marker behind, both picked by hash; repeats may be."""
    short = max(0, n - chosen.count())
    base = ranked(every.select(demand, *ids), seed, *ids).select(F.col(demand).alias("_base"), "_rank")
    total = every.count()
    pick = lambda salt, k: F.conv(F.substring(S.order_key(seed, F.lit(salt), F.col("id")), 1, 8), 16, 10).cast("long") % k
    markers = F.array(*(F.lit(m) for m in fixed.VARIANT_MARKERS))
    more = every.sparkSession.range(short if total else 0).select((pick("demand", max(total, 1)) + 1).alias("_rank"), F.get(markers, pick("marker", len(fixed.VARIANT_MARKERS)).cast("int")).alias("_marker"))
    more = more.join(base, "_rank").select(F.concat("_base", F.lit(" "), "_marker").alias(demand))
    return chosen.select(demand).unionByName(more).limit(n)


def without(df: DataFrame, chosen: DataFrame, *ids: str) -> DataFrame:
    return df.join(chosen.select(*ids), list(ids), "left_anti")


def paired(files: DataFrame) -> DataFrame:
    """dataset, train, val of files (path) named *_train and *_val."""
    stem = F.regexp_replace(S.basename(F.col("path")), r"\.[^.]*$", "")
    named = files.select("path", stem.alias("stem"), S.dataset_name(stem).alias("dataset"))
    train = named.where(F.endswith("stem", F.lit("_train"))).groupBy("dataset").agg(F.min("path").alias("train"))
    val = named.where(F.endswith("stem", F.lit("_val"))).groupBy("dataset").agg(F.min("path").alias("val"))
    return train.join(val, "dataset").orderBy("dataset")
