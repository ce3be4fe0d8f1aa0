"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Sources in code point order, null last, weigh 3, 1, 2 in turn and share ``share`` of all
words; no target exceeds ``most`` times its source's size, and what is left over is shared
among the others by weight until none does (the level is found with prefix sums over
the sources, which may be as many as hosts: they are range-sorted and added up like the documents).  Within a
source documents are ordered by the MD5 of seed and doc_id.  The first hex digits of that hash, as many as leave
about ``RANGE`` rows of the largest source, deal them into ranges; ranges are summed, the sums
are added up over a source's ranges, and each range is then added up by itself, so that a
source with a third of all rows is as many tasks as any.  Rows that repeat a doc_id are in one
range; rows without one are dealt by size, and those without words anywhere.  Whole epochs come first; the last one ends where the budget does, within a document if need be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.text import kept

#: The weights in turn.
WEIGHTS = (3, 1, 2)
#: Hex digits of a range at least (4096 ranges a source), and the rows that a range of the largest source has about.
DIGITS, RANGE = 3, 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def before(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums over all rows that come before in ``order`` (no two are equal in it; nulls come first).

    Sorted by ranges: each range is added up by itself, and one row a range, as many as there are partitions, over all.
    """
    ranged = kept(rows.withColumns({f"_{name}": c for name, c in sums.items()}).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(*(F.sum(f"_{name}").alias(f"_all_{name}") for name in sums))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_all_{name}").over(upto), F.lit(0)).alias(f"_all_{name}") for name in sums))
    out = ranged.withColumns({name: F.coalesce(F.sum(f"_{name}").over(within), F.lit(0)) for name in sums}).join(F.broadcast(parts), "_part")
    return out.withColumns({name: F.col(name) + F.col(f"_all_{name}") for name in sums}).select(*rows.columns, *sums)


def targets(sizes: DataFrame, share: float, most: int) -> DataFrame:
    """_source, source_size, target from one row a source (_source, source_size)."""
    t = before(sizes.withColumn("_null", F.col("_source").isNull()), ["_null", "_source"], {"turn": F.lit(1).cast("long")})
    weight = F.get(F.array(*(F.lit(w) for w in WEIGHTS)), (F.col("turn") % len(WEIGHTS)).cast("int"))
    t = t.withColumn("w", weight.cast("long")).withColumn("ratio", F.col("source_size") / F.col("w")).drop("turn")
    t = kept(before(t, ["ratio", "_null", "_source"], {"capped": most * F.col("source_size"), "done": F.col("w")}))
    every = t.agg(F.sum("w").alias("all_w"), F.sum("source_size").alias("total"))
    # The level of a source, were all before it at their caps; the first that is under its cap sets it for the rest.
    t = t.join(F.broadcast(every)).withColumn("level", (share * F.col("total") - F.col("capped")) / (F.col("all_w") - F.col("done")))
    level = t.where(F.col("level") * F.col("w") <= most * F.col("source_size")).agg(F.min_by("level", F.struct("ratio", "_null", "_source")).alias("level"))
    t = t.drop("level").join(F.broadcast(level))
    return t.select("_source", "source_size", F.least((most * F.col("source_size")).cast("double"), F.coalesce(F.col("level") * F.col("w"), F.lit(float("inf")))).alias("target"))


def planned(rows: DataFrame, share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """``rows`` (doc_id, _source, size, and others) with source_size, target and taken."""
    by_source = kept(rows.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    largest, digits = by_source.agg(F.max("n")).first()[0] or 0, DIGITS
    while largest > RANGE << 4 * digits:
        digits += 1
    goal = targets(by_source.drop("n"), share, most)
    # Rows without words take nothing and come before or after others alike, so they are dealt evenly; rows without an id, by size.
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null|"), F.col("size").cast("string")))
    rows = rows.withColumn("_key", F.when(F.col("size") > 0, F.md5(F.concat_ws("|", F.lit(seed), named))).otherwise(F.md5(F.monotonically_increasing_id().cast("string"))))
    rows = rows.withColumn("_range", F.substring("_key", 1, digits))
    # A source's name that is never null: the window's dealing then serves the join too, and the rows are shuffled once.
    rows = rows.withColumn("_name", F.coalesce(F.concat(F.lit("="), "_source"), F.lit("")))
    ranges = rows.groupBy("_name", "_range").agg(F.sum("size").alias("s"))
    w = Window.partitionBy("_name").orderBy("_range")
    ranges = ranges.withColumn("_from", F.sum("s").over(w) - F.col("s"))
    goal = goal.select(F.coalesce(F.concat(F.lit("="), "_source"), F.lit("")).alias("_name"), "source_size", "target")
    plan = ranges.join(goal, "_name").select("_name", "_range", "_from", "source_size", "target")
    at = Window.partitionBy("_name", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_within", F.sum("size").over(at) - F.col("size")).join(plan, ["_name", "_range"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("_from") - F.col("_within")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.withColumn("taken", taken.cast("long")).drop("_key", "_name", "_range", "_from", "_within")


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row of ``docs`` (doc_id, text, source).

    A source's taken words add up to the floor of its target.  Null and empty texts have size 0 and nothing to
    take; a null source is one source; rows with one doc_id follow each other by size.  The same rows
    give the same result at any partitioning.  Other columns are ignored.
    """
    rows = docs.select("doc_id", F.col("source").alias("_source"), words(F.col("text")).alias("size"))
    return planned(kept(rows), share, most, seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """The mixture: each row of ``docs`` as often as it is taken whole, and once cut to its first words (joined by one space) where a budget ends.

    Rows of which nothing is taken are left out, those without words (null and empty texts) too.  Rows without a doc_id or
    source are mixed like all others, and rows that repeat one are taken each for itself.  No rows give none.  Columns keep
    their names, whatever they are called, and all values but a cut text.
    """
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), "doc_id", F.col("source").alias("_source"), words(F.col("text")).alias("size"))
    taken = planned(rows, share, most, seed).where("taken > 0")
    cut = F.array_join(F.slice(F.array_remove(F.split(F.col("_row.text"), r"[\x20\x09-\x0D]+"), ""), 1, F.col("_n").cast("int")), " ")
    copies = taken.withColumn("_n", F.explode(F.expr("filter(concat(array_repeat(size, cast(taken div size as int)), array(taken % size)), n -> n > 0)")))
    return copies.withColumn("_cut", F.when(F.col("_n") < F.col("size"), cut).otherwise(F.col("_row.text"))).select(*(F.col("_cut").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))
