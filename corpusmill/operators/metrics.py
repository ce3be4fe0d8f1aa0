"""BLEU, perplexity and training-log series, and the tables that report them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import scalars as S


def bleu(reference: str = "reference", candidate: str = "candidate", *, into: str = "bleu", most: int = 4) -> Callable[[DataFrame], DataFrame]:
    """Adds sentence BLEU of up to 4-grams with smoothing method 1 (0.1 for no match), one reference; 0 for no token.

    N-grams are counted within the row, so that nothing is shuffled: those of both texts are sorted together, and
    in one pass the smaller count of each is added up.
    """
    side_of = "transform({g}, x -> struct(x as g, {s} as s))"
    overlap = (
        "aggregate(array_sort(concat({c}, {r})), struct('' as g, 0 as c, 0 as r, 0 as t), "
        "(a, x) -> if(a.g = x.g, struct(a.g as g, a.c + 1 - x.s as c, a.r + x.s as r, a.t as t), struct(x.g as g, 1 - x.s as c, x.s as r, a.t + least(a.c, a.r) as t)), a -> a.t + least(a.c, a.r))"
    )

    def add(df: DataFrame) -> DataFrame:
        d = df.withColumns({"_r": S.tokens(F.col(reference)), "_c": S.tokens(F.col(candidate))})
        for n in range(1, most + 1):
            for side in ("_r", "_c"):
                joined = f"transform(sequence(0, size({side}) - {n}), i -> array_join(slice({side}, i + 1, {n}), '\\u0000'))"
                d = d.withColumn(f"{side}{n}", F.expr(f"if(size({side}) >= {n}, {joined}, cast(array() as array<string>))"))
        for n in range(1, most + 1):
            d = d.withColumn(f"_m{n}", F.expr(overlap.format(c=side_of.format(g=f"_c{n}", s=0), r=side_of.format(g=f"_r{n}", s=1))))
        total = F.lit(0.0)
        for n in range(1, most + 1):
            of = F.greatest(F.lit(1), F.size("_c") - (n - 1))
            total = total + F.log(F.when(F.col(f"_m{n}") == 0, F.lit(0.1)).otherwise(F.col(f"_m{n}").cast("double")) / of)
        brevity = F.when(F.size("_c") > F.size("_r"), 1.0).otherwise(F.exp(1 - F.size("_r") / F.greatest(F.size("_c"), F.lit(1))))
        out = F.when((F.size("_c") == 0) | (F.size("_r") == 0) | (F.col("_m1") == 0), 0.0).otherwise(brevity * F.exp(total / most))
        return d.withColumn(into, out).drop("_r", "_c", *(f"{s}{n}" for s in ("_r", "_c", "_m") for n in range(1, most + 1)))

    return add


def perplexity(nll: Column, n_tokens: Column) -> Column:
    """exp of the mean negative log likelihood; infinite under two tokens."""
    return F.when(n_tokens < 2, float("inf")).otherwise(F.exp(nll / n_tokens))


def scored(df: DataFrame, text: str, scorer: Callable[[list[str]], list[tuple[float, int]]], max_chars: int = 2000) -> DataFrame:
    """``df`` with nll and n_tokens from a model that takes texts: any that can be sent to the executors."""
    at = [*df.columns, "nll", "n_tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scorer([(t.as_py() or "")[:max_chars] for t in b.column(df_at)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], at)

    df_at = df.columns.index(text)
    return df.mapInArrow(work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", nll double, n_tokens bigint")


def evaluated(predictions: DataFrame) -> DataFrame:
    """model, test_set, bleu, ppl, num_samples: means over each model's predictions (bleu, ppl).  Infinite perplexities don't count; none left means infinite."""
    finite = F.when((F.col("ppl") > 0) & (F.col("ppl") < float("inf")), F.col("ppl"))
    return predictions.groupBy("model", "test_set").agg(F.coalesce(F.avg("bleu"), F.lit(0.0)).alias("bleu"), F.coalesce(F.avg(finite), F.lit(float("inf"))).alias("ppl"), F.count("bleu").alias("num_samples"))


def grid(models: DataFrame, test_sets: DataFrame, available: DataFrame) -> DataFrame:
    """Each (model, test_set) of which the pair is available: the distinct pairs there are, of known models and sets."""
    return available.select("model", "test_set").distinct().join(models, "model", "left_semi").join(test_sets, "test_set", "left_semi").select("model", "test_set")


def pivoted(results: DataFrame, test_sets: list[str], metric: str, digits: int = 4, base: str = "base") -> DataFrame:
    """A row a model and a column a test set, N/A where there is no result; the base model first."""
    wide = results.groupBy("model").pivot("test_set", test_sets).agg(F.first(metric))
    return wide.select("model", *(S.shown(F.col(f"`{t}`"), digits).alias(t) for t in test_sets)).orderBy((F.col("model") != base).cast("int"), "model")


def markdown(wide: DataFrame) -> DataFrame:
    """The rows of a pivoted table as lines of a Markdown table, with their order."""
    spark = wide.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(wide.columns) + " |"), (1, "|" + "---|" * len(wide.columns))], "ord int, line string")
    body = wide.select((F.row_number().over(Window.orderBy((F.col("model") != "base").cast("int"), "model")) + 1).alias("ord"), F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(f"`{c}`") for c in wide.columns)), F.lit(" |")).alias("line"))
    return head.union(body)


def loss_series(states: DataFrame) -> DataFrame:
    """run, kind (train or eval), step, loss from (run, log_history): an entry with eval_loss is eval; a missing step is the entry's place among its kind."""
    e = states.select("run", F.posexplode("log_history").alias("pos", "x")).select("run", "pos", "x.*")
    kind = F.when(F.col("eval_loss").isNotNull(), "eval").when(F.col("loss").isNotNull(), "train")
    e = e.withColumn("kind", kind).where("kind is not null")
    place = F.row_number().over(Window.partitionBy("run", "kind").orderBy("pos")) - 1
    return e.select("run", "kind", F.coalesce("step", place.cast("long")).alias("step"), F.coalesce("eval_loss", "loss").alias("loss"))


def best(series: DataFrame) -> DataFrame:
    return series.where("kind = 'eval'").groupBy("run").agg(F.min("loss").alias("min_eval_loss"))
