"""Validation and first-wins duplicates over a stream of samples, with state bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import validate


def valid_stream(samples: DataFrame, time: str, delay: str = "1 hour", strict: bool = True) -> DataFrame:
    """Samples that pass the basic, keyword and snippet checks, the first of each question within the delay.

    A marked variant always stays, as in a batch, and holds its key: an unmarked row that comes after it is a duplicate.  Which of two
    rows comes first is a matter of arrival; keys are forgotten behind the watermark.
    """
    rows = samples.where(validate.basic_reason(strict).isNull())
    rows = rows.withColumn("_key", validate.key()).withColumn("_variant", validate.variant()).withWatermark(time, delay)
    # Each variant goes in twice: as a row of its own, and to hold the key, for which it is dropped behind the state.
    copies = F.when(F.col("_variant"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    rows = rows.withColumn("_own", F.explode(copies)).withColumn("_name", F.when(F.col("_own"), F.uuid()).otherwise(F.col("_key")))
    kept = rows.dropDuplicatesWithinWatermark(["type", "_own", "_name"]).where(F.col("_own") | ~F.col("_variant"))
    return kept.where(validate.overlaps(strict) & validate.snippets_fit(strict)).drop("_key", "_variant", "_own", "_name")
