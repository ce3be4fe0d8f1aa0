"""Documents to training shards: quality, near duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its
result is written as Parquet and read again before the next.  All but the last return the
columns of ``documents``; the last adds shard and slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontaminate, mixing, ngram_join, quality, sharding
from corpusmill.llm.text import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or any rule on a bad host (source), go.

    Null and empty texts fail it.  Repeated rows go or stay together; rows without an id or source are judged like all others; no rows give none.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that of the smallest doc_id: five words, Jaccard similarity 0.8.

    Of rows that repeat doc_id and text one stays.  Rows without words or without a doc_id stay; no rows give none.
    """
    return ngram_join.one_of_each(docs, words=5, num=8, den=10)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go: five words (items of fewer words: all of them), containment 0.8.

    Null and empty texts contain none; items that are null or empty are in no document; without items all rows stay.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document is repeated as often as it is taken, and cut where a budget ends.

    Rows without words go.  A null source is a source; rows that repeat an id are taken each for itself; no rows give none.
    """
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """16 shards, counts at most one apart, with gapless slots; columns called shard and slot give way.

    Null texts and ids have their place like all others, repeated rows each its own; no rows give none.
    """
    return sharding.sharded(docs, shards=16)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("mixture", mixture), ("shards", shards)]

#: SQL can't express the ring; tests/llm holds the pipeline's rows against plain Python, stage after stage.
ORACLE_SQL: str | None = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What the others return is written below the session's checkpoint folder, and removed once the
    next stage is written; the last of it stays, as the result is read from it."""
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if k:
                _delete(spark, f"{folder}/{STAGES[k - 1][0]}")
    return docs
