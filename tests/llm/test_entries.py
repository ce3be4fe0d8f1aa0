import pytest
from oracle import assert_same

import corpus_pipeline
from corpusmill.llm import entries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert_same(spark, entries.queries()[name], entries.oracle_sql()[name], FOLDER)


def test_every_query_has_a_row_a_document(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op1_ngram_jaccard_join", "op4_substring_dedup", "op5_toxicity", "op6_sharding"):
        assert entries.queries()[name](spark, FOLDER).count() == n


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.collect()
    counts = [sum(r.shard == s for r in rows) for s in range(16)]
    assert rows and max(counts) - min(counts) <= 1


def test_pipeline_of_no_documents(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
