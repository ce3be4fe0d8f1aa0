"""The pipeline's rows against plain Python, stage after stage, and its stages on odd tables."""

import brute
import pytest
from conftest import DOCS, table
from pyspark.sql import functions as F
from test_rows import measures

import corpus_pipeline

#: Names that the operators use themselves.
NAMES = ["_s", "_seen", "_chunk", "_marks", "_key", "_gone", "_host", "_q", "_w", "_raw", "_text", "_cut", "_n", "_cell", "_rank", "slot", "kept", "bad"]
FOLDER = "/root/testdata/sf0.001"


def test_same_as_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source").collect()
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs]
    kept = brute.good(rows, measures)
    alone = brute.representatives(kept, 5, 8, 10)
    clean = brute.untested(alone, items, 5, 8, 10)
    mixed = brute.mixture(clean)
    want = sorted(brute.ring(spark, [r[:2] for r in mixed], 16))
    got = sorted((r.doc_id, r.text, r.shard, r.slot) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert len(rows) > len(kept) > len(alone) > len(clean) and got == want


def test_odd_rows(spark, odd, tmp_path):
    """Null and repeated ids, null and very long texts, null sources, clashing names, through all stages."""
    rows = [*odd, (70, "a line of its own that is long enough for the rules to pass it", None), (None, "rows without an id or source that are long enough for the rules", None)]
    df = table(spark, [(d, t, *s) if s else (d, t, "src0") for d, t, *s in rows])
    df.withColumns({c: F.lit(1) for c in NAMES}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two"), (None, "x y"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "shards":
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            assert docs.count()
    assert out.count() == docs.count() and {"shard", "slot"} <= set(out.columns)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_no_rows(spark, tmp_path, name, stage):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert stage(spark, spark.createDataFrame([], DOCS), str(tmp_path)).count() == 0
