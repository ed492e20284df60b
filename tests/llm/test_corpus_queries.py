"""The registered corpus queries and the pipeline on the smallest tables."""

import inspect
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lensdq.llm import queries

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="driver tables not present")


def test_every_operator_has_one_query():
    names = sorted(queries.queries(), key=lambda n: (n == "pipeline", len(n.split("_")[0]), n))
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name,columns", [
    ("op2_license_scan", {"doc_id", "families"}), ("op5_quality_rules", {"doc_id", "base_failed", "kept"}),
    ("op6_hilbert_shards", {"doc_id", "shard", "slot", "law"}), ("op7_source_mix", {"doc_id", "taken", "target"}),
    ("op9_language_id", {"doc_id", "held_out", "lang_pred", "score"}),
])
def test_query_covers_every_document(spark, name, columns):
    out = queries.queries()[name](spark, BASE)
    assert columns <= set(out.columns)
    assert out.count() == spark.read.parquet(f"{BASE}/documents.parquet").count()


def test_stages_take_and_give_documents(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "src1", 0), (None, "Null id here for all to see.", "en", None, 28), (10_003, "$$$ 123", "en", "src1", 7)], docs.schema)
    docs = docs.unionByName(odd).withColumn("extra", F.lit("x"))
    assert [len(inspect.signature(f).parameters) for _, f in corpus_pipeline.STAGES] == [3] * 5
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, BASE).cache()
        assert after.columns == docs.columns
        sizes.append(after.count())
        docs = after
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    assert not docs.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+")).count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, BASE).count() == docs.count()
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), BASE).count() == 0
