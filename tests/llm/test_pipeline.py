"""The pipeline's stages in order, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm.common import save, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, save(stage(spark, docs, SF), f"test-{name}")
        counts.append(docs.count())
        if name != "pack":
            assert docs.columns == columns
            ids = before.select("doc_id").distinct()
            assert docs.join(ids, "doc_id", "left_anti").isEmpty()
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    labels = table(spark, SF, "labels").where("quality = 1")
    kept = corpus_pipeline.quality(spark, table(spark, SF, "documents"), SF).join(labels, "doc_id").count()
    assert kept >= 0.95 * table(spark, SF, "documents").join(labels, "doc_id").count()
    packed = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert packed.where("n > 4096 OR n <> end").isEmpty()
