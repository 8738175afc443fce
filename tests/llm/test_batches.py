"""What a Python worker is given at a time is bounded by bytes, whatever the rows hold."""

import pyarrow as pa
from pyspark.sql import functions as F

from spanforge.llm import cotraining
from spanforge.session import BATCH_BYTES, MOST_BYTES, ship_package


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])


def test_batches_are_bounded_by_bytes(spark):
    ship_package(spark)
    row = 20_000
    docs = spark.range(0, 900, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), row).alias("text"))
    found = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in found) == 900
    # All 900 rows, 18 MB, came at once before.
    assert max(r["bytes"] for r in found) <= 2 * (MOST_BYTES + row) and len(found) > 4


def test_a_setting_of_the_session_stays(spark):
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, "100k")
    ship_package(spark)
    assert spark.conf.get(BATCH_BYTES) == "100k"
    spark.conf.set(BATCH_BYTES, before)


def test_scores_do_not_hang_on_batches(spark):
    docs = spark.range(0, 300, 1, 2).selectExpr("id AS doc_id", "repeat(concat('word', id % 7, ' '), 3000) AS text", "'en' AS lang", "'a' AS source", "1L AS n_chars")
    model = cotraining.Model(constant=0.5)
    assert cotraining.score_documents(docs, model).where("_quality_score = 0.5").count() == 300
