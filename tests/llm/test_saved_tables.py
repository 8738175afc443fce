"""Saved tables leave no shuffle files behind."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from spanforge.llm.common import SHUFFLES_GO, save


def shuffle_files(spark):
    return {f for d in spark._jsc.sc().env().blockManager().diskBlockManager().localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data")}


def test_shuffles_of_a_saved_table_go(spark):
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLES_GO)
    made = save(spark.range(10_000).withColumn("x", F.col("id") % 97).groupBy("x").count().repartition(3, "count"), "counts")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert made.count() == 97 and made.agg(F.sum("count")).first()[0] == 10_000
    assert spark.conf.get(SHUFFLES_GO) == setting
