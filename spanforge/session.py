"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Spark's setting: the bytes of an Arrow batch. Tasks hold a batch several times, in the JVM and as Python's objects,
#: and 10,000 rows of text are much; so batches are bounded by bytes.
BATCH_BYTES, MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of MOST_BYTES (a row more at most), unless the session has a setting of its own."""
    spark.conf.set(BATCH_BYTES, spark.conf.get(BATCH_BYTES, str(MOST_BYTES)))


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever they run: sent once per application, as ``--py-files`` would.

    What they get comes in batches of bounded size.
    """
    bound_batches(spark)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spanforge-py-"), "spanforge.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
