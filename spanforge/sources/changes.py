"""Change records: shard, seqno, op (upsert, delete or expire), doc_id, doc (JSON text or a struct)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("seqno", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("doc", T.StringType()),
    ]
)


def read_changes(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """A stream of Parquet files of change records; ``max_files`` per batch bounds what is queued."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def json_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "doc") -> DataFrame:
    """doc_id, doc as VARIANT; texts that are no JSON have a null document."""
    return df.select(F.col(doc_id).alias("doc_id"), F.try_parse_json(F.col(text)).alias("doc"))


def field(path: str, kind: str = "variant", column: str = "doc") -> str:
    """The SQL expression of a document's field: absent fields are SQL NULL, JSON nulls are not."""
    return f"try_variant_get({column}, '$.{path}', '{kind}')"
