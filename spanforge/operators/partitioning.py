"""Hash partitions and their elimination.

A row's partition is ``crc32(JSON of its key values) mod n + 1``. A scan whose spans
fix all partition keys by equality reads only the partitions that those values hash
to; Spark prunes folders when an index is stored partitioned by the id. The values
are cast to the keys' types and hashed by Spark, as the rows are. VARIANT keys equal
across number formats, so that spans over them reach every partition.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.request import UNBOUNDED, Span

PART = "part_id"
#: More value combinations than this are not worth hashing on the driver.
MOST_COMBINATIONS = 1_000


def partition_id(values: Sequence[Column], n: int) -> Column:
    text = F.to_json(F.array(*[F.to_json(F.struct(v.alias("v"))) for v in values]))
    return (F.pmod(F.crc32(text), F.lit(n)) + 1).cast("int")


def hashable(value: Column, kind: T.DataType) -> Column:
    """A key as it is hashed: equal values alike (-0.0 as 0.0)."""
    return value + F.lit(0.0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else value


def _ids(spark: SparkSession, choices: Sequence[Sequence[object]], kinds: Sequence[T.DataType], n: int) -> set[int]:
    literals = [[hashable(F.lit(v).try_cast(kind), kind) for v in values] for values, kind in zip(choices, kinds, strict=True)]
    # One row of literals, which is worked out without a job.
    return set(spark.sql("SELECT 1").select(F.array(*[partition_id(c, n) for c in itertools.product(*literals)]).alias("ids")).first()["ids"])


def _combinations(choices: Sequence[Sequence[object]]) -> int:
    total = 1
    for values in choices:
        total *= len(values)
    return total


def eliminate(spark: SparkSession, spans: Sequence[Span], positions: Sequence[int], kinds: Sequence[T.DataType], n: int) -> set[int] | None:
    """Partitions that spans can reach; None: any. ``positions`` and ``kinds``: of the partition keys among the index keys."""
    if any(isinstance(k, (T.VariantType, T.ArrayType, T.StructType, T.MapType)) for k in kinds) or len(spans) > MOST_COMBINATIONS:
        return None
    found: set[int] = set()
    for span in spans or (Span(),):
        choices = []
        for p in positions:
            r = span.ranges[p] if p < len(span.ranges) else None
            if r is None or r.low is UNBOUNDED or r.high is UNBOUNDED or r.low != r.high:
                return None
            choices.append([r.low])
        found |= _ids(spark, choices, kinds, n)
    return found


def eliminate_sets(spark: SparkSession, sets: Sequence[Sequence[object]], kinds: Sequence[T.DataType], n: int) -> set[int] | None:
    """Partitions of all combinations of explicit values, one set for each partition key; None: too many."""
    if _combinations(sets) > MOST_COMBINATIONS:
        return None
    return _ids(spark, sets, kinds, n)
