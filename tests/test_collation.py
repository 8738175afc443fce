"""The collation: key order is that of a comparator, and of the byte encoding."""

import json
import random

from pyspark.sql import functions as F

from spanforge.functions import collation as C

VALUES = [
    None, False, True, -1e300, -5, -0.5, 0, 0.5, 1, 5.5, 10, 2**53, 2**53 + 1, 2**62, 1e300, "", "a", "a\x00", "ab", "b", "é",
    [], [None], [1], [1, None], [1, 2], [1, 2, 3], ["a"], [[1]], {}, {"a": 1}, {"a": 2}, {"a": {"x": [1]}}, {"b": 0}, {"a": 1, "b": 1},
]


def test_keys_sort_as_listed(spark):
    mixed = list(enumerate(VALUES))
    random.Random(1).shuffle(mixed)
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in mixed], "i int, v string")
    found = [r["i"] for r in df.orderBy(C.variant_key(F.parse_json("v"))).collect()]
    assert [VALUES[i] for i in found] == VALUES


def test_bytes_sort_as_listed():
    assert sorted(VALUES, key=C.encode) == VALUES


def test_equal_numbers_are_one_key(spark):
    df = spark.createDataFrame([("1",), ("1.0",), ("-0",), ("0.0",), ("9007199254740993",), ("9007199254740992",)], "v string")
    assert df.groupBy(C.variant_key(F.parse_json("v")).alias("k")).count().count() == 4


def test_missing_and_null_differ(spark):
    df = spark.createDataFrame([('{"a": null}',), ("{}",)], "d string").select(F.try_variant_get(F.parse_json("d"), "$.a", "variant").alias("v"))
    assert sorted(r["rank"] for r in df.select(C.variant_key(F.col("v"))["rank"].alias("rank")).collect()) == [C.MISSING, C.NULL]


def test_literals_match_values(spark):
    df = spark.createDataFrame([(json.dumps(v),) for v in VALUES], "v string").select(C.variant_key(F.parse_json("v")).alias("k"))
    for v in VALUES:
        assert df.where(F.col("k") == C.literal_key(v)).count() == 1, v
