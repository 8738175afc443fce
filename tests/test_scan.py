"""Scans, groups and arrays over schemaless documents, against expected rows worked out by hand."""

import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spanforge.operators import index as ix
from spanforge.operators import partitioning, scan
from spanforge.operators.aggregate import GroupError
from spanforge.operators.spans import SpanError
from spanforge.plans.request import (
    Aggregate,
    AggregateCall,
    ArrayMode,
    GroupAggregate,
    GroupKey,
    Inclusion,
    IndexDefinition,
    IndexKey,
    OrderKey,
    Range,
    ScanRequest,
    Span,
    equal,
)
from spanforge.sources.changes import field, json_documents

MIXED_MONTHS = [None, 0, ..., "strmonth", True, False, [1, 2, 3], {"Year": "2019"}]


def load(spark, docs):
    rows = [(i, json.dumps(d)) for i, d in docs.items()]
    return json_documents(spark.createDataFrame(rows, "doc_id string, doc string"))


def year_docs():
    docs, n = {}, 16
    for sale in (10, 5):
        for month in MIXED_MONTHS:
            docs[f"doc{n}"] = {"Year": "2019", "Sale": sale} | ({} if month is ... else {"Month": month})
            n += 1
    for i, sale in enumerate([0, 0, 0, -20, -20, "str"]):
        docs[f"e{i}"] = {"Year": "2020", "Month": 4, "Sale": sale}
    docs["e6"] = {"Year": "2020", "Month": 5, "Sale": None}
    docs["e7"] = {"Year": "2020", "Month": 5}
    docs["none"] = {"Month": 5}
    return docs


def year_index(spark, docs):
    keys = tuple(IndexKey(field(n), n.lower()) for n in ("Year", "Month", "Sale"))
    return ix.build(load(spark, docs), IndexDefinition("years", keys))


def calls(*names, position=2):
    made = []
    for n in names:
        function, _, distinct = n.partition("_")
        made.append(AggregateCall(n, Aggregate(function), position, distinct=bool(distinct)))
    return tuple(made)


def shown(rows, *names):
    return [tuple(json.loads(v.toJson()) if hasattr(v, "toJson") else v for v in (r[n] for n in names)) for r in rows.collect()]


def test_groups_tell_all_types_apart(spark):
    request = ScanRequest(
        spans=(Span.seek("2019"),), group=GroupAggregate((GroupKey("year", 0), GroupKey("month", 1)), calls("sum", "count")), group_projection=("month", "sum", "count")
    )
    found = shown(scan.scan(year_index(spark, year_docs()), request), "month", "sum", "count")
    assert len(found) == 8
    assert all(s == 15 and c == 2 for _, s, c in found)


def test_distinct_aggregates_of_mixed_values(spark):
    request = ScanRequest(spans=(Span.seek("2020"),), group=GroupAggregate((GroupKey("month", 1),), calls("sum_d", "count_d", "min", "max", "countn_d")))
    found = {m: rest for m, *rest in shown(scan.scan(year_index(spark, year_docs()), request), "month", "sum_d", "count_d", "min", "max", "countn_d")}
    assert found == {4: [-20, 3, -20, "str", 2], 5: [None, 0, None, None, 0]}


@pytest.mark.parametrize(
    ("values", "total", "n", "distinct_total", "distinct_n"),
    [
        ([10, 10, 10.5, 10.5, 20.7, 20, 20, 20.7, 20.0], 142.4, 9, 61.2, 4),
        ([411168601842738790] * 2 + [922337203685477580] * 2, 2667011611056432740, 4, 1333505805528216370, 2),
        ([-822337203685477580] * 2 + [10], -1644674407370955150, 3, -822337203685477570, 2),
        ([4111686018427387900] * 2 + [922337203685477580] * 2, 10068046444225730000.0, 4, 5034023222112865480, 2),
        ([-8223372036854775808] * 2 + [10], -16446744073709552000.0, 3, -8223372036854775798, 2),
    ],
)
def test_sums_stay_whole_until_they_overflow(spark, values, total, n, distinct_total, distinct_n):
    docs = {f"d{i}": {"Year": "1", "Month": 1, "Sale": v} for i, v in enumerate(values)}
    found = scan.scan(year_index(spark, docs), ScanRequest(group=GroupAggregate((), calls("sum", "count", "sum_d", "count_d"))))
    ((a, b, c, d),) = shown(found, "sum", "count", "sum_d", "count_d")
    assert (b, d) == (n, distinct_n)
    assert a == pytest.approx(total, rel=1e-12) and type(a) is type(total)
    assert c == pytest.approx(distinct_total, rel=1e-12) and type(c) is type(distinct_total)


def test_no_rows(spark):
    index = year_index(spark, year_docs())
    nothing = (Span.seek("1999"),)
    assert shown(scan.scan(index, ScanRequest(spans=nothing, group=GroupAggregate((), calls("count", "countn", "sum", "min")))), "count", "countn", "sum", "min") == [(0, 0, None, None)]
    assert shown(scan.scan(index, ScanRequest(spans=nothing, group=GroupAggregate((GroupKey("year", 0),), calls("count")))), "count") == []


def test_missing_leading_key_is_not_indexed_unless_asked(spark):
    docs = {f"d{i}": ({"v": 1} if i % 2 else {}) | {"n": i % 3} for i in range(10)}
    plain = ix.build(load(spark, docs), IndexDefinition("v", (IndexKey(field("v"), "v"),)))
    every = ix.build(load(spark, docs), IndexDefinition("v", (IndexKey(field("v"), "v", missing=True),)))
    assert (plain.rows.count(), every.rows.count()) == (5, 10)


@pytest.mark.parametrize(("tags", "single", "trailing"), [([], None, ...), (..., None, ...), (None, None, None), (7, None, None), ({"a": 1}, None, None)])
def test_array_corner_cases(spark, tags, single, trailing):
    docs = load(spark, {"d": {"name": "x"} | ({} if tags is ... else {"tags": tags})})
    tag, name = IndexKey(field("tags"), "tag", array=ArrayMode.ALL), IndexKey(field("name"), "name")
    lead = ix.build(docs, IndexDefinition("a", (tag, name))).rows
    last = ix.build(docs, IndexDefinition("b", (name, tag))).rows
    assert lead.count() == (0 if tags in ([], ...) else 1)
    kinds = [r["m"] for r in last.select(F.col("tag").isNull().alias("m")).collect()]
    assert kinds == [trailing is ...]


def test_array_duplicates(spark):
    docs = load(spark, {"d": {"tags": [1, 1.0, "a", "a", None, [1], [1]]}})
    for mode, n in ((ArrayMode.ALL, 7), (ArrayMode.DISTINCT, 4)):
        assert ix.build(docs, IndexDefinition("a", (IndexKey(field("tags"), "tag", array=mode),))).rows.count() == n


def test_flattened_keys(spark):
    docs = load(spark, {"d": {"friends": [{"name": "a", "age": 3}, {"name": "b"}, None]}})
    key = IndexKey(field("friends"), "f", array=ArrayMode.ALL, flatten=("name", "age"))
    index = ix.build(docs, IndexDefinition("f", (key,)))
    assert [k.name for k in index.keys] == ["f_name", "f_age"]
    assert shown(scan.lookup(index, "a"), "f_name", "f_age", "doc_id") == [("a", 3, "d")]


def test_spans_over_typed_columns(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1, 2, 3, 4, 5])], "doc_id int, k int")
    index = ix.build(rows, IndexDefinition("k", (IndexKey("k", "k"),)))
    ids = lambda *spans: sorted(r["doc_id"] for r in scan.multi_scan(index, *spans).collect())
    assert ids(Span((Range(high=2),))) == [0, 1, 2]  # null is below all numbers
    assert ids(Span((Range(None, 2, Inclusion.HIGH),))) == [1, 2]
    assert ids(Span.seek(None)) == [0]
    assert ids(Span((Range(low="a"),))) == []  # strings are above numbers
    assert ids(Span((Range(2, "a"),))) == [2, 3, 4, 5]
    assert ids(Span((Range(4, 2),)), Span.seek(1)) == [1]
    assert ids(Span((Range(3, 3, Inclusion.LOW),))) == []
    assert ids(Span((Range(1, 4, Inclusion.LOW),)), Span((Range(2, 5, Inclusion.NEITHER),))) == [1, 2, 3, 4]
    assert ids(Span((None,)), Span.seek(1)) == list(range(6))
    with pytest.raises(SpanError):
        scan.multi_scan(index, Span.seek(1, 2))


def test_variant_spans_cross_types(spark):
    docs = load(spark, {"n": {"k": 31}, "s": {"k": "x"}, "a": {"k": [1]}, "l": {"k": 30}, "z": {"k": None}})
    index = ix.build(docs, IndexDefinition("k", (IndexKey(field("k"), "k"),)))
    found = scan.range_scan(index, Range(low=30, inclusion=Inclusion.NEITHER))
    assert sorted(r["doc_id"] for r in found.collect()) == ["a", "n", "s"]


def test_projection_order_offset_limit_distinct(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 2) for i in range(12)], "doc_id int, a int, b int")
    index = ix.build(rows, IndexDefinition("ab", (IndexKey("a", "a", descending=True), IndexKey("b", "b"))))
    assert scan.scan(index, ScanRequest(projection=(1, 0))).columns == ["a", "b", "doc_id"]
    assert scan.scan(index, ScanRequest(projection=(0,), distinct=True)).count() == 3
    found = scan.scan(index, ScanRequest(sorted=True, offset=1, limit=3)).collect()
    assert [(r["a"], r["b"], r["doc_id"]) for r in found] == [(2, 0, 8), (2, 1, 5), (2, 1, 11)]
    found = scan.scan(index, ScanRequest(order=(OrderKey(1, True), OrderKey(0)), limit=2, projection=())).collect()
    assert [tuple(r) for r in found] == [(3,), (9,)]


def test_partial_groups_can_be_refused(spark):
    rows = spark.createDataFrame([(1, 1, 1)], "doc_id int, a int, b int")
    index = ix.build(rows, IndexDefinition("ab", (IndexKey("a", "a"), IndexKey("b", "b"))))
    with pytest.raises(GroupError):
        scan.scan(index, ScanRequest(group=GroupAggregate((GroupKey("b", 1),), calls("count", position=0), allow_partial=False)))


def test_elimination_keeps_results(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 50, f"n{i % 7}") for i in range(500)], "doc_id int, k int, s string")
    defn = IndexDefinition("k", (IndexKey("k", "k"), IndexKey("s", "s")), partition_by=("k", "s"), num_partition=8)
    made = ix.build(rows, defn)
    ix.store(made, f"{tmp_path}/k")
    stored = made.with_rows(spark.read.parquet(f"{tmp_path}/k"))
    spans = (Span.seek(7, "n3"), Span((equal(9), equal("n2"))))
    kinds = [k.kind for k in made.keys]
    assert 1 <= len(partitioning.eliminate(spark, spans, [0, 1], kinds, 8)) <= 2
    assert partitioning.eliminate(spark, (Span.seek(7),), [0, 1], kinds, 8) is None
    for index in (made, stored):
        found = scan.multi_scan(index, *spans)
        want = rows.where("(k = 7 AND s = 'n3') OR (k = 9 AND s = 'n2')")
        assert sorted(r["doc_id"] for r in found.collect()) == sorted(r["doc_id"] for r in want.collect())
    plan = scan.multi_scan(stored, *spans)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part_id" in plan


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS doc_id", "id % 9 AS k", "'x' AS unused").write.parquet(f"{tmp_path}/t")
    index = ix.build(spark.read.parquet(f"{tmp_path}/t"), IndexDefinition("k", (IndexKey("k", "k"),)))
    plan = scan.range_scan(index, Range(2, 5))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,2)" in plan and "unused" not in plan.split("ReadSchema")[1]


def test_partitions_of_every_type(spark):
    """Scans of partitioned rows find what plain scans do, whatever form a bound has."""
    day = datetime.date(2024, 2, 29)
    rows = [(i, x) for i, x in enumerate([0, 1, 7, 10_000_000_000, None])]
    cases = [
        ("bigint", rows, [7, 7.0, 7.5, Decimal("7.00"), None, True, "7"]),
        ("double", [(0, 0.0), (1, -0.0), (2, 1e10), (3, 1e-5), (4, 7.0), (5, None)], [0, -0.0, 1e10, 10**10, 1e-5, 7, Decimal("7.0")]),
        ("float", [(0, 0.5), (1, 7.0)], [0.5, 7]),
        ("decimal(10,2)", [(0, Decimal("1.50")), (1, Decimal("7.00"))], [1.5, Decimal("1.500"), 7]),
        ("date", [(0, day), (1, None)], [day, "2024-02-29"]),
        ("string", [(0, "a\x1fb"), (1, "é\n\"\\"), (2, ""), (3, "true")], ["a\x1fb", "é\n\"\\", "", "true"]),
        ("boolean", [(0, True), (1, False), (2, None)], [True, False, None]),
    ]
    for kind, data, bounds in cases:
        frame = spark.createDataFrame(data, f"doc_id int, k {kind}")
        parts = ix.build(frame, IndexDefinition("p", (IndexKey("k", "k"),), partition_by=("k",), num_partition=16))
        plain = ix.build(frame, IndexDefinition("q", (IndexKey("k", "k"),)))
        for bound in bounds:
            try:
                want = sorted(r["doc_id"] for r in scan.lookup(plain, bound).collect())
            except Exception as e:  # a string that isn't a number, as Spark compares
                assert "CAST_INVALID_INPUT" in str(e)
                continue
            assert sorted(r["doc_id"] for r in scan.lookup(parts, bound).collect()) == want, (kind, bound)


def test_true_is_no_number(spark):
    index = ix.build(spark.createDataFrame([(1, 1), (2, None)], "doc_id int, k int"), IndexDefinition("k", (IndexKey("k", "k"),)))
    assert scan.lookup(index, True).isEmpty()


def test_limit_of_variant_groups(spark):
    frame = spark.createDataFrame([(1, "3"), (2, '"a"'), (3, "1"), (4, "3.0")], "doc_id int, j string").selectExpr("doc_id", "parse_json(j) AS k")
    index = ix.build(frame, IndexDefinition("k", (IndexKey("k", "k"),)))
    request = ScanRequest(group=GroupAggregate((GroupKey("k", 0),), (AggregateCall("n", Aggregate.COUNT, 0),)), offset=1, limit=1)
    assert [r["n"] for r in scan.scan(index, request).collect()] == [2]


def test_array_delta_counts(spark):
    frame = spark.createDataFrame([(["a", "a", "b", None], ["a", "c", "c", None, None])], "o array<string>, n array<string>")
    gone, come = frame.select(*ix.array_delta(F.col("o"), F.col("n"))).first()
    assert sorted(gone) == ["a", "b"] and come == ["c", "c", None]
