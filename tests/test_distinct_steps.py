"""Distinct aggregates of a typed column: no row is repeated, and results are those of sets."""

from decimal import Decimal

import pytest

from spanforge.operators import index as ix
from spanforge.operators import scan
from spanforge.plans.request import Aggregate, AggregateCall, GroupAggregate, GroupKey, IndexDefinition, IndexKey, ScanRequest

MOST = (1 << 63) - 1


def calls():
    made = [AggregateCall(f"{f}{d}", f, 1, distinct=bool(d)) for f in Aggregate for d in ("", "_d")]
    return (*made, AggregateCall("other", Aggregate.SUM, 2), AggregateCall("others", Aggregate.COUNT, 2), AggregateCall("last", Aggregate.MAX, 2))


def asked(spark, rows, kind, groups):
    frame = spark.createDataFrame(rows, f"doc_id int, g string, v {kind}, w double")
    index = ix.build(frame, IndexDefinition("i", tuple(IndexKey(k, k) for k in "gvw")))
    return scan.scan(index, ScanRequest(group=GroupAggregate(groups, calls())))


def expected(rows, number):
    v, w = [r[2] for r in rows if r[2] is not None], [r[3] for r in rows if r[3] is not None]
    total, distinct = (sum(v) if v and number else None), (sum(set(v)) if v and number else None)
    own = {"sum": total, "sum_d": distinct, "count": len(v), "count_d": len(set(v)), "countn": len(v) * number, "countn_d": len(set(v)) * number}
    own |= {"min": min(v, default=None), "max": max(v, default=None), "min_d": min(v, default=None), "max_d": max(v, default=None)}
    return own | {"other": sum(w) if w else None, "others": len(w), "last": max(w, default=None)}


@pytest.mark.parametrize(("kind", "values"), [("bigint", [MOST, MOST, -3, None, MOST - 1, -3]), ("double", [0.5, 0.5, 2.0, None, 4.0, 2.0]), ("string", ["a", "b", "a", None, "c", "c"])])
def test_by_value_and_count(spark, kind, values):
    rows = [(i, g, v, w) for i, (g, v, w) in enumerate([*(("x", v, 1.5) for v in values), *((None, v, None) for v in values[:4]), ("y", None, 2.0)])]
    found = asked(spark, rows, kind, (GroupKey("g", 0),))
    # Expand repeats each row for each distinct expression.
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        plain = {k: int(v) if isinstance(v, Decimal) else v for k, v in r.asDict().items()}
        assert plain == {"g": r.g} | expected([x for x in rows if x[1] == r.g], kind != "string")
    (r,) = asked(spark, rows[:0], kind, ()).collect()
    assert r.asDict() == expected([], kind != "string")
