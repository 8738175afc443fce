"""Vector scans: the distance in the key's place, orders by it, ranges over include columns."""

import pytest

from spanforge.operators import index as ix
from spanforge.operators import scan
from spanforge.operators.vector import VectorError
from spanforge.plans.request import IndexDefinition, IndexKey, OrderKey, Range, ScanRequest, Span, VectorQuery

ROWS = [(1, "a", [0.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "a", [2.0, 0.0]), (4, "b", [3.0, 0.0]), (5, "a", None), (6, "b", [1.0]), (7, None, [1.0, 0.0])]
NEAR = VectorQuery(1, (1.0, 0.0))


@pytest.fixture(scope="module")
def index(spark):
    source = spark.createDataFrame(ROWS, "id long, kind string, v array<double>")
    keys = (IndexKey("kind", "kind"), IndexKey("v", "v", vector=True))
    return ix.build(source, IndexDefinition("v", keys, doc_id="id", include=(("odd", "id % 2"), ("half", "id div 2"))))


def found(index, **request):
    return [tuple(r) for r in scan.scan(index, ScanRequest(vector=NEAR, **request)).collect()]


def test_distance_takes_the_key_s_place(index):
    assert found(index, projection=(1,)) == [(0.0, 2), (0.0, 7), (1.0, 1), (1.0, 3), (4.0, 4)]
    assert found(index, projection=(0, 1), limit=2, offset=1) == [(None, 0.0, 7), ("a", 1.0, 1)]


def test_order_by_scalars_and_distance(index):
    order = (OrderKey(0), OrderKey(distance=True, descending=True))
    assert found(index, projection=(0, 1), order=order) == [(None, 0.0, 7), ("a", 1.0, 1), ("a", 1.0, 3), ("b", 4.0, 4), ("b", 0.0, 2)]
    with pytest.raises(scan.RequestError):
        scan.scan(index, ScanRequest(order=order))


def test_ranges_of_include_columns_come_before_the_limit(index):
    odd = Span((Range(1, 1),))
    assert found(index, projection=(1,), include_spans=(odd,), limit=2) == [(0.0, 7), (1.0, 1)]
    either = (Span((None, Range(2, 2))), Span((Range(1, 1), Range(3))))
    # Row 4 by its half, row 7 by both columns; row 5 has no vector.
    assert found(index, projection=(1,), include_spans=either) == [(0.0, 7), (4.0, 4)]
    assert found(index, projection=(1,), include_spans=(odd,), spans=(Span.seek("a"),)) == [(1.0, 1), (1.0, 3)]


def test_faulty_requests(index):
    with pytest.raises(scan.RequestError):
        scan.scan(index, ScanRequest(vector=VectorQuery(2, (1.0,))))
    with pytest.raises(VectorError):
        scan.scan(index, ScanRequest(vector=VectorQuery(1, (1.0, 0.0), "HAMMING")))
