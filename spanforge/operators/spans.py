"""Spans to one filter: a row qualifies if any span's ranges all hold, and is returned once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.request import UNBOUNDED, Span
from .keys import KeyColumn, is_empty


class SpanError(ValueError):
    pass


def is_full(span: Span) -> bool:
    return all(r is None or (r.low is UNBOUNDED and r.high is UNBOUNDED) for r in span.ranges)


def span_predicate(keys: Sequence[KeyColumn], span: Span) -> Column | None:
    """None: no condition. More ranges than keys are an error; fewer are a prefix condition."""
    if len(span.ranges) > len(keys):
        raise SpanError(f"{len(span.ranges)} ranges for {len(keys)} keys")
    if any(r is not None and is_empty(r) for r in span.ranges):
        return F.lit(False)
    parts = [p for k, r in zip(keys, span.ranges, strict=False) if (p := k.predicate(r)) is not None]
    return reduce(lambda a, b: a & b, parts) if parts else None


def spans_predicate(keys: Sequence[KeyColumn], spans: Sequence[Span]) -> Column | None:
    """No spans, or one without bounds: a full scan."""
    if not spans or any(is_full(s) for s in spans):
        return None
    parts = [span_predicate(keys, s) for s in spans]
    if any(p is None for p in parts):
        return None
    return reduce(lambda a, b: a | b, parts)


def apply_spans(rows: DataFrame, keys: Sequence[KeyColumn], spans: Sequence[Span]) -> DataFrame:
    found = spans_predicate(keys, spans)
    return rows if found is None else rows.where(found)
