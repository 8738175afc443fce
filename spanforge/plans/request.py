"""Index definitions and scan requests, as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum, StrEnum


class Inclusion(IntEnum):
    NEITHER = 0
    LOW = 1
    HIGH = 2
    BOTH = 3


class _Unbounded:
    def __repr__(self) -> str:
        return "UNBOUNDED"


UNBOUNDED = _Unbounded()


@dataclass(frozen=True)
class Range:
    """Bounds of one key position."""

    low: object = UNBOUNDED
    high: object = UNBOUNDED
    inclusion: Inclusion = Inclusion.BOTH


def equal(value: object) -> Range:
    return Range(value, value, Inclusion.BOTH)


@dataclass(frozen=True)
class Span:
    """Ranges by key position, all of which have to hold; positions beyond them are free."""

    ranges: tuple[Range | None, ...] = ()

    @classmethod
    def seek(cls, *values: object) -> Span:
        return cls(tuple(equal(v) for v in values))


class Aggregate(StrEnum):
    SUM = "sum"
    COUNT = "count"
    COUNTN = "countn"
    MIN = "min"
    MAX = "max"


@dataclass(frozen=True)
class GroupKey:
    """A key position, or an SQL expression over key columns and doc_id."""

    name: str
    position: int | None = None
    expr: str | None = None


@dataclass(frozen=True)
class AggregateCall:
    name: str
    function: Aggregate
    position: int | None = None
    expr: str | None = None
    distinct: bool = False


@dataclass(frozen=True)
class GroupAggregate:
    groups: tuple[GroupKey, ...] = ()
    aggregates: tuple[AggregateCall, ...] = ()
    #: Count every document once, if its leading key is an array with equality spans.
    one_per_document: bool = False
    #: False: refuse groups that aren't a leading run of keys, as a server that can't send partial results does.
    allow_partial: bool = True


@dataclass(frozen=True)
class OrderKey:
    position: int | None = None
    descending: bool = False
    #: Order by the vector's distance.
    distance: bool = False
    name: str | None = None


@dataclass(frozen=True)
class VectorQuery:
    """The distance of the vector key at a position from ``query``; it takes the key's place in results and orders."""

    position: int
    query: tuple[float, ...]
    similarity: str = "L2"


@dataclass(frozen=True)
class ScanRequest:
    """One scan: spans (any may hold), projection, distinct, order, offset and limit, groups and aggregates.

    ``projection``: key positions; None: all keys and include columns; positions behind the keys address
    include columns. A limit of None or 0 is no limit.
    """

    spans: tuple[Span, ...] = ()
    projection: tuple[int, ...] | None = None
    project_doc_id: bool = True
    distinct: bool = False
    order: tuple[OrderKey, ...] | None = None
    sorted: bool = False
    reverse: bool = False
    offset: int = 0
    limit: int | None = None
    group: GroupAggregate | None = None
    #: Names of group keys and aggregates in the order in which they are returned.
    group_projection: tuple[str, ...] | None = None
    inline_filter: str | None = None
    #: Ranges by position of include columns, any of which may hold, before order and limit.
    include_spans: tuple[Span, ...] = ()
    #: Without an order, the nearest rows come first, ties by document id.
    vector: VectorQuery | None = None
    partition_ids: tuple[int, ...] | None = None


class ArrayMode(StrEnum):
    NONE = "none"
    ALL = "all"
    DISTINCT = "distinct"


@dataclass(frozen=True)
class IndexKey:
    """One key: an SQL expression over the source's columns. An array key takes the elements of it; ``flatten`` takes fields of those."""

    expr: str
    name: str
    descending: bool = False
    array: ArrayMode = ArrayMode.NONE
    flatten: tuple[str, ...] = ()
    vector: bool = False
    missing: bool = False


@dataclass(frozen=True)
class IndexDefinition:
    name: str
    keys: tuple[IndexKey, ...] = ()
    doc_id: str = "doc_id"
    where: str | None = None
    include: tuple[tuple[str, str], ...] = ()
    partition_by: tuple[str, ...] = ()
    num_partition: int = 8
    primary: bool = False
    max_key_bytes: int | None = None
    options: dict = field(default_factory=dict, hash=False, compare=False)
