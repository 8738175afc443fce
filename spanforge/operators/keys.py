"""Key columns of an index: comparison, order and equality as the collation says.

A typed column compares natively, so that filters reach the Parquet scan; a VARIANT
column compares by its collation key.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import collation as C
from ..plans.request import UNBOUNDED, Inclusion, Range


def rank_of(value: object) -> int:
    if value is None:
        return C.NULL
    if isinstance(value, bool):
        return C.TRUE if value else C.FALSE
    if isinstance(value, (int, float, Decimal)):
        return C.NUMBER
    if isinstance(value, (str, datetime.date)):
        return C.STRING
    return C.ARRAY if isinstance(value, (list, tuple)) else C.OBJECT


def compare(a: object, b: object) -> int:
    """Of two bounds on the driver."""
    ra, rb = rank_of(a), rank_of(b)
    if ra != rb:
        return -1 if ra < rb else 1
    if isinstance(a, datetime.date) or isinstance(b, datetime.date):
        a, b = str(a), str(b)
    if ra in (C.NUMBER,) and not isinstance(a, bool):
        return (a > b) - (a < b)
    x, y = C.encode(list(a) if isinstance(a, tuple) else a), C.encode(list(b) if isinstance(b, tuple) else b)
    return (x > y) - (x < y)


def is_empty(r: Range) -> bool:
    """low > high, or low = high without both ends."""
    if r.low is UNBOUNDED or r.high is UNBOUNDED:
        return False
    order = compare(r.low, r.high)
    return order > 0 or (order == 0 and r.inclusion != Inclusion.BOTH)


@dataclass(frozen=True)
class KeyColumn:
    name: str
    kind: T.DataType
    descending: bool = False

    @property
    def dynamic(self) -> bool:
        return isinstance(self.kind, (T.VariantType, T.ArrayType, T.StructType, T.MapType))

    @property
    def column(self) -> Column:
        return F.col(f"`{self.name}`")

    def value(self) -> Column:
        """Comparable and groupable."""
        if isinstance(self.kind, T.VariantType):
            return C.variant_key(self.column)
        return self.column

    def order(self, reverse: bool = False) -> Column:
        down = self.descending != reverse
        return self.value().desc_nulls_last() if down else self.value().asc_nulls_first()

    def known(self) -> Column:
        """Neither null nor missing."""
        if isinstance(self.kind, T.VariantType):
            return self.column.isNotNull() & ~F.is_variant_null(self.column)
        return self.column.isNotNull()

    def _rank(self) -> int:
        if isinstance(self.kind, T.NumericType):
            return C.NUMBER
        return C.FALSE if isinstance(self.kind, T.BooleanType) else C.STRING

    def _own(self, value: object) -> bool:
        """Whether the value is of the column's rank."""
        rank = rank_of(value)
        return rank == self._rank() or (self._rank() == C.FALSE and rank == C.TRUE)

    def _compare(self, op: str, value: object) -> Column:
        literal = F.lit(value)
        return {">=": self.column >= literal, ">": self.column > literal, "<=": self.column <= literal, "<": self.column < literal}[op]

    def _low(self, value: object, included: bool) -> Column | None:
        """What a lower bound asks of a typed column; None: nothing."""
        if value is None:
            return None if included else self.column.isNotNull()
        rank, own = rank_of(value), self._rank()
        if own == C.FALSE and rank in (C.FALSE, C.TRUE):
            rank = own
        if rank == own:
            return self._compare(">=" if included else ">", value)
        return self.column.isNotNull() if rank < own else F.lit(False)

    def _high(self, value: object, included: bool, null_out: bool) -> Column | None:
        if value is None:
            return self.column.isNull() if included else F.lit(False)
        rank, own = rank_of(value), self._rank()
        if own == C.FALSE and rank in (C.FALSE, C.TRUE):
            rank = own
        if rank == own:
            below = self._compare("<=" if included else "<", value)
            return below if null_out else below | self.column.isNull()
        return self.column.isNull() if rank < own else None

    def predicate(self, r: Range | None) -> Column | None:
        """The condition of a range; None: no condition."""
        if r is None or (r.low is UNBOUNDED and r.high is UNBOUNDED):
            return None
        if is_empty(r):
            return F.lit(False)
        low_in, high_in = r.inclusion in (Inclusion.LOW, Inclusion.BOTH), r.inclusion in (Inclusion.HIGH, Inclusion.BOTH)
        parts: list[Column] = []
        if isinstance(self.kind, (T.VariantType, T.ArrayType)):
            key = C.variant_key(self.column) if isinstance(self.kind, T.VariantType) else self.column
            lit = C.literal_key if isinstance(self.kind, T.VariantType) else F.lit
            if r.low is not UNBOUNDED:
                parts.append(key >= lit(r.low) if low_in else key > lit(r.low))
            if r.high is not UNBOUNDED:
                parts.append(key <= lit(r.high) if high_in else key < lit(r.high))
        elif r.low is not UNBOUNDED and r.high is not UNBOUNDED and compare(r.low, r.high) == 0 and self._own(r.low):
            parts.append(self.column == F.lit(r.low))
        else:
            low = None if r.low is UNBOUNDED else self._low(r.low, low_in)
            high = None if r.high is UNBOUNDED else self._high(r.high, high_in, null_out=low is not None)
            parts += [p for p in (low, high) if p is not None]
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0] & parts[1]
