"""Cross-type JSON collation.

Order of types: MISSING < null < false < true < number < string < array < object.
Strings compare by bytes; numbers by value, with all digits of integers beyond
2**53; arrays element by element, a prefix first; objects by their number of
properties first, then by (name, value) pairs in name order.

A collation key is ``struct<rank, num, exact, str, items>``, which Spark can sort,
group and compare without leaving the JVM: ``num`` and ``exact`` for numbers, ``str``
for strings, ``items`` for the keys of an array's elements, or of an object's number
of properties, names and values. Nesting beyond DEPTH levels compares by JSON text.
``rank`` is never null.

Typed columns have no MISSING: SQL NULL is null there. VARIANT values keep the two
apart: an absent path is SQL NULL (MISSING), a JSON null is not.
"""

from __future__ import annotations

import json
import struct
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING, NULL, FALSE, TRUE, NUMBER, STRING, ARRAY, OBJECT = 1, 2, 3, 4, 5, 6, 8, 9
#: Markers of the byte encoding: in the order of types, above the terminator.
END = b"\x00"


DEPTH = 3


def key_type(depth: int = DEPTH) -> str:
    items = f", items: array<{key_type(depth - 1)}>" if depth else ""
    return f"struct<rank: tinyint, num: double, exact: decimal(38,0), str: string{items}>"


def _key(rank: Column, num: Column | None = None, exact: Column | None = None, text: Column | None = None, items: Column | None = None, depth: int = DEPTH) -> Column:
    none = lambda t: F.lit(None).cast(t)
    fields = [
        rank.cast("tinyint").alias("rank"),
        (none("double") if num is None else num).alias("num"),
        (none("decimal(38,0)") if exact is None else exact).alias("exact"),
        (none("string") if text is None else text).alias("str"),
    ]
    if depth:
        fields.append((none(f"array<{key_type(depth - 1)}>") if items is None else items).alias("items"))
    return F.struct(*fields)


def typed_key(column: Column, kind: T.DataType, missing: bool = False) -> Column:
    """The key of a typed column. ``missing``: NULL stands for an absent value."""
    absent = F.lit(MISSING if missing else NULL)
    if isinstance(kind, T.BooleanType):
        return _key(F.when(column.isNull(), absent).when(column, TRUE).otherwise(FALSE))
    if isinstance(kind, T.NumericType):
        num = column.cast("double")
        whole = num == F.floor(num) if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)) else F.lit(True)
        return _key(F.when(column.isNull(), absent).otherwise(NUMBER), num, F.when(whole, column.try_cast("decimal(38,0)")))
    if isinstance(kind, T.VariantType):
        return variant_key(column)
    return _key(F.when(column.isNull(), absent).otherwise(STRING), text=column.cast("string"))


def kind_of(variant: Column) -> Column:
    """The type rank of a VARIANT value."""
    name = F.schema_of_variant(variant)
    return (
        F.when(variant.isNull(), MISSING)
        .when(F.is_variant_null(variant), NULL)
        .when(name == "BOOLEAN", F.when(F.try_variant_get(variant, "$", "boolean"), TRUE).otherwise(FALSE))
        .when(name == "STRING", STRING)
        .when(name.startswith("ARRAY"), ARRAY)
        .when(name.startswith("OBJECT"), OBJECT)
        .otherwise(NUMBER)
    )


def variant_key(variant: Column, depth: int = DEPTH) -> Column:
    """The key of a VARIANT value."""
    rank = kind_of(variant)
    text = F.try_variant_get(variant, "$", "string")
    number = F.when(rank == NUMBER, text)
    num = number.try_cast("double")
    exact = F.when(num == F.floor(num), number.try_cast("decimal(38,0)"))
    if not depth:
        return _key(rank, num, exact, F.when(rank == STRING, text).when(rank >= ARRAY, F.to_json(variant)), depth=0)
    below = depth - 1
    listed = F.transform(F.try_variant_get(variant, "$", "array<variant>"), lambda e: variant_key(e, below))
    fields = F.try_variant_get(variant, "$", "map<string,variant>")
    count = _key(F.lit(NUMBER), F.size(fields).cast("double"), F.size(fields).cast("decimal(38,0)"), depth=below)
    named = F.transform(
        F.array_sort(F.map_keys(fields)),
        lambda k: F.array(_key(F.lit(STRING), text=k, depth=below), variant_key(F.element_at(fields, k), below)),
    )
    items = F.when(rank == ARRAY, listed).when(rank == OBJECT, F.concat(F.array(count), F.flatten(named)))
    return _key(rank, num, exact, F.when(rank == STRING, text), items, depth)


def encode(value: object) -> bytes:
    """Bytes that sort as JSON values do, for comparisons on the driver."""
    if value is None:
        return bytes([NULL])
    if value is False:
        return bytes([FALSE])
    if value is True:
        return bytes([TRUE])
    if isinstance(value, (int, float, Decimal)):
        near = float(value)
        bits = struct.unpack(">Q", struct.pack(">d", near + 0.0))[0]
        bits = bits ^ 0xFFFFFFFFFFFFFFFF if bits >> 63 else bits | 1 << 63
        # What an integer is above its double, so that those beyond 2**53 stay apart.
        rest = int(value) - int(near) if isinstance(value, int) else 0
        return bytes([NUMBER]) + struct.pack(">Q", bits) + struct.pack(">Q", rest + (1 << 63))
    if isinstance(value, str):
        return bytes([STRING]) + value.encode("utf-8", "surrogatepass").replace(b"\x00", b"\x00\xff") + END + END
    if isinstance(value, list):
        return bytes([ARRAY]) + b"".join(map(encode, value)) + END
    pairs = sorted(value.items(), key=lambda kv: kv[0].encode("utf-8", "surrogatepass"))
    return bytes([OBJECT]) + struct.pack(">I", len(pairs)) + b"".join(encode(k) + encode(v) for k, v in pairs) + END


def literal_key(value: object, missing: bool = False) -> Column:
    """The key of a Python value."""
    if missing:
        return _key(F.lit(MISSING))
    if value is None:
        return _key(F.lit(NULL))
    if isinstance(value, bool):
        return _key(F.lit(TRUE if value else FALSE))
    if isinstance(value, (int, float, Decimal)):
        whole = abs(value) < 10**38 and value == int(value)
        exact = F.lit(Decimal(int(value))).cast("decimal(38,0)") if whole else None
        return _key(F.lit(NUMBER), F.lit(float(value)), exact)
    if isinstance(value, str):
        return _key(F.lit(STRING), text=F.lit(value))
    return variant_key(F.parse_json(F.lit(json.dumps(value))))
