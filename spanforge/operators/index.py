"""Building an index table from documents: keys, partial and array indexes, include columns, partitions.

A document whose leading key is missing is not indexed (unless the key says so); a
leading null is. Of an array key every element is a row: all of them, or distinct
ones per document. An empty or missing array is not indexed if it leads, else its key
is missing; a value that is no array has one row with key null. ``where`` keeps rows
for which it is exactly true.

VARIANT expressions tell missing (SQL NULL) and null apart; typed columns have null only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import collation as C
from ..plans.request import ArrayMode, IndexDefinition, IndexKey
from .keys import KeyColumn
from .partitioning import PART, hashable, partition_id

VARIANT = T.VariantType()


@dataclass(frozen=True)
class Index:
    """The rows of an index (key columns, doc_id, include columns, part_id) and what its columns are."""

    definition: IndexDefinition
    rows: DataFrame
    keys: tuple[KeyColumn, ...]
    includes: tuple[str, ...] = ()

    @property
    def doc_id(self) -> str:
        return self.definition.doc_id

    def partition_positions(self) -> list[int] | None:
        """Positions of the partition keys among the index keys; None: not all are index keys."""
        exprs = [k.expr for k in self.definition.keys]
        found = [exprs.index(p) if p in exprs else -1 for p in self.definition.partition_by]
        return found if found and min(found) >= 0 else None

    def with_rows(self, rows: DataFrame) -> Index:
        return replace(self, rows=rows)


def _distinct_first(elements: Column) -> Column:
    """Of the elements of a VARIANT array, the first of each value."""
    keyed = F.transform(elements, lambda e: F.concat_ws("|", C.kind_of(e).cast("string"), _canonical(e)))
    paired = F.arrays_zip(elements.alias("e"), keyed.alias("k"))
    return F.transform(
        F.filter(F.transform(paired, lambda p, i: F.struct(p["e"].alias("e"), p["k"].alias("k"), i.alias("i"))), lambda p: F.array_position(keyed, p["k"]) == p["i"] + 1),
        lambda p: p["e"],
    )


def _canonical(e: Column) -> Column:
    """A text that equal values share: numbers by value, others by their JSON."""
    text = F.try_variant_get(e, "$", "string")
    number = F.coalesce(text.try_cast("decimal(38,0)").cast("string"), text.try_cast("double").cast("string"))
    whole = text.try_cast("double") == F.floor(text.try_cast("double"))
    return F.when(C.kind_of(e) == C.NUMBER, F.when(whole, number).otherwise(text.try_cast("double").cast("string"))).otherwise(F.to_json(e))


def _elements(rows: DataFrame, key: IndexKey, leading: bool) -> DataFrame:
    """Explodes an array key held in column ``_array``."""
    kind = rows.schema["_array"].dataType
    value = F.col("_array")
    if isinstance(kind, T.VariantType):
        items = F.try_variant_get(value, "$", "array<variant>")
        null = F.parse_json(F.lit("null"))
        is_array = C.kind_of(value) == C.ARRAY
        items = F.when(is_array, _distinct_first(items) if key.array == ArrayMode.DISTINCT else items)
        absent = value.isNull() | (is_array & (F.size(items) == 0))
        one_null, none = F.array(null), F.array(F.lit(None).cast("variant"))
    else:
        items = F.array_distinct(value) if key.array == ArrayMode.DISTINCT else value
        absent = F.coalesce(F.size(value) == 0, F.lit(False))
        is_array = value.isNotNull()
        one_null = none = F.array(F.lit(None).cast(kind.elementType))
    if leading:
        rows = rows.where(~absent)
    return rows.withColumn("_item", F.explode(F.when(absent, none).when(is_array, items).otherwise(one_null)))


def _flat(item: Column, kind: T.DataType, name: str) -> Column:
    if isinstance(kind, T.VariantType):
        own = F.try_variant_get(item, f"$.{name}", "variant")
        return F.when(item.isNotNull() & F.is_variant_null(item), F.parse_json(F.lit("null"))).otherwise(own)
    return item[name]


def build(source: DataFrame, definition: IndexDefinition) -> Index:
    rows = source if definition.where is None else source.where(F.coalesce(F.expr(definition.where), F.lit(False)))
    if definition.primary:
        rows = rows.select(F.col(definition.doc_id))
        return Index(definition, rows, (KeyColumn(definition.doc_id, rows.schema[0].dataType),))
    vectors = [k for k in definition.keys if k.vector]
    if len(vectors) > 1:
        raise ValueError("an index has one vector key at most")
    held = {k.name: F.expr(k.expr) for k in definition.keys if k.array == ArrayMode.NONE}
    arrays = [k for k in definition.keys if k.array != ArrayMode.NONE]
    if len(arrays) > 1:
        raise ValueError("an index has one array key at most")
    columns = [F.expr(definition.doc_id).alias(definition.doc_id)] if definition.doc_id in source.columns else [F.col(definition.doc_id)]
    columns += [c.alias(n) for n, c in held.items() if n != definition.doc_id]
    columns += [F.expr(e).alias(n) for n, e in definition.include]
    if definition.partition_by:
        by = [hashable(F.expr(e), source.select(F.expr(e)).schema[0].dataType) for e in definition.partition_by]
        columns.append(partition_id(by, definition.num_partition).alias(PART))
    columns += [F.expr(k.expr).alias("_array") for k in arrays]
    rows = rows.select(*columns)
    lead = definition.keys[0]
    names: list[tuple[str, bool]] = []
    for position, key in enumerate(definition.keys):
        if key.array == ArrayMode.NONE:
            names.append((key.name, key.descending))
            continue
        rows = _elements(rows, key, position == 0 and not key.missing)
        kind = rows.schema["_item"].dataType
        if key.flatten:
            fields = [(f"{key.name}_{f}" if len(key.flatten) > 1 or key.name != f else f, f) for f in key.flatten]
            rows = rows.withColumns({n: _flat(F.col("_item"), kind, f) for n, f in fields})
            names += [(n, key.descending) for n, _ in fields]
        else:
            rows = rows.withColumn(key.name, F.col("_item"))
            names.append((key.name, key.descending))
    rows = rows.drop("_array", "_item")
    first = names[0][0]
    dynamic = isinstance(rows.schema[first].dataType, T.VariantType)
    if (dynamic or lead.vector) and not lead.missing:
        rows = rows.where(F.col(f"`{first}`").isNotNull())
    if definition.max_key_bytes is not None:
        size = sum((F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{n}`").alias("k")))), F.lit(0)) for n, _ in names), F.lit(0))
        rows = rows.where(size <= definition.max_key_bytes)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    keys = tuple(KeyColumn(n, kinds[n], d) for n, d in names)
    return Index(definition, rows, keys, tuple(n for n, _ in definition.include))


def store(index: Index, path: str) -> None:
    """Writes an index in key order, partitioned by part_id if it has partitions."""
    order = [k.order() for k in index.keys if not k.dynamic]
    rows = index.rows.sortWithinPartitions(*order) if order and not index.definition.partition_by else index.rows
    if index.definition.partition_by:
        rows = rows.repartition(PART).sortWithinPartitions(PART, *order)
        rows.write.partitionBy(PART).parquet(path)
    else:
        rows.write.parquet(path)


def array_delta(old: Column, new: Column) -> tuple[Column, Column]:
    """Entries to delete and to insert when an array value changes: of each, as many as there are more of than in the other."""

    def more(a: Column, b: Column) -> Column:
        count = lambda items, v: F.size(F.filter(items, lambda x: x.eqNullSafe(v)))
        return F.flatten(F.transform(F.array_distinct(a), lambda v: F.array_repeat(v, F.greatest(F.lit(0), count(a, v) - count(b, v)))))

    return more(old, new), more(new, old)
