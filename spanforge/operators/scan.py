"""Scan requests to DataFrame plans, and the simpler scans and counts as wrappers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.request import OrderKey, Range, ScanRequest, Span
from . import aggregate, vector
from .index import Index
from .keys import KeyColumn
from .partitioning import PART, eliminate
from .spans import apply_spans


class RequestError(ValueError):
    pass


def pruned(index: Index, request: ScanRequest) -> DataFrame:
    """Rows of the partitions that the spans can reach."""
    rows = index.rows
    ids = set(request.partition_ids) if request.partition_ids is not None else None
    positions = index.partition_positions()
    if positions is not None and PART in rows.columns:
        kinds = [index.keys[p].kind for p in positions]
        reach = eliminate(rows.sparkSession, request.spans, positions, kinds, index.definition.num_partition)
        if reach is not None:
            ids = reach if ids is None else ids & reach
    if ids is None:
        return rows
    if PART not in rows.columns:
        raise RequestError("the index has no partitions")
    return rows.where(F.col(PART).isin(sorted(ids)))


def filtered(index: Index, request: ScanRequest) -> DataFrame:
    rows = apply_spans(pruned(index, request), index.keys, request.spans)
    if request.include_spans:
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        rows = apply_spans(rows, [KeyColumn(name, kinds[name]) for name in index.includes], request.include_spans)
    if request.inline_filter is not None:
        rows = rows.where(F.coalesce(F.expr(request.inline_filter), F.lit(False)))
    return rows


def measured(index: Index, request: ScanRequest, rows: DataFrame) -> DataFrame:
    """Rows with the distance in the vector key's place; those whose vector has no distance are left out."""
    asked = request.vector
    if not 0 <= asked.position < len(index.keys):
        raise RequestError(f"no key at position {asked.position}")
    metric = vector.metric_of(asked.similarity)
    query = vector.check_query(asked.query, metric)
    name = index.keys[asked.position].name
    rows = rows.withColumn(name, vector.distance(vector.valid_dense(F.col(f"`{name}`"), len(query), metric), query, metric))
    return rows.where(F.col(f"`{name}`").isNotNull())


def projected_names(index: Index, request: ScanRequest) -> list[str]:
    """Key and include columns, in index order whatever the request's order is."""
    every = [k.name for k in index.keys] + list(index.includes)
    if request.projection is None:
        return every
    if any(not 0 <= p < len(every) for p in request.projection):
        raise RequestError(f"projection {request.projection} of {len(every)} columns")
    return [every[p] for p in sorted(set(request.projection))]


def order_columns(index: Index, request: ScanRequest) -> list[Column]:
    if request.order is None and request.vector is not None:
        found = [_ordered(index, OrderKey(position=request.vector.position), request.reverse)]
    elif request.order is None:
        found = [k.order(request.reverse) for k in index.keys]
    else:
        if request.vector is None and any(o.distance for o in request.order):
            raise RequestError("an order by distance without a vector")
        found = [_ordered(index, OrderKey(request.vector.position, o.descending) if o.distance else o, request.reverse) for o in request.order]
    tie = F.col(f"`{index.doc_id}`")
    return [*found, tie.desc() if request.reverse else tie.asc()]


def _ordered(index: Index, order: OrderKey, reverse: bool) -> Column:
    if order.name is not None:
        c = F.col(f"`{order.name}`")
        return c.desc_nulls_last() if order.descending != reverse else c.asc_nulls_first()
    if order.position is None or not 0 <= order.position < len(index.keys):
        raise RequestError(f"no key at position {order.position}")
    key = index.keys[order.position]
    return KeyColumn(key.name, key.kind, order.descending).order(reverse)


def cut(rows: DataFrame, request: ScanRequest) -> DataFrame:
    """Offset and limit; a limit of 0 is none."""
    if request.offset:
        rows = rows.offset(request.offset)
    return rows.limit(request.limit) if request.limit else rows


def scan(index: Index, request: ScanRequest) -> DataFrame:
    rows = filtered(index, request)
    if request.group is not None:
        found = aggregate.group(rows, index.keys, request.group, index.doc_id)
        if request.group_projection is not None:
            found = found.select(*request.group_projection)
        if request.offset or request.limit:
            groups = [g.name for g in request.group.groups]
            kinds = {f.name: f.dataType for f in found.schema.fields}
            found = found.orderBy(*[KeyColumn(g, kinds[g]).order() for g in groups if g in kinds])
        return cut(found, request)
    if request.vector is not None:
        rows = measured(index, request, rows)
    names = projected_names(index, request)
    primary = index.definition.primary
    if request.distinct and not primary:
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        values = {n: KeyColumn(n, kinds[n]) for n in names}
        marks = {f"_mark_{i}": k.value() for i, k in enumerate(values.values()) if k.dynamic}
        plain = [n for n, k in values.items() if not k.dynamic]
        found = rows.select(*[f"`{n}`" for n in names]).withColumns(marks).dropDuplicates([*plain, *marks]).drop(*marks)
        if request.sorted or request.offset or request.limit:
            found = found.orderBy(*[k.order(request.reverse) for k in index.keys if k.name in names])
        return cut(found, request)
    shown = [f"`{n}`" for n in names if n != index.doc_id]
    if request.project_doc_id or primary:
        shown.append(f"`{index.doc_id}`")
    if request.order is not None or request.vector is not None or request.sorted or request.reverse or request.offset or request.limit:
        # Columns that only the order needs are dropped after it.
        rows = rows.orderBy(*order_columns(index, request))
    return cut(rows, request).select(*shown)


def scan_all(index: Index) -> DataFrame:
    return scan(index, ScanRequest())


def lookup(index: Index, *values: object) -> DataFrame:
    """Rows whose leading keys equal the values."""
    return scan(index, ScanRequest(spans=(Span.seek(*values),)))


def range_scan(index: Index, *ranges: Range) -> DataFrame:
    return scan(index, ScanRequest(spans=(Span(tuple(ranges)),)))


def multi_scan(index: Index, *spans: Span) -> DataFrame:
    return scan(index, ScanRequest(spans=tuple(spans)))


def exists(index: Index, *values: object) -> bool:
    return not lookup(index, *values).limit(1).isEmpty()


def count(index: Index, spans: Sequence[Span] = ()) -> DataFrame:
    """One row: n. Duplicates of array entries count."""
    return apply_spans(index.rows, index.keys, spans).agg(F.count("*").alias("n"))


def count_lookup(index: Index, keys: Sequence[Sequence[object]]) -> DataFrame:
    return count(index, [Span.seek(*k) for k in keys]) if keys else index.rows.limit(0).agg(F.count("*").alias("n"))


def count_range(index: Index, *ranges: Range) -> DataFrame:
    return count(index, [Span(tuple(ranges))])


def count_distinct(index: Index, spans: Sequence[Span] = ()) -> DataFrame:
    """Distinct leading keys, null and missing among them."""
    lead = index.keys[0].value()
    return apply_spans(index.rows, index.keys, spans).select(lead.alias("k")).distinct().agg(F.count("*").alias("n"))


def statistics(index: Index, span: Span | None = None) -> DataFrame:
    """Row count, approximate number of leading keys, least and greatest of them."""
    rows = apply_spans(index.rows, index.keys, [span] if span else [])
    lead = index.keys[0]
    if lead.dynamic:
        key = F.when(lead.known(), lead.value())
        return rows.agg(F.count("*").alias("n"), F.approx_count_distinct(lead.value()).alias("n_unique"), F.min_by(lead.column, key).alias("least"), F.max_by(lead.column, key).alias("most"))
    return rows.agg(F.count("*").alias("n"), F.approx_count_distinct(lead.column).alias("n_unique"), F.min(lead.column).alias("least"), F.max(lead.column).alias("most"))


def partition_statistics(index: Index) -> DataFrame:
    """Rows of each partition."""
    part = F.col(PART) if PART in index.rows.columns else F.lit(0)
    return index.rows.groupBy(part.alias(PART)).agg(F.count("*").alias("n"))


def lead_key_histogram(index: Index, bins: int) -> DataFrame:
    lead = index.keys[0].column
    return index.rows.select(F.explode(F.histogram_numeric(lead.cast("double"), F.lit(bins))).alias("b")).select("b.x", F.col("b.y").alias("n"))


def sample(index: Index, n: int, seed: int = 1) -> DataFrame:
    """n rows by a hash of the document id: the same ones on every run."""
    doc_id = F.col(f"`{index.doc_id}`").cast("string")
    return index.rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), doc_id).cast("binary")), doc_id).limit(n)
