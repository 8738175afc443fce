"""Groups and the five aggregates, plain and distinct.

SUM takes numbers only, and is null without any; integers are summed exactly. COUNT
counts all but null and missing, COUNTN numbers, MIN and MAX go by the collation.
Groups tell null and missing apart. A global aggregate of no rows is one row, a
grouped one none. Results are always final, never partial.

Distinct aggregates of one typed column take two steps: rows are counted by groups and
value, then values by groups. So no row is repeated for each distinct aggregate, and what
a task holds is a count for each value that it meets.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import collation as C
from ..plans.request import Aggregate, AggregateCall, GroupAggregate, GroupKey
from .keys import KeyColumn


class GroupError(ValueError):
    pass


INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _source(call: AggregateCall | GroupKey, keys: Sequence[KeyColumn], kinds: dict[str, T.DataType]) -> KeyColumn:
    if call.position is not None:
        if not 0 <= call.position < len(keys):
            raise GroupError(f"no key at position {call.position}")
        return keys[call.position]
    return KeyColumn(f"_expr_{call.name}", kinds[f"_expr_{call.name}"])


def _sum(values: KeyColumn, distinct: bool) -> Column:
    how = F.sum_distinct if distinct else F.sum
    if isinstance(values.kind, INTEGRAL) or (isinstance(values.kind, T.DecimalType) and values.kind.scale == 0):
        return how(values.column.cast("decimal(38,0)")).cast("decimal(38,0)")
    if isinstance(values.kind, T.VariantType):
        key = values.value()
        number = F.when(key["rank"] == C.NUMBER, F.struct(key["num"].alias("num"), key["exact"].alias("exact")))
        if distinct:
            every = F.collect_set(number)
            total = F.aggregate(every, F.lit(0.0), lambda a, x: a + x["num"])
            whole = F.aggregate(every, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x["exact"]).cast("decimal(38,0)"))
            n, fractions = F.size(every), F.size(F.filter(every, lambda x: x["exact"].isNull()))
        else:
            total, whole = F.sum(number["num"]), F.sum(number["exact"]).cast("decimal(38,0)")
            n, fractions = F.count(number), F.count(F.when(number.isNotNull() & number["exact"].isNull(), 1))
        fits = (fractions == 0) & whole.between(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)"))
        text = F.when(n == 0, None).when(fits, whole.cast("string")).otherwise(total.cast("string"))
        return F.coalesce(F.parse_json(text), F.parse_json(F.lit("null")))
    if isinstance(values.kind, T.NumericType):
        return how(values.column)
    return F.max(F.lit(None).cast("double"))


def aggregate(call: AggregateCall, values: KeyColumn) -> Column:
    number = isinstance(values.kind, T.NumericType)
    if call.function == Aggregate.SUM:
        return _sum(values, call.distinct)
    if call.function in (Aggregate.COUNT, Aggregate.COUNTN):
        known = values.known()
        if call.function == Aggregate.COUNTN:
            known = C.kind_of(values.column) == C.NUMBER if isinstance(values.kind, T.VariantType) else F.lit(number) & known
        return F.count_distinct(F.when(known, values.value())) if call.distinct else F.count(F.when(known, 1))
    pick, plain = (F.min_by, F.min) if call.function == Aggregate.MIN else (F.max_by, F.max)
    if isinstance(values.kind, T.VariantType):
        # Other keys are null, and min_by and max_by skip those.
        return pick(values.column, F.when(values.known(), values.value()))
    return plain(values.column)


def _counted(calls: Sequence[tuple[AggregateCall, KeyColumn]]) -> KeyColumn | None:
    """The column that all distinct aggregates take, if it is one and all columns are typed."""
    found = {v.name: v for c, v in calls if c.distinct and c.function not in (Aggregate.MIN, Aggregate.MAX)}
    return next(iter(found.values())) if len(found) == 1 and not any(v.dynamic for _, v in calls) else None


def _in_two_steps(rows: DataFrame, by: Sequence[Column], calls: Sequence[tuple[AggregateCall, KeyColumn]], shown: Sequence[Column], over: KeyColumn) -> DataFrame:
    """Aggregates by groups and the values of ``over``, and of these by groups. by, shown: columns of names, what is shown is any one."""
    value, n = KeyColumn("_value", over.kind), F.col("_n")

    def told(c: AggregateCall, v: KeyColumn) -> Column | None:
        """By values and counts; None: it needs a part from the first step."""
        if v.name != over.name:
            return None
        if c.distinct or c.function in (Aggregate.MIN, Aggregate.MAX):
            return aggregate(dataclasses.replace(c, distinct=False), value)
        if c.function == Aggregate.SUM:
            return F.sum(value.column.cast("decimal(19,0)") * n.cast("decimal(19,0)")).cast("decimal(38,0)") if isinstance(v.kind, INTEGRAL) else None
        known = value.known() & F.lit(c.function == Aggregate.COUNT or isinstance(v.kind, T.NumericType))
        return F.coalesce(F.sum(F.when(known, n)), F.lit(0).cast("long"))

    def merged(c: AggregateCall, v: KeyColumn) -> Column:
        name = f"_part_{c.name}"
        if c.function in (Aggregate.MIN, Aggregate.MAX) or (c.function == Aggregate.SUM and not isinstance(v.kind, T.NumericType)):
            return (F.min if c.function == Aggregate.MIN else F.max)(name)
        total = F.sum(name).cast(first.schema[name].dataType)
        return total if c.function == Aggregate.SUM else F.coalesce(total, F.lit(0).cast("long"))

    parts = [aggregate(c, v).alias(f"_part_{c.name}") for c, v in calls if told(c, v) is None]
    rows = rows.withColumn("_value", over.value())
    first = rows.groupBy(*by, "_value").agg(F.count("*").alias("_n"), *parts, *shown)
    again = [F.any_value(x).alias(x) for x in first.columns[len(first.columns) - len(shown) :]]
    made = [told(c, v) for c, v in calls]
    return first.groupBy(*first.columns[: len(by)]).agg(*((merged(c, v) if m is None else m).alias(c.name) for m, (c, v) in zip(made, calls, strict=True)), *again)


def group(rows: DataFrame, keys: Sequence[KeyColumn], request: GroupAggregate, doc_id: str) -> DataFrame:
    """The group columns and aggregates by name."""
    positions = [g.position for g in request.groups]
    if not request.allow_partial and positions and sorted(p for p in positions if p is not None) != list(range(len(positions))):
        raise GroupError("groups are no leading run of keys")
    if request.one_per_document:
        rows = rows.withColumn("_lead", keys[0].value()).dropDuplicates(["_lead", doc_id])
    for x in (*request.groups, *request.aggregates):
        if x.expr is not None:
            rows = rows.withColumn(f"_expr_{x.name}", F.expr(x.expr))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    sources = [(c, _source(c, keys, kinds)) for c in request.aggregates]
    over = _counted(sources)
    calls = [aggregate(c, v).alias(c.name) for c, v in sources]
    groups = [(g.name, _source(g, keys, kinds)) for g in request.groups]
    if not groups:
        return rows.agg(*calls) if over is None else _in_two_steps(rows, [], sources, [], over)
    by = [k.value().alias(f"_group_{name}") for name, k in groups]
    shown = [
        F.col(f"_group_{name}").alias(name) if not isinstance(k.kind, T.VariantType) else F.col(f"_shown_{name}").alias(name) for name, k in groups
    ]
    values = [F.any_value(k.column).alias(f"_shown_{name}") for name, k in groups if isinstance(k.kind, T.VariantType)]
    if over is not None:
        found = _in_two_steps(rows, by, sources, values, over)
    else:
        found = rows.groupBy(*by).agg(*calls, *values) if calls or values else rows.select(*by).distinct()
    return found.select(*shown, *[F.col(c.name) for c in request.aggregates])
