"""The registered queries of the engine and their SQL, by the operator that they show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import collation as C
from ..operators import index as ix
from ..operators import partitioning, scan, vector
from ..operators.index import Index
from ..sources.changes import field, json_documents
from ..streaming import maintenance
from .catalog import Catalog, covering, simple
from .request import (
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
    VectorQuery,
    equal,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NEITHER, LOW, HIGH, BOTH = Inclusion.NEITHER, Inclusion.LOW, Inclusion.HIGH, Inclusion.BOTH


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str, *keys: str, **options: object) -> Index:
    return ix.build(table(spark, sf_dir, "orders"), simple("orders", *keys, doc_id="o_orderkey", **options))


def lineitem(spark: SparkSession, sf_dir: str, *keys: str) -> Index:
    source = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return ix.build(source, simple("lineitem", *keys))


def call(name: str, function: Aggregate, position: int | None = None, **more: object) -> AggregateCall:
    return AggregateCall(name, function, position, **more)


def grouped(*groups: int | GroupKey, calls: tuple[AggregateCall, ...], **more: object) -> GroupAggregate:
    keys = tuple(g if isinstance(g, GroupKey) else GroupKey(f"g{g}", g) for g in groups)
    return GroupAggregate(keys, calls, **more)


def cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("long")


# -- scans ------------------------------------------------------------------


@query("scn1_primary_scan", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000")
def scn1(spark, sf_dir):
    index = ix.build(table(spark, sf_dir, "orders"), IndexDefinition("p", doc_id="o_orderkey", primary=True))
    return scan.range_scan(index, Range(100, 5000, LOW))


@query("scn2_full_scan", "SELECT c_mktsegment, c_nationkey, c_custkey FROM customer")
def scn2(spark, sf_dir):
    return scan.scan_all(ix.build(table(spark, sf_dir, "customer"), simple("c", "c_mktsegment", "c_nationkey", doc_id="c_custkey")))


@query("scn3_lookup", "SELECT p_brand, p_size, p_partkey FROM part WHERE p_brand = 'Brand#7'")
def scn3(spark, sf_dir):
    return scan.lookup(ix.build(table(spark, sf_dir, "part"), simple("p", "p_brand", "p_size", doc_id="p_partkey")), "Brand#7")


@query(
    "scn4_range_scan",
    "SELECT o_orderpriority, o_custkey, o_orderkey FROM orders WHERE o_orderpriority > '1-URGENT' AND o_orderpriority <= '3-MEDIUM' AND o_custkey >= 10 AND o_custkey < 400",
)
def scn4(spark, sf_dir):
    return scan.range_scan(orders(spark, sf_dir, "o_orderpriority", "o_custkey"), Range("1-URGENT", "3-MEDIUM", HIGH), Range(10, 400, LOW))


@query(
    "scn5_multi_span_scan",
    """SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders
    WHERE (o_orderstatus = 'F' AND o_orderpriority >= '2-HIGH') OR (o_orderstatus > 'F' AND o_orderstatus < 'P' AND o_orderpriority = '1-URGENT')""",
)
def scn5(spark, sf_dir):
    spans = Span((equal("F"), Range(low="2-HIGH"))), Span((Range("F", "P", NEITHER), equal("1-URGENT")))
    return scan.multi_scan(orders(spark, sf_dir, "o_orderstatus", "o_orderpriority"), *spans)


FLAGSHIP_SQL = """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(l_quantity) AS count_qty,
    min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, count(DISTINCT l_quantity) AS distinct_qty FROM lineitem
    WHERE (l_returnflag = 'A' AND l_quantity >= 5) OR (l_returnflag >= 'N' AND l_returnflag < 'S' AND l_quantity < 45)
    GROUP BY l_returnflag, l_linestatus"""


@query("scn6_full_scan_api", FLAGSHIP_SQL)
def scn6(spark, sf_dir):
    spans = Span((equal("A"), None, Range(low=5))), Span((Range("N", "S", LOW), None, Range(high=45, inclusion=LOW)))
    calls = (
        call("sum_qty", Aggregate.SUM, 2),
        call("count_qty", Aggregate.COUNT, 2),
        call("min_qty", Aggregate.MIN, 2),
        call("max_qty", Aggregate.MAX, 2),
        call("distinct_qty", Aggregate.COUNT, 2, distinct=True),
    )
    group = GroupAggregate((GroupKey("l_returnflag", 0), GroupKey("l_linestatus", 1)), calls)
    return scan.scan(lineitem(spark, sf_dir, "l_returnflag", "l_linestatus", "l_quantity"), ScanRequest(spans=spans, group=group))


FLAGSHIP = scn6


@query(
    "scn7_vector_scan_api",
    """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, label, round(list_inner_product(list_transform(list_zip(embedding, e), lambda p: p[1]::DOUBLE - p[2]::DOUBLE),
      list_transform(list_zip(embedding, e), lambda p: p[1]::DOUBLE - p[2]::DOUBLE)), 6) AS distance
    FROM embeddings, q WHERE label < 5 ORDER BY distance, vec_id LIMIT 10""",
)
def scn7(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = vector.knn(rows, "vec_id", "embedding", first_vector(rows), vector.Metric.L2, 10, where="label < 5")
    return found.select("vec_id", "label", F.round("distance", 6).alias("distance"))


def first_vector(rows: DataFrame) -> list[float]:
    return list(rows.where("vec_id = 0").first()["embedding"])


@query("scn8_compatible_scan", "SELECT o_orderstatus, o_orderkey FROM orders WHERE o_orderstatus >= 'O' ORDER BY o_orderstatus, o_orderkey LIMIT 25")
def scn8(spark, sf_dir):
    return scan.scan(orders(spark, sf_dir, "o_orderstatus"), ScanRequest(spans=(Span((Range(low="O"),)),), limit=25, sorted=True))


@query(
    "scn9_catalog_api",
    "SELECT p_type, p_partkey FROM part WHERE p_type = 'ECONOMY'",
)
def scn9(spark, sf_dir):
    catalog = Catalog()
    catalog.create(simple("by_type", "p_type", doc_id="p_partkey"), table(spark, sf_dir, "part"))
    return scan.lookup(catalog.index("by_type"), "ECONOMY")


@query("src2_sample", "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY md5('1:' || o_orderkey), o_orderkey::VARCHAR LIMIT 100")
def src2(spark, sf_dir):
    return scan.sample(orders(spark, sf_dir, "o_orderstatus"), 100)


# -- projections ------------------------------------------------------------


@query("prj1_project_keys", "SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def prj1(spark, sf_dir):
    index = orders(spark, sf_dir, "o_orderstatus", "o_custkey", "o_orderpriority")
    return scan.scan(index, ScanRequest(spans=(Span.seek("P"),), projection=(2, 0)))


@query("prj2_without_doc_id", "SELECT o_orderstatus FROM orders WHERE o_orderstatus >= 'O'")
def prj2(spark, sf_dir):
    return scan.scan(orders(spark, sf_dir, "o_orderstatus"), ScanRequest(spans=(Span((Range(low="O"),)),), project_doc_id=False))


@query("prj3_doc_id_only", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def prj3(spark, sf_dir):
    return scan.scan(orders(spark, sf_dir, "o_orderstatus"), ScanRequest(spans=(Span.seek("F"),), projection=()))


@query("prj5_include_columns", "SELECT label, vec_id % 7 AS bucket, vec_id FROM embeddings WHERE label = 3")
def prj5(spark, sf_dir):
    keys = (IndexKey("label", "label"), IndexKey("embedding", "embedding", vector=True))
    defn = IndexDefinition("v", keys, doc_id="vec_id", include=(("bucket", "vec_id % 7"),))
    index = ix.build(table(spark, sf_dir, "embeddings"), defn)
    return scan.scan(index, ScanRequest(spans=(Span.seek(3),), projection=(0, 2)))


@query("prj7_group_projection", "SELECT count(*) AS n, o_orderstatus FROM orders GROUP BY o_orderstatus")
def prj7(spark, sf_dir):
    group = GroupAggregate((GroupKey("o_orderstatus", 0),), (call("n", Aggregate.COUNT, 0),))
    return scan.scan(orders(spark, sf_dir, "o_orderstatus"), ScanRequest(group=group, group_projection=("n", "o_orderstatus")))


@query("prj9_order_columns_dropped", "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 30")
def prj9(spark, sf_dir):
    index = orders(spark, sf_dir, "o_orderpriority", "o_custkey")
    return scan.scan(index, ScanRequest(projection=(0,), order=(OrderKey(1, True),), limit=30))


# -- filters ----------------------------------------------------------------


@query(
    "flt2_inclusions",
    """SELECT 0 AS inclusion, count(*) AS n FROM part WHERE p_size > 10 AND p_size < 20 UNION ALL
    SELECT 1, count(*) FROM part WHERE p_size >= 10 AND p_size < 20 UNION ALL
    SELECT 2, count(*) FROM part WHERE p_size > 10 AND p_size <= 20 UNION ALL
    SELECT 3, count(*) FROM part WHERE p_size >= 10 AND p_size <= 20""",
)
def flt2(spark, sf_dir):
    index = ix.build(table(spark, sf_dir, "part"), simple("p", "p_size", doc_id="p_partkey"))
    found = [scan.count_range(index, Range(10, 20, i)).select(F.lit(int(i)).alias("inclusion"), "n") for i in Inclusion]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("flt3_unbounded", "SELECT p_size, p_brand, p_partkey FROM part WHERE p_size <= 8 AND p_brand > 'Brand#20'")
def flt3(spark, sf_dir):
    index = ix.build(table(spark, sf_dir, "part"), simple("p", "p_size", "p_brand", doc_id="p_partkey"))
    return scan.range_scan(index, Range(high=8), Range(low="Brand#20", inclusion=NEITHER))


@query(
    "flt6_overlapping_spans",
    "SELECT c_custkey, c_nationkey FROM customer WHERE (c_nationkey >= 2 AND c_nationkey < 9) OR (c_nationkey > 4 AND c_nationkey <= 15) OR (c_nationkey > 12 AND c_nationkey < 20)",
)
def flt6(spark, sf_dir):
    index = ix.build(table(spark, sf_dir, "customer"), simple("c", "c_nationkey", doc_id="c_custkey"))
    return scan.multi_scan(index, Span((Range(2, 9, LOW),)), Span((Range(4, 15, HIGH),)), Span((Range(12, 20, NEITHER),)))


@query("flt8_low_above_high", "SELECT o_orderstatus, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def flt8(spark, sf_dir):
    return scan.multi_scan(orders(spark, sf_dir, "o_orderstatus"), Span((Range("O", "F"),)), Span.seek("P"))


@query("flt9_all_unbounded", "SELECT c_nationkey, c_custkey FROM customer")
def flt9(spark, sf_dir):
    index = ix.build(table(spark, sf_dir, "customer"), simple("c", "c_nationkey", doc_id="c_custkey"))
    return scan.multi_scan(index, Span((Range(1, 2),)), Span((None,)))


@query("flt10_descending_key", "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders WHERE o_custkey > 50 AND o_custkey <= 90 ORDER BY o_custkey DESC, o_orderstatus, o_orderkey LIMIT 40")
def flt10(spark, sf_dir):
    index = orders(spark, sf_dir, "-o_custkey", "o_orderstatus")
    return scan.scan(index, ScanRequest(spans=(Span((Range(50, 90, HIGH),)),), sorted=True, limit=40))


@query("flt11_partial_index", "SELECT user_id, event_id FROM events WHERE event_type = 'click' AND user_id < 40")
def flt11(spark, sf_dir):
    index = ix.build(table(spark, sf_dir, "events"), simple("e", "user_id", doc_id="event_id", where="event_type = 'click'"))
    return scan.range_scan(index, Range(high=40, inclusion=LOW))


@query("flt12_inline_filter", "SELECT user_id, event_id FROM events WHERE user_id >= 10 AND (value > 20 AND event_type <> 'view')")
def flt12(spark, sf_dir):
    defn = IndexDefinition("e", (IndexKey("user_id", "user_id"),), doc_id="event_id", include=(("value", "value"), ("event_type", "event_type")))
    index = ix.build(table(spark, sf_dir, "events"), defn)
    return scan.scan(index, ScanRequest(spans=(Span((Range(low=10),)),), inline_filter="value > 20 AND event_type <> 'view'", projection=(0,)))


@query("flt15_exists", "SELECT (SELECT count(*) > 0 FROM orders WHERE o_custkey = 7) AS seven, (SELECT count(*) > 0 FROM orders WHERE o_custkey = -1) AS none")
def flt15(spark, sf_dir):
    index = orders(spark, sf_dir, "o_custkey")
    return spark.createDataFrame([(scan.exists(index, 7), scan.exists(index, -1))], "seven boolean, none boolean")


# -- aggregates -------------------------------------------------------------


@query(
    "agg1_aggregates",
    """SELECT l_returnflag AS g0, sum(l_partkey)::BIGINT AS total, sum(DISTINCT l_partkey)::BIGINT AS total_distinct, count(l_partkey) AS n,
    count(DISTINCT l_partkey) AS n_distinct, count(l_partkey) AS numbers, count(DISTINCT l_partkey) AS numbers_distinct,
    min(l_partkey) AS least, max(l_partkey) AS most FROM lineitem GROUP BY l_returnflag""",
)
def agg1(spark, sf_dir):
    calls = (
        call("total", Aggregate.SUM, 1),
        call("total_distinct", Aggregate.SUM, 1, distinct=True),
        call("n", Aggregate.COUNT, 1),
        call("n_distinct", Aggregate.COUNT, 1, distinct=True),
        call("numbers", Aggregate.COUNTN, 1),
        call("numbers_distinct", Aggregate.COUNTN, 1, distinct=True),
        call("least", Aggregate.MIN, 1),
        call("most", Aggregate.MAX, 1),
    )
    found = scan.scan(lineitem(spark, sf_dir, "l_returnflag", "l_partkey"), ScanRequest(group=grouped(0, calls=calls)))
    return found.withColumns({c: F.col(c).cast("long") for c in ("total", "total_distinct")})


@query("agg5_countn_of_strings", "SELECT 0::BIGINT AS numbers, count(o_orderstatus) AS n, NULL::DOUBLE AS total FROM orders")
def agg5(spark, sf_dir):
    calls = (call("numbers", Aggregate.COUNTN, 0), call("n", Aggregate.COUNT, 0), call("total", Aggregate.SUM, 0))
    return scan.scan(orders(spark, sf_dir, "o_orderstatus"), ScanRequest(group=grouped(calls=calls)))


@query(
    "agg10_expressions",
    "SELECT (l_linenumber * 2 + 15) AS twice, l_returnflag || '-' || l_linestatus AS both, count(*) AS n, sum(l_linenumber + 10)::BIGINT AS total FROM lineitem GROUP BY 1, 2",
)
def agg10(spark, sf_dir):
    index = lineitem(spark, sf_dir, "l_returnflag", "l_linestatus", "l_linenumber")
    groups = GroupKey("twice", expr="l_linenumber * 2 + (10 + 5)"), GroupKey("both", expr="l_returnflag || '-' || l_linestatus")
    calls = call("n", Aggregate.COUNT, 0), call("total", Aggregate.SUM, expr="l_linenumber + 10")
    found = scan.scan(index, ScanRequest(group=GroupAggregate(groups, calls)))
    return found.withColumn("total", F.col("total").cast("long"))


@query("agg11_no_rows", "SELECT 0::BIGINT AS n, NULL::BIGINT AS total, NULL::BIGINT AS least")
def agg11(spark, sf_dir):
    calls = call("n", Aggregate.COUNT, 0), call("total", Aggregate.SUM, 0), call("least", Aggregate.MIN, 0)
    found = scan.scan(orders(spark, sf_dir, "o_custkey"), ScanRequest(spans=(Span.seek(-5),), group=grouped(calls=calls)))
    return found.withColumn("total", F.col("total").cast("long"))


@query("agg12_no_groups", "SELECT o_custkey AS g0, count(*) AS n FROM orders WHERE o_custkey = -5 GROUP BY 1")
def agg12(spark, sf_dir):
    return scan.scan(orders(spark, sf_dir, "o_custkey"), ScanRequest(spans=(Span.seek(-5),), group=grouped(0, calls=(call("n", Aggregate.COUNT, 0),))))


@query("agg14_trailing_group", "SELECT o_orderpriority AS g1, count(*) AS n, max(o_custkey) AS most FROM orders GROUP BY 1")
def agg14(spark, sf_dir):
    calls = call("n", Aggregate.COUNT, 0), call("most", Aggregate.MAX, 0)
    return scan.scan(orders(spark, sf_dir, "o_custkey", "o_orderpriority"), ScanRequest(group=grouped(1, calls=calls)))


@query("agg18_first_valid", "SELECT min(o_custkey) AS least FROM orders WHERE o_custkey > 3")
def agg18(spark, sf_dir):
    return scan.scan(orders(spark, sf_dir, "o_custkey"), ScanRequest(spans=(Span((Range(low=3, inclusion=NEITHER),)),), group=grouped(calls=(call("least", Aggregate.MIN, 0),))))


@query("agg20_primary_group", "SELECT o_orderkey % 10 AS last, count(*) AS n FROM orders GROUP BY 1")
def agg20(spark, sf_dir):
    index = ix.build(table(spark, sf_dir, "orders"), IndexDefinition("p", doc_id="o_orderkey", primary=True))
    return scan.scan(index, ScanRequest(group=GroupAggregate((GroupKey("last", expr="o_orderkey % 10"),), (call("n", Aggregate.COUNT, 0),))))


@query("agg22_grouped_limit", "SELECT o_custkey AS g0, count(*) AS n FROM orders WHERE o_custkey > 20 GROUP BY 1 ORDER BY 1 LIMIT 7 OFFSET 4")
def agg22(spark, sf_dir):
    group = grouped(0, calls=(call("n", Aggregate.COUNT, 0),))
    return scan.scan(orders(spark, sf_dir, "o_custkey"), ScanRequest(spans=(Span((Range(low=20, inclusion=NEITHER),)),), group=group, offset=4, limit=7))


# -- counts -----------------------------------------------------------------


@query("cnt1_count_total", "SELECT count(*) AS n FROM orders")
def cnt1(spark, sf_dir):
    return scan.count(orders(spark, sf_dir, "o_orderstatus"))


@query("cnt2_count_range", "SELECT count(*) AS n FROM orders WHERE o_custkey >= 5 AND o_custkey <= 500")
def cnt2(spark, sf_dir):
    return scan.count_range(orders(spark, sf_dir, "o_custkey"), Range(5, 500))


@query("cnt3_count_lookup", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (1, 2, 3, 50)")
def cnt3(spark, sf_dir):
    return scan.count_lookup(orders(spark, sf_dir, "o_custkey"), [(1,), (2,), (3,), (50,)])


@query("cnt4_multi_count", "SELECT count(*) AS n FROM orders WHERE o_custkey < 30 OR (o_custkey >= 20 AND o_custkey < 60)")
def cnt4(spark, sf_dir):
    return scan.count(orders(spark, sf_dir, "o_custkey"), [Span((Range(high=30, inclusion=LOW),)), Span((Range(20, 60, LOW),))])


@query("cnt5_count_distinct", "SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_custkey > 9")
def cnt5(spark, sf_dir):
    return scan.count_distinct(orders(spark, sf_dir, "o_custkey", "o_orderstatus"), [Span((Range(low=9, inclusion=NEITHER),))])


@query("cnt6_count_primary", "SELECT count(*) AS n FROM orders WHERE o_orderkey BETWEEN 10 AND 99")
def cnt6(spark, sf_dir):
    return scan.count_range(ix.build(table(spark, sf_dir, "orders"), IndexDefinition("p", doc_id="o_orderkey", primary=True)), Range(10, 99))


@query("cnt7_statistics", "SELECT count(*) AS n, min(o_orderpriority) AS least, max(o_orderpriority) AS most FROM orders WHERE o_orderpriority >= '2'")
def cnt7(spark, sf_dir):
    return scan.statistics(orders(spark, sf_dir, "o_orderpriority"), Span((Range(low="2"),))).select("n", "least", "most")


@query("cnt8_partition_statistics")
def cnt8(spark, sf_dir):
    return scan.partition_statistics(orders(spark, sf_dir, "o_custkey", partition_by=("o_custkey",)))


@query("cnt9_histogram")
def cnt9(spark, sf_dir):
    return scan.lead_key_histogram(orders(spark, sf_dir, "o_custkey"), 10)


@query(
    "cnt11_window_statistics",
    """SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(stddev_pop(value) OVER w, 5) AS deviation, max(value) OVER w AS most FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def cnt11(spark, sf_dir):
    last = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(F.avg("value").over(last), 6).alias("mean"),
        F.round(F.stddev_pop("value").over(last), 5).alias("deviation"),
        F.max("value").over(last).alias("most"),
    )


# -- distinct, order, limit -------------------------------------------------


@query("dst1_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_custkey < 900")
def dst1(spark, sf_dir):
    index = orders(spark, sf_dir, "o_custkey", "o_orderstatus", "o_orderpriority")
    return scan.scan(index, ScanRequest(spans=(Span((Range(high=900, inclusion=LOW),)),), projection=(1, 2), distinct=True))


@query("ord1_index_order", "SELECT o_orderstatus, o_custkey, o_orderkey FROM orders ORDER BY o_orderstatus, o_custkey DESC, o_orderkey LIMIT 50")
def ord1(spark, sf_dir):
    return scan.scan(orders(spark, sf_dir, "o_orderstatus", "-o_custkey"), ScanRequest(sorted=True, limit=50))


@query("ord2_order_pushdown", "SELECT o_orderstatus, o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderstatus DESC, o_orderkey LIMIT 50")
def ord2(spark, sf_dir):
    return scan.scan(orders(spark, sf_dir, "o_orderstatus", "o_custkey"), ScanRequest(order=(OrderKey(1), OrderKey(0, True)), limit=50))


@query("ord4_reverse", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 20")
def ord4(spark, sf_dir):
    return scan.scan(orders(spark, sf_dir, "o_custkey"), ScanRequest(reverse=True, limit=20))


@query("lim1_offset_limit", "SELECT o_orderstatus, o_orderkey FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus >= 'O' AND o_orderstatus < 'P') ORDER BY o_orderstatus, o_orderpriority, o_orderkey LIMIT 10 OFFSET 2")
def lim1(spark, sf_dir):
    request = ScanRequest(spans=(Span.seek("F"), Span((Range("O", "P", LOW),))), projection=(0,), sorted=True, offset=2, limit=10)
    return scan.scan(orders(spark, sf_dir, "o_orderstatus", "o_orderpriority"), request).select("o_orderstatus", "o_orderkey")


@query("lim3_limit_zero", "SELECT p_size, p_partkey FROM part WHERE p_size = 4")
def lim3(spark, sf_dir):
    index = ix.build(table(spark, sf_dir, "part"), simple("p", "p_size", doc_id="p_partkey"))
    return scan.scan(index, ScanRequest(spans=(Span.seek(4),), limit=0))


@query("top1_top_k", "SELECT l_extendedprice, doc_id FROM (SELECT l_extendedprice, l_orderkey * 8 + l_linenumber AS doc_id FROM lineitem) ORDER BY 1 DESC, 2 LIMIT 15")
def top1(spark, sf_dir):
    return scan.scan(lineitem(spark, sf_dir, "-l_extendedprice"), ScanRequest(sorted=True, limit=15))


# -- partitions -------------------------------------------------------------


def partitioned(spark, sf_dir) -> Index:
    return orders(spark, sf_dir, "o_custkey", "o_orderstatus", partition_by=("o_custkey",), num_partition=8)


@query("par1_partition_ids")
def par1(spark, sf_dir):
    return partitioned(spark, sf_dir).rows.groupBy(partitioning.PART).agg(F.count("*").alias("n"))


@query("par2_elimination", "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders WHERE o_custkey IN (3, 8)")
def par2(spark, sf_dir):
    return scan.multi_scan(partitioned(spark, sf_dir), Span.seek(3), Span.seek(8))


@query("par3_partition_sets", "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders WHERE o_custkey IN (1, 2, 5)")
def par3(spark, sf_dir):
    index = partitioned(spark, sf_dir)
    ids = partitioning.eliminate_sets(spark, [[1, 2, 5]], [index.keys[0].kind], 8)
    spans = tuple(Span.seek(v) for v in (1, 2, 5))
    return scan.scan(index, ScanRequest(spans=spans, partition_ids=tuple(sorted(ids))))


@query("par7_sorted_gather", "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders ORDER BY o_custkey, o_orderstatus, o_orderkey LIMIT 20 OFFSET 15")
def par7(spark, sf_dir):
    return scan.scan(partitioned(spark, sf_dir), ScanRequest(sorted=True, offset=15, limit=20))


# -- arrays -----------------------------------------------------------------


def document_words(spark, sf_dir, *more: str) -> DataFrame:
    """The words of whole texts, cut at blanks and line ends."""
    return table(spark, sf_dir, "documents").select("doc_id", *more, F.split(F.translate("text", "\n", " "), " ").alias("words"))


def words(spark, sf_dir, mode: ArrayMode, leading: bool = True) -> Index:
    source = document_words(spark, sf_dir, "lang")
    keys = [IndexKey("words", "word", array=mode), IndexKey("lang", "lang")]
    return ix.build(source, IndexDefinition("w", tuple(keys if leading else keys[::-1])))


DOCUMENT_WORDS = "SELECT doc_id, lang, string_split(replace(text, chr(10), ' '), ' ') AS words FROM documents"


@query("arr1_array_index", f"WITH d AS ({DOCUMENT_WORDS}) SELECT word, lang, doc_id FROM (SELECT unnest(words) AS word, lang, doc_id FROM d) WHERE word >= 'the' AND word < 'tho'")
def arr1(spark, sf_dir):
    return scan.range_scan(words(spark, sf_dir, ArrayMode.ALL), Range("the", "tho", LOW))


@query("arr2_distinct_array_index", f"WITH d AS ({DOCUMENT_WORDS}) SELECT DISTINCT word, lang, doc_id FROM (SELECT unnest(words) AS word, lang, doc_id FROM d) WHERE word >= 'the' AND word < 'tho'")
def arr2(spark, sf_dir):
    return scan.range_scan(words(spark, sf_dir, ArrayMode.DISTINCT), Range("the", "tho", LOW))


@query("arr3_array_counts", f"WITH d AS ({DOCUMENT_WORDS}) SELECT word AS g0, count(*) AS n FROM (SELECT unnest(words) AS word FROM d) WHERE word LIKE 'an%' GROUP BY 1")
def arr3(spark, sf_dir):
    group = grouped(0, calls=(call("n", Aggregate.COUNT, 0),))
    return scan.scan(words(spark, sf_dir, ArrayMode.ALL), ScanRequest(spans=(Span((Range("an", "ao", LOW),)),), group=group))


@query("agg17_one_per_document", f"WITH d AS ({DOCUMENT_WORDS}) SELECT count(DISTINCT doc_id) AS n FROM (SELECT unnest(words) AS word, doc_id FROM d) WHERE word = 'the'")
def agg17(spark, sf_dir):
    group = GroupAggregate((), (call("n", Aggregate.COUNT, 0),), one_per_document=True)
    return scan.scan(words(spark, sf_dir, ArrayMode.ALL), ScanRequest(spans=(Span.seek("the"),), group=group))


@query(
    "arr4_flatten",
    "SELECT part, supp, o_orderkey FROM (SELECT l_orderkey AS o_orderkey, l_partkey AS part, l_suppkey AS supp FROM lineitem) WHERE part < 200",
)
def arr4(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    source = items.agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))).alias("items"))
    key = IndexKey("items", "item", array=ArrayMode.ALL, flatten=("part", "supp"))
    found = scan.range_scan(ix.build(source, IndexDefinition("f", (key,), doc_id="o_orderkey")), Range(high=200, inclusion=LOW))
    return found.select(F.col("item_part").alias("part"), F.col("item_supp").alias("supp"), "o_orderkey")


@query(
    "arr5_array_delta",
    """WITH d AS (SELECT o_orderkey, [o_orderstatus, o_orderpriority] AS old, ['F', o_orderpriority] AS new FROM orders)
    SELECT o_orderkey, len(list_filter(old, lambda x: NOT list_contains(new, x))) AS gone, len(list_filter(new, lambda x: NOT list_contains(old, x))) AS come FROM d""",
)
def arr5(spark, sf_dir):
    gone, come = ix.array_delta(F.array("o_orderstatus", "o_orderpriority"), F.array(F.lit("F"), "o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(gone).cast("long").alias("gone"), F.size(come).cast("long").alias("come"))


# -- documents --------------------------------------------------------------


def event_documents(spark, sf_dir) -> DataFrame:
    return json_documents(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("doc")))


@query("exp4_field_path", "SELECT (props::JSON ->> '$.k')::BIGINT AS k, event_id AS doc_id FROM events WHERE (props::JSON ->> '$.k')::BIGINT >= 90")
def exp4(spark, sf_dir):
    defn = IndexDefinition("k", (IndexKey(field("k"), "k"),))
    found = scan.range_scan(ix.build(event_documents(spark, sf_dir), defn), Range(low=90))
    return found.select(F.variant_get("k", "$", "long").alias("k"), "doc_id")


@query("agg9_group_variant", "SELECT (props::JSON ->> '$.k')::BIGINT AS k, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def agg9(spark, sf_dir):
    source = table(spark, sf_dir, "events").select("event_id", "user_id", F.try_parse_json("props").alias("doc"))
    index = ix.build(source, IndexDefinition("k", (IndexKey(field("k"), "k"), IndexKey("user_id", "user_id")), doc_id="event_id"))
    group = GroupAggregate((GroupKey("k", 0),), (call("n", Aggregate.COUNT, 0), call("users", Aggregate.SUM, 1)))
    found = scan.scan(index, ScanRequest(group=group))
    return found.select(F.variant_get("k", "$", "long").alias("k"), "n", F.col("users").cast("long").alias("users"))


@query("exp1_expressions", "SELECT substr(o_orderpriority, 1, 4) AS head, o_orderstatus || o_orderpriority AS both, o_custkey * 2 + 1 AS odd, o_orderkey FROM orders")
def exp1(spark, sf_dir):
    keys = IndexKey("substring(o_orderpriority, 0 + 1, 4)", "head"), IndexKey("o_orderstatus || o_orderpriority", "both"), IndexKey("o_custkey * 2 + 1", "odd")
    return scan.scan_all(ix.build(table(spark, sf_dir, "orders"), IndexDefinition("x", keys, doc_id="o_orderkey")))


@query("exp5_comprehension", f"WITH d AS ({DOCUMENT_WORDS}) SELECT unnest(list_transform(list_filter(words, lambda w: len(w) > 9), lambda w: lower(w))) AS word, doc_id FROM d")
def exp5(spark, sf_dir):
    source = document_words(spark, sf_dir)
    key = IndexKey("transform(filter(words, w -> length(w) > 9), w -> lower(w))", "word", array=ArrayMode.ALL)
    return scan.scan_all(ix.build(source, IndexDefinition("c", (key,))))


@query("exp12_any_satisfies", f"WITH d AS ({DOCUMENT_WORDS}) SELECT doc_id FROM d WHERE len(list_filter(words, lambda w: w = 'of')) > 0")
def exp12(spark, sf_dir):
    source = document_words(spark, sf_dir)
    return source.where(F.exists("words", lambda w: w == "of")).select("doc_id")


@query("exp11_base64_vectors", "SELECT vec_id, 0.0::DOUBLE AS moved FROM embeddings")
def exp11(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    back = rows.select("vec_id", "embedding", vector.decode_vector(vector.encode_vector(F.col("embedding"), True), True).alias("back"))
    moved = F.aggregate(F.zip_with("embedding", "back", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return back.select("vec_id", moved.alias("moved"))


# -- vectors ----------------------------------------------------------------

DOTS = """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), d AS (
    SELECT vec_id, label, list_inner_product(embedding::DOUBLE[], e) AS xy, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS xx,
    list_inner_product(e, e) AS yy FROM embeddings, q) """


def nearest(spark, sf_dir, metric: vector.Metric, k: int | None, **more: object) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = vector.knn(rows, "vec_id", "embedding", first_vector(rows), metric, k, **more)
    return found.select("vec_id", F.round("distance", 5).alias("distance"))


@query("vec1_cosine", DOTS + "SELECT vec_id, round(greatest(0, least(2, 1 - xy / (sqrt(xx) * sqrt(yy)))), 5) AS distance FROM d ORDER BY 1 - xy / (sqrt(xx) * sqrt(yy)), vec_id LIMIT 20")
def vec1(spark, sf_dir):
    return nearest(spark, sf_dir, vector.Metric.COSINE, 20)


@query("vec1_dot", DOTS + "SELECT vec_id, round(-xy, 5) AS distance FROM d ORDER BY -xy, vec_id LIMIT 20")
def vec1_dot(spark, sf_dir):
    return nearest(spark, sf_dir, vector.Metric.DOT, 20)


@query("vec15_offset", DOTS + "SELECT vec_id, round(-xy, 5) AS distance FROM d WHERE label <> 3 ORDER BY -xy, vec_id LIMIT 10 OFFSET 5")
def vec15(spark, sf_dir):
    return nearest(spark, sf_dir, vector.Metric.DOT, 10, offset=5, where="label <> 3")


@query("vec18_no_limit", DOTS + "SELECT vec_id, round(-xy, 5) AS distance FROM d")
def vec18(spark, sf_dir):
    return nearest(spark, sf_dir, vector.Metric.DOT, None)


@query("vec4_inverted_file")
def vec4(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    index = vector.train_inverted(rows, "vec_id", "embedding", vector.Metric.L2, 16)
    return index.search(first_vector(rows), 10, nprobes=4).select("vec_id", "centroid", F.round("distance", 5).alias("distance"))


@query("vec8_all_probes", DOTS + "SELECT vec_id, round(-xy, 5) AS distance FROM d ORDER BY -xy, vec_id LIMIT 10")
def vec8(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    index = vector.train_inverted(rows, "vec_id", "embedding", vector.Metric.DOT, 8)
    return index.search(first_vector(rows), 10, nprobes=8).select("vec_id", F.round("distance", 5).alias("distance"))


@query("vec16_rerank", DOTS + "SELECT vec_id, round(xx + yy - 2 * xy, 5) AS distance FROM d ORDER BY xx + yy - 2 * xy, vec_id LIMIT 10")
def vec16(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    index = vector.train_inverted(rows, "vec_id", "embedding", vector.Metric.L2, 8)
    sq8 = vector.ScalarQuantizer.train(rows, "embedding", 8)
    return vector.quantised_search(index, sq8, first_vector(rows), 10, nprobes=8).select("vec_id", F.round("distance", 5).alias("distance"))


def embedding_index(spark, sf_dir) -> Index:
    keys = (IndexKey("label", "label"), IndexKey("embedding", "embedding", vector=True))
    return ix.build(table(spark, sf_dir, "embeddings"), IndexDefinition("scored", keys, doc_id="vec_id", include=(("bucket", "vec_id % 7"),)))


def asked(spark, sf_dir) -> VectorQuery:
    return VectorQuery(1, tuple(first_vector(table(spark, sf_dir, "embeddings"))))


@query("vec19_distance_order", DOTS + "SELECT label, round(xx + yy - 2 * xy, 5) AS embedding, vec_id FROM d ORDER BY label, xx + yy - 2 * xy DESC, vec_id LIMIT 30 OFFSET 5")
def vec19(spark, sf_dir):
    order = (OrderKey(0), OrderKey(distance=True, descending=True))
    found = scan.scan(embedding_index(spark, sf_dir), ScanRequest(vector=asked(spark, sf_dir), order=order, offset=5, limit=30, projection=(0, 1)))
    return found.withColumn("embedding", F.round("embedding", 5))


@query("flt13_include_ranges", DOTS + "SELECT round(xx + yy - 2 * xy, 5) AS embedding, vec_id FROM d WHERE vec_id % 7 BETWEEN 2 AND 3 OR vec_id % 7 = 6 ORDER BY xx + yy - 2 * xy, vec_id LIMIT 12")
def flt13(spark, sf_dir):
    spans = (Span((Range(2, 3),)), Span.seek(6))
    found = scan.scan(embedding_index(spark, sf_dir), ScanRequest(vector=asked(spark, sf_dir), include_spans=spans, limit=12, projection=(1,)))
    return found.withColumn("embedding", F.round("embedding", 5))


@query("vec9_product_quantizer")
def vec9(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    pq = vector.ProductQuantizer.train(rows, "embedding", 8, 5)
    coded = rows.withColumn("distance", pq.distance(pq.encode(F.col("embedding")), first_vector(rows), vector.Metric.L2))
    return coded.orderBy("distance", "vec_id").limit(50).select("vec_id", F.round("distance", 5).alias("distance"))


@query(
    "vec2_sparse",
    """SELECT doc_id, -sum(CASE w WHEN 'the' THEN 1.0 WHEN 'of' THEN 2.0 ELSE 0.5 END)::DOUBLE AS distance
    FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w IN ('the', 'of', 'and') GROUP BY doc_id""",
)
def vec2(spark, sf_dir):
    terms = {"the": 1.0, "of": 2.0, "and": 0.5}
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    postings = w.groupBy("doc_id", F.xxhash64("w").alias("term")).agg(F.count("*").cast("double").alias("weight"))
    hashed = spark.createDataFrame([(t, x) for t, x in terms.items()], "w string, x double").select(F.xxhash64("w").alias("t"), "x").collect()
    return vector.sparse_knn(postings, "doc_id", {r["t"]: r["x"] for r in hashed})


# -- streams ----------------------------------------------------------------


def change_batch(spark, sf_dir) -> DataFrame:
    """Change records from events: a user's events are upserts of one document, errors delete it."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", maintenance.DELETE).otherwise(maintenance.UPSERT)
    return e.select(
        (F.col("user_id") % 4).cast("int").alias("shard"),
        (F.col("event_id") + 1).alias("seqno"),
        op.alias("op"),
        F.col("user_id").cast("string").alias("doc_id"),
        F.col("props").alias("doc"),
    )


#: The last record of each user, unless it is a deletion.
LAST_EVENTS = """SELECT user_id::VARCHAR AS doc_id, props AS doc FROM events WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY user_id) AND event_type <> 'error'"""


@query("str10_apply_changes", LAST_EVENTS)
def str10(spark, sf_dir):
    changes = change_batch(spark, sf_dir)
    half = F.col("seqno") % 2 == 0
    empty = spark.createDataFrame([], "doc_id string, doc string")
    # The later half of the records first: what comes after is older and must not win.
    return maintenance.apply_changes(empty, changes.where(half).unionByName(changes.where(~half)))


@query("str3_sequence_filter", "SELECT user_id % 4 AS shard, count(*) AS n FROM events WHERE event_id + 1 > CASE user_id % 4 WHEN 1 THEN 5000 WHEN 2 THEN 100 ELSE 0 END GROUP BY 1")
def str3(spark, sf_dir):
    fresh = maintenance.new_records(change_batch(spark, sf_dir), {1: 5000, 2: 100})
    return fresh.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"))


@query("str12_versions", LAST_EVENTS)
def str12(spark, sf_dir):
    import tempfile

    root = (spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="store-")).rstrip("/") + "/str12-" + str(spark.sparkContext.startTime) + "-" + str(abs(hash(sf_dir)))
    store = maintenance.Store(spark, root, buckets=4)
    changes = change_batch(spark, sf_dir)
    store.commit(changes.where("seqno <= 500"), 0)
    store.commit(changes, 1)
    return store.read().orderBy("doc_id")


# -- collation --------------------------------------------------------------


@query("typ1_collation_order", "SELECT * FROM (VALUES (0, 'null'), (1, 'false'), (2, 'true'), (3, '-3'), (4, '5.5'), (5, '10'), (6, '\"a\"'), (7, '\"b\"'), (8, '[1]'), (9, '[1,2]'), (10, '{\"a\":1}')) t(place, doc)")
def typ1(spark, sf_dir):
    values = ['"b"', "10", "null", '{"a":1}', "true", "[1,2]", "-3", '"a"', "false", "[1]", "5.5"]
    docs = spark.createDataFrame([(v,) for v in values], "doc string").withColumn("key", C.variant_key(F.parse_json("doc")))
    place = F.row_number().over(Window.orderBy("key")) - 1
    return docs.select(place.cast("int").alias("place"), "doc")


@query("ddl11_covering_index", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def ddl11(spark, sf_dir):
    catalog = Catalog()
    source = table(spark, sf_dir, "orders")
    catalog.create(simple("wide", "o_orderstatus", "o_custkey", "o_orderpriority", doc_id="o_orderkey"), source)
    catalog.create(simple("narrow", "o_orderstatus", doc_id="o_orderkey"), source)
    best = covering(list(catalog.entries.values()), {"o_orderstatus"})
    group = GroupAggregate((GroupKey("o_orderstatus", 0),), (call("n", Aggregate.COUNT, 0),))
    return scan.scan(best.index, ScanRequest(group=group))
