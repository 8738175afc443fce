"""Change streams, versions and consistency; catalog rules; vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import vector
from spanforge.plans.catalog import Catalog, CatalogError, State, parse_description, simple, validate
from spanforge.plans.request import IndexDefinition, IndexKey
from spanforge.sources.changes import SCHEMA, read_changes
from spanforge.streaming.maintenance import Consistency, NotConsistent, Store, as_recent, union


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def content(df):
    return {r["doc_id"]: r["doc"] for r in df.collect()}


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", buckets=4)
    assert content(store.read()) == {}
    assert store.commit(changes(spark, (0, 1, "upsert", "a", "1"), (0, 2, "upsert", "b", "1"), (1, 1, "upsert", "c", "1")), 0) == 1
    assert store.commit(changes(spark, (0, 1, "upsert", "a", "old")), 0) is None  # the batch came again
    assert store.commit(changes(spark, (0, 2, "upsert", "b", "old")), 1) is None  # the record came again
    store.commit(changes(spark, (0, 3, "upsert", "a", "2"), (0, 4, "delete", "b", None), (0, 5, "upsert", "a", "3")), 2)
    assert content(store.read()) == {"a": "3", "c": "1"}
    assert content(store.read(1)) == {"a": "1", "b": "1", "c": "1"}
    assert store.seqnos() == {0: 5, 1: 1}
    store.commit(changes(spark, (0, 6, "expire", "a", None), (1, 9, "delete", "c", None)), 3)
    assert content(store.read()) == {}
    store.rollback(1)
    assert content(store.read()) == {"a": "1", "b": "1", "c": "1"}


def test_rollback_and_replay_lose_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    feed = [changes(spark, (0, i + 1, "upsert", x, str(i))) for i, x in enumerate("abcd")]
    for i in range(3):
        store.commit(feed[i], i)
    store.rollback(1)
    assert content(store.read()) == {"a": "0"} and store.seqnos() == {0: 1}
    with pytest.raises(NotConsistent):
        store.commit(feed[3], 3)
    for i in range(1, 4):
        assert store.commit(feed[i], i)
    assert content(store.read()) == {"a": "0", "b": "1", "c": "2", "d": "3"}
    store.rollback(2)
    # A new feed counts from 0.
    for i in range(4):
        store.commit(feed[i], i)
    assert content(store.read()) == {"a": "0", "b": "1", "c": "2", "d": "3"}


def test_stream_and_consistency(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", buckets=4)
    changes(spark, (0, 1, "upsert", "a", "1"), (0, 2, "upsert", "b", "1")).coalesce(1).write.parquet(f"{tmp_path}/in")
    store.maintain(read_changes(spark, f"{tmp_path}/in"), f"{tmp_path}/check").awaitTermination()
    changes(spark, (0, 3, "delete", "a", None), (1, 1, "upsert", "c", "1")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(NotConsistent):
        store.snapshot(Consistency.AT_LEAST, {0: 3})
    store.maintain(read_changes(spark, f"{tmp_path}/in"), f"{tmp_path}/check").awaitTermination()
    assert content(store.snapshot(Consistency.AT_LEAST, {0: 3, 1: 1})) == {"b": "1", "c": "1"}


def test_timestamps():
    assert as_recent({0: 5, 1: 2}, {0: 5}) and not as_recent({0: 5}, {1: 1})
    assert union({0: 1, 1: 5}, {0: 3, 2: 1}) == {0: 3, 1: 5, 2: 1}


def test_catalog(spark):
    rows = spark.createDataFrame([(1, "a")], "doc_id int, k string")
    catalog = Catalog()
    catalog.create(simple("now", "k"), rows)
    catalog.create(simple("later", "k", options={"defer_build": True}), rows)
    assert catalog.by_name("now").state == State.ACTIVE and catalog.by_name("later").state == State.CREATED
    with pytest.raises(CatalogError):
        catalog.index("later")
    catalog.build("later")
    assert catalog.names() == ["later", "now"]
    catalog.drop("now")
    for broken in (lambda: catalog.by_name("now"), lambda: catalog.create(simple("later", "k"), rows), lambda: catalog.alter("later"), catalog.create_aggregate):
        with pytest.raises(CatalogError):
            broken()


@pytest.mark.parametrize(
    "options", [{"unknown": 1}, {"num_partition": 0}, {"scan_nprobes": 0}, {"train_list": -1}, {"num_partition": "x"}, {"similarity": "MANHATTAN", "dimension": 4}, {"sparsejl_dim": 8, "similarity": "L2"}, {"dimension": 6, "description": "IVF,PQ4x8"}, {}]
)
def test_invalid_options(options):
    with pytest.raises(CatalogError):
        validate(IndexDefinition("v", (IndexKey("e", "e", vector=True),), options=options))


def test_descriptions():
    assert parse_description("IVF1024,PQ8x8").m == 8
    assert parse_description("ivf, sq8").nlist is None
    assert parse_description("IVF,RaBitQ4").kind == "rabitq"
    for text in ("PQ8", "IVF,SQ5", "IVF0,SQ8", "IVF,RaBitQ0"):
        with pytest.raises(CatalogError):
            parse_description(text)


def vectors(spark, n=300, d=16):
    x = np.random.default_rng(0).normal(size=(n, d))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<double>")


@pytest.mark.parametrize("metric", list(vector.Metric))
def test_exact_neighbours(spark, metric):
    x, rows = vectors(spark)
    q = x[5] + 0.1
    d = {"l2": ((x - q) ** 2).sum(1), "dot": -(x @ q), "cosine": 1 - x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))}[metric.value]
    found = vector.knn(rows, "id", "e", q.tolist(), metric, 7, offset=2).collect()
    assert [r["id"] for r in found] == np.argsort(d, kind="stable")[2:9].tolist()


def test_inverted_file_and_quantisers(spark):
    x, rows = vectors(spark)
    q = x[9].tolist()
    truth = vector.knn(rows, "id", "e", q, vector.Metric.L2, 10)
    index = vector.train_inverted(rows, "id", "e", vector.Metric.L2, 8)
    assert vector.recall(index.search(q, 10, nprobes=8), truth, "id").first()["recall"] == 1.0
    assert vector.recall(index.search(q, 10, nprobes=3), truth, "id").first()["recall"] >= 0.5
    sq = vector.ScalarQuantizer.train(rows, "e", 8)
    assert vector.recall(vector.quantised_search(index, sq, q, 10, 8), truth, "id").first()["recall"] == 1.0
    pq = vector.ProductQuantizer.train(rows, "e", 4, 5)
    near = rows.withColumn("d", pq.distance(pq.encode(F.col("e")), q, vector.Metric.L2)).orderBy("d", "id").limit(40)
    assert vector.recall(vector.rerank(near, rows, "id", "e", q, vector.Metric.L2, 10), truth, "id").first()["recall"] >= 0.7


def test_vector_rules(spark):
    with pytest.raises(vector.VectorError):
        vector.check_query([0, 0], vector.Metric.COSINE)
    with pytest.raises(vector.VectorError):
        vector.check_query([1, 0], vector.Metric.L2, 3)
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, None), (3, [math.nan, 1.0]), (4, [0.0, 0.0])], "id int, e array<double>")
    fine = rows.where(vector.valid_dense(F.col("e"), 2, vector.Metric.COSINE).isNotNull())
    assert [r["id"] for r in fine.collect()] == [0]
    sparse = spark.createDataFrame([([3, 1], [1.0, 2.0]), ([1, 1], [1.0, 2.0]), ([1], [0.0]), ([-1], [1.0]), ([1], [1.0, 2.0])], "i array<long>, v array<double>")
    found = sparse.select(vector.valid_sparse(F.col("i"), F.col("v")).alias("s")).where("s IS NOT NULL").collect()
    assert len(found) == 1 and list(found[0]["s"]["indices"]) == [1, 3]
    assert (vector.nlist_for(1500), vector.train_size(10), vector.train_size(10, pq_bits=8), vector.train_size(10, 99)) == (2, 10, 256, 99)


def test_projection_keeps_inner_products():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=50), rng.normal(size=50)
    i = np.arange(50)
    pa, pb = (vector.sparse_projection(i, v, 4096) for v in (a, b))
    assert pa @ pb == pytest.approx(a @ b, abs=3)
