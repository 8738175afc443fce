"""Nearest neighbours: exact, inverted file, quantised with re-ranking, and sparse.

Distances are smaller-is-better: L2 is squared Euclidean, COSINE is 1 - cos clipped to
0..2, DOT is the negated inner product.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from enum import StrEnum

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Metric(StrEnum):
    L2 = "l2"
    COSINE = "cosine"
    DOT = "dot"


ALIASES = {"EUCLIDEAN": Metric.L2, "L2": Metric.L2, "EUCLIDEAN_SQUARED": Metric.L2, "L2_SQUARED": Metric.L2, "COSINE": Metric.COSINE, "DOT": Metric.DOT}


class VectorError(ValueError):
    pass


def metric_of(name: str) -> Metric:
    try:
        return ALIASES[name.upper()]
    except KeyError:
        raise VectorError(f"unknown similarity {name}") from None


def check_query(query: Sequence[float], metric: Metric, dimension: int | None = None) -> list[float]:
    values = [float(x) for x in query]
    if dimension is not None and len(values) != dimension:
        raise VectorError(f"query of dimension {len(values)}, index of {dimension}")
    if metric == Metric.COSINE and not any(values):
        raise VectorError("zero query vector under cosine")
    return values


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(vector: Column, query: Sequence[float], metric: Metric) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == Metric.L2:
        return F.aggregate(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    if metric == Metric.DOT:
        return -_dot(vector, q)
    norm = math.sqrt(sum(x * x for x in query))
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - _dot(vector, q) / (F.sqrt(_dot(vector, vector)) * norm)))


def valid_dense(vector: Column, dimension: int, metric: Metric) -> Column:
    """The vector, or null if it is no vector of finite numbers of that dimension, or zero under cosine."""
    fine = (F.size(vector) == dimension) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if metric == Metric.COSINE:
        fine = fine & F.exists(vector, lambda x: x != 0)
    return F.when(F.coalesce(fine, F.lit(False)), vector)


def valid_sparse(indices: Column, values: Column) -> Column:
    """indices and values sorted by index, or null: equal lengths, indices in [0, 2**32) without duplicates, not all zero."""
    fine = (
        (F.size(indices) == F.size(values))
        & F.forall(indices, lambda i: i.isNotNull() & (i >= 0) & (i < (1 << 32)))
        & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v))
        & (F.size(F.array_distinct(indices)) == F.size(indices))
        & F.exists(values, lambda v: v != 0)
    )
    pairs = F.array_sort(F.arrays_zip(indices.alias("i"), values.alias("v")))
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(F.transform(pairs, lambda p: p["i"]).alias("indices"), F.transform(pairs, lambda p: p["v"]).alias("values")))


def knn(rows: DataFrame, id_: str, vector: str, query: Sequence[float], metric: Metric, k: int | None = None, offset: int = 0, where: str | None = None) -> DataFrame:
    """Rows with ``distance``, nearest first, ties by id; filters come before the limit; without a limit all rows."""
    query = check_query(query, metric)
    found = rows if where is None else rows.where(F.coalesce(F.expr(where), F.lit(False)))
    found = found.withColumn("distance", distance(F.col(vector), query, metric))
    if k is None:
        return found
    found = found.orderBy(F.col("distance").asc_nulls_last(), F.col(id_))
    return (found.offset(offset) if offset else found).limit(k)


def nlist_for(items: int) -> int:
    return max(1, math.ceil(items / 1000))


def train_size(nlist: int, explicit: int = 0, pq_bits: int | None = None) -> int:
    return explicit or (max(1 << pq_bits, nlist) if pq_bits else nlist)


@dataclass
class InvertedFile:
    """Rows with the number of their centroid, and the centroids (nlist of them, by parameter)."""

    rows: DataFrame
    centroids: np.ndarray
    id_: str
    vector: str
    metric: Metric

    def probes(self, query: Sequence[float], nprobes: int) -> list[int]:
        q = np.asarray(check_query(query, self.metric, self.centroids.shape[1]))
        c = self.centroids
        if self.metric == Metric.L2:
            d = ((c - q) ** 2).sum(1)
        elif self.metric == Metric.DOT:
            d = -(c @ q)
        else:
            d = 1 - (c @ q) / np.maximum(np.linalg.norm(c, axis=1) * np.linalg.norm(q), 1e-30)
        return [int(i) for i in np.argsort(d, kind="stable")[: max(1, min(nprobes, len(c)))]]

    def search(self, query: Sequence[float], k: int | None, nprobes: int = 1, offset: int = 0, where: str | None = None) -> DataFrame:
        near = self.rows.where(F.col("centroid").isin(self.probes(query, nprobes)))
        return knn(near, self.id_, self.vector, query, self.metric, k, offset, where)


def train_inverted(rows: DataFrame, id_: str, vector: str, metric: Metric, nlist: int, most_training: int = 50_000, seed: int = 42) -> InvertedFile:
    """K-means on a bounded sample by a hash of the id; every row is assigned."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = rows.withColumn("_features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    sample = ready.orderBy(F.xxhash64(F.lit(seed), F.col(id_).cast("string"))).limit(most_training)
    measure = "cosine" if metric == Metric.COSINE else "euclidean"
    model = KMeans(k=nlist, seed=seed, maxIter=20, featuresCol="_features", predictionCol="centroid", distanceMeasure=measure).fit(sample)
    assigned = model.transform(ready).drop("_features")
    return InvertedFile(assigned, np.array(model.clusterCenters()), id_, vector, metric)


@dataclass(frozen=True)
class ScalarQuantizer:
    """Components as codes of 4, 6 or 8 bits over each dimension's range."""

    low: tuple[float, ...]
    high: tuple[float, ...]
    bits: int

    @classmethod
    def train(cls, rows: DataFrame, vector: str, bits: int) -> ScalarQuantizer:
        found = rows.select(F.posexplode(vector).alias("d", "x")).groupBy("d").agg(F.min("x").alias("l"), F.max("x").alias("h"))
        stats = sorted(found.collect())  # a row for each dimension
        return cls(tuple(float(r["l"]) for r in stats), tuple(float(r["h"]) for r in stats), bits)

    def _arrays(self) -> tuple[Column, Column]:
        top = (1 << self.bits) - 1
        steps = [max(h - l, 1e-12) / top for l, h in zip(self.low, self.high, strict=True)]
        return F.array(*[F.lit(x) for x in self.low]), F.array(*[F.lit(x) for x in steps])

    def encode(self, vector: Column) -> Column:
        low, step = self._arrays()
        top = (1 << self.bits) - 1
        moved = F.zip_with(vector, low, lambda x, l: x.cast("double") - l)
        return F.zip_with(moved, step, lambda x, s: F.greatest(F.lit(0), F.least(F.lit(top), F.round(x / s))).cast("smallint"))

    def decode(self, codes: Column) -> Column:
        low, step = self._arrays()
        return F.zip_with(F.zip_with(codes, step, lambda c, s: c * s), low, lambda x, l: x + l)


@dataclass
class ProductQuantizer:
    """m sub-vectors, each the number of its nearest of 2**bits centroids."""

    books: np.ndarray  # m x 2**bits x dimension / m

    @classmethod
    def train(cls, rows: DataFrame, vector: str, m: int, bits: int, most_training: int = 20_000, seed: int = 42, rounds: int = 15) -> ProductQuantizer:
        sample = rows.orderBy(F.xxhash64(F.lit(seed), F.col(vector).cast("string"))).limit(most_training).select(vector)
        x = np.array([r[0] for r in sample.collect()], dtype=np.float64)  # most_training rows
        rng, books = np.random.default_rng(seed), []
        for part in np.split(x, m, axis=1):
            n = min(1 << bits, len(part))
            centres = part[rng.choice(len(part), n, replace=False)]
            for _ in range(rounds):
                at = ((part[:, None] - centres[None]) ** 2).sum(2).argmin(1)
                for c in range(n):
                    if (at == c).any():
                        centres[c] = part[at == c].mean(0)
            books.append(centres)
        return cls(np.array(books))

    def encode(self, vector: Column) -> Column:
        books = self.books

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def assign(values):
            import pandas as pd

            x = np.array(values.tolist(), dtype=np.float64)
            parts = [((p[:, None] - b[None]) ** 2).sum(2).argmin(1) for p, b in zip(np.split(x, len(books), axis=1), books, strict=True)]
            return pd.Series(list(np.stack(parts, 1).astype(np.int32)))

        return assign(vector)

    def table(self, query: Sequence[float], metric: Metric) -> list[list[float]]:
        """Partial distances of a query to every centroid: a code's distance is a sum of m of them."""
        parts = np.split(np.asarray(query, dtype=np.float64), len(self.books))
        if metric == Metric.L2:
            return [((b - p) ** 2).sum(1).tolist() for p, b in zip(parts, self.books, strict=True)]
        return [(-(b @ p)).tolist() for p, b in zip(parts, self.books, strict=True)]

    def distance(self, codes: Column, query: Sequence[float], metric: Metric) -> Column:
        tables = F.array(*[F.array(*[F.lit(x) for x in row]) for row in self.table(query, metric)])
        return F.aggregate(F.zip_with(codes, tables, lambda c, t: F.get(t, c)), F.lit(0.0), lambda s, x: s + x)


def rabit_encode(vector: Column, dimension: int, seed: int = 7) -> Column:
    """One bit per dimension of the randomly rotated vector, as a binary value."""
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))[0]

    @F.pandas_udf(T.BinaryType())
    def signs(values):
        import pandas as pd

        x = np.array(values.tolist(), dtype=np.float64) @ rotation
        return pd.Series([b.tobytes() for b in np.packbits(x > 0, axis=1)])

    return signs(vector)


def rerank(approximate: DataFrame, full: DataFrame, id_: str, vector: str, query: Sequence[float], metric: Metric, k: int, offset: int = 0) -> DataFrame:
    """Exact order of candidates (``id_`` is enough): their full vectors are joined. ``approximate`` has factor * (k + offset) rows."""
    near = full.join(F.broadcast(approximate.select(id_)), id_, "left_semi")
    return knn(near, id_, vector, query, metric, k, offset)


def quantised_search(index: InvertedFile, quantizer: ScalarQuantizer, query: Sequence[float], k: int, nprobes: int, factor: int = 5, offset: int = 0) -> DataFrame:
    """Candidates by decoded codes, factor * (k + offset) of them, then re-ranked by full vectors."""
    coded = index.rows.where(F.col("centroid").isin(index.probes(query, nprobes)))
    coded = coded.withColumn("_decoded", quantizer.decode(quantizer.encode(F.col(index.vector))))
    near = knn(coded, index.id_, "_decoded", query, index.metric, factor * (k + offset))
    return rerank(near, index.rows, index.id_, index.vector, query, index.metric, k, offset)


def sparse_knn(postings: DataFrame, id_: str, query: dict[int, float], k: int | None = None) -> DataFrame:
    """``postings``: id, term, weight. Negated inner product; documents that share no term with the query are left out."""
    q = postings.sparkSession.createDataFrame([(int(t), float(w)) for t, w in query.items()], "term long, q double")
    found = postings.join(F.broadcast(q), "term").groupBy(id_).agg((-F.sum(F.col("weight") * F.col("q"))).alias("distance"))
    return found if k is None else found.orderBy("distance", id_).limit(k)


def splitmix(x: np.ndarray) -> np.ndarray:
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sparse_projection(indices: np.ndarray, values: np.ndarray, dimension: int, seed: int = 42) -> np.ndarray:
    """A sparse random projection: each term adds +-sqrt(3) times its value to a third of the dimensions, by hash."""
    cells = np.asarray(indices, dtype=np.uint64)[:, None] * np.uint64(dimension) + np.arange(dimension, dtype=np.uint64)[None]
    with np.errstate(over="ignore"):
        h = splitmix(cells ^ splitmix(np.array([seed]))[0]) % np.uint64(6)
    sign = np.where(h == 0, math.sqrt(3), np.where(h == 1, -math.sqrt(3), 0.0))
    return (sign * np.asarray(values)[:, None]).sum(0) / math.sqrt(dimension)


def project_sparse(indices: Column, values: Column, dimension: int, seed: int = 42) -> Column:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def project(i, v):
        import pandas as pd

        return pd.Series([sparse_projection(a, b, dimension, seed).astype(np.float32) for a, b in zip(i, v, strict=True)])

    return project(indices, values)


def encode_vector(vector: Column, big_endian: bool = False) -> Column:
    """Base64 of 32-bit floats."""
    order = ">f4" if big_endian else "<f4"

    @F.pandas_udf(T.BinaryType())
    def pack(values):
        import pandas as pd

        return pd.Series([None if v is None else np.asarray(v, dtype=order).tobytes() for v in values])

    return F.base64(pack(vector))


def decode_vector(text: Column, big_endian: bool = False) -> Column:
    order = ">f4" if big_endian else "<f4"

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def unpack(values):
        import pandas as pd

        return pd.Series([None if v is None else np.frombuffer(v, dtype=order).astype(np.float32) for v in values])

    return unpack(F.unbase64(text))


def recall(found: DataFrame, truth: DataFrame, id_: str) -> DataFrame:
    """One row: recall, the share of the true ids that were found."""
    hit = truth.select(id_).join(found.select(id_).withColumn("hit", F.lit(1)), id_, "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))
