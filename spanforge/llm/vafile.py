"""Exact top-k search by inner product with a vector-approximation file.

Every component is kept as one of 16 cells of equal width over its dimension's
range; a table of blocks of cells is the approximation file, beside one of blocks
of exact vectors. For a query q, a row's inner product lies within
``q . middle(cell) +- |q| . half widths``. Phase one scans cells only: the k best
lower bounds of a query over all blocks give a score that the k-th result reaches.
Phase two scans the cells again, and of a block's rows whose upper bound reaches
that score reads exact vectors in descending order of the bound, until the k-th
best exact score is above all bounds that are left. So the result is exact,
whatever the cells are worth.

Queries are cut into blocks as well, and each task takes one block of queries and
one of rows; what a task holds is bounded by the block sizes. Results are merged
per query by top-k aggregation, k rows for each block at most.

Cases: vectors that are null, empty, hold null or non-finite components, or whose
dimension isn't the most frequent one take no part; ties go to the smaller id;
rows of equal id are all candidates, but not of a query with that id, and of
query rows with equal id the least vector is asked; an empty
table gives no rows; other columns are ignored. Scores are exact while components
are integers and sums stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import partitions, save, table

CELLS = 16
ROWS, QUERIES = 8192, 512
FOUND = "query_id long, vec_id long, score double"


def blocked(size: int, kind: str):
    """Packs rows id, v (arrays of doubles) into blocks of at most ``size``: ids and components as bytes."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held = [], [], 0

        def flush(n: int) -> pa.RecordBatch:
            nonlocal ids, vectors, held
            i, v = np.concatenate(ids), np.concatenate(vectors)
            ids, vectors, held = [i[n:]], [v[n:]], len(i) - n
            return pa.RecordBatch.from_arrays(
                [pa.array([i[:n].astype("<i8").tobytes()]), pa.array([v[:n].astype("<f8").tobytes()])], names=[f"{kind}_ids", f"{kind}_v"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            vectors.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            held += batch.num_rows
            while held >= size:
                yield flush(size)
        if held:
            yield flush(held)

    return block


def quantise(vectors: np.ndarray, low: np.ndarray, width: np.ndarray, cells: int = CELLS) -> np.ndarray:
    return np.clip(np.floor((vectors - low) / width), 0, cells - 1).astype(np.uint8)


def approximator(low: np.ndarray, width: np.ndarray, cells: int):
    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                quantise(np.frombuffer(v.as_py(), "<f8").reshape(-1, len(low)), low, width, cells).tobytes() for v in batch.column("row_v")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row_ids"), batch.column("row_v"), pa.array(out)], names=["row_ids", "row_v", "cells"])

    return approximate


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of queries x rows."""
    middle = low + (cells + 0.5) * width
    centre = queries @ middle.T
    # A little more than half a cell, for rounding in sums.
    spread = (np.abs(queries) @ (width / 2))[:, None] * (1 + 1e-9) + 1e-6
    return centre - spread, centre + spread


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def found_batch(q: list, r: list, s: list) -> pa.RecordBatch:
    q, r, s = (np.concatenate(x) if x else np.empty(0) for x in (q, r, s))
    return pa.RecordBatch.from_arrays(
        [pa.array(q.astype(np.int64)), pa.array(r.astype(np.int64)), pa.array(s.astype(np.float64))], names=["query_id", "vec_id", "score"]
    )


def lower_scan(low: np.ndarray, width: np.ndarray, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                qi, ri = (np.frombuffer(batch.column(c)[b].as_py(), "<i8") for c in ("query_ids", "row_ids"))
                q = np.frombuffer(batch.column("query_v")[b].as_py(), "<f8").reshape(len(qi), -1)
                cells = np.frombuffer(batch.column("cells")[b].as_py(), np.uint8).reshape(len(ri), -1)
                lower, _ = bounds(q, cells, low, width)
                lower[qi[:, None] == ri[None, :]] = -np.inf
                n = min(k, len(ri))
                best = np.argpartition(lower, len(ri) - n, axis=1)[:, len(ri) - n :]
                values = np.take_along_axis(lower, best, axis=1)
                keep = values > -np.inf
                yield found_batch([np.repeat(qi, n)[keep.ravel()]], [ri[best].ravel()[keep.ravel()]], [values.ravel()[keep.ravel()]])

    return scan


def exact_scan(low: np.ndarray, width: np.ndarray, k: int, step: int = 64):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                qi, ri = (np.frombuffer(batch.column(c)[b].as_py(), "<i8") for c in ("query_ids", "row_ids"))
                q = np.frombuffer(batch.column("query_v")[b].as_py(), "<f8").reshape(len(qi), -1)
                exact = np.frombuffer(batch.column("row_v")[b].as_py(), "<f8").reshape(len(ri), -1)
                cells = np.frombuffer(batch.column("cells")[b].as_py(), np.uint8).reshape(len(ri), -1)
                reach = np.frombuffer(batch.column("reach")[b].as_py(), "<f8")
                _, upper = bounds(q, cells, low, width)
                upper[qi[:, None] == ri[None, :]] = -np.inf
                out: tuple[list, list, list] = ([], [], [])
                for j in range(len(qi)):
                    at = np.flatnonzero((upper[j] >= reach[j]) & (upper[j] > -np.inf))
                    at = at[np.argsort(-upper[j][at], kind="stable")]
                    scores, i = np.empty(0), 0
                    while i < len(at):
                        if len(scores) >= k and np.partition(scores, len(scores) - k)[len(scores) - k] > upper[j][at[i]]:
                            break
                        scores = np.concatenate([scores, exact[at[i : i + step]] @ q[j]])
                        i += step
                    seen = at[: len(scores)]
                    best = top(scores, ri[seen], k)
                    out[0].append(np.full(len(best), qi[j]))
                    out[1].append(ri[seen][best])
                    out[2].append(scores[best])
                yield found_batch(*out)

    return scan


def with_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows query id, score to reach, vector -> blocks, as ``blocked`` does, with the scores beside."""
    for batch in blocked(QUERIES, "query")(batches):
        v = np.frombuffer(batch.column(1)[0].as_py(), "<f8").reshape(len(np.frombuffer(batch.column(0)[0].as_py(), "<i8")), -1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([np.ascontiguousarray(v[:, 1:]).tobytes()]), pa.array([np.ascontiguousarray(v[:, 0]).tobytes()])],
            names=["query_ids", "query_v", "reach"],
        )


def valid(vectors: DataFrame) -> DataFrame:
    """Rows id, v of finite vectors of the most frequent dimension."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    usual = own.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return own.where(F.size("v") == (usual["dim"] if usual else 0))


def search(vectors: DataFrame, is_query, k: int, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score of a table id, v (array of doubles); ``is_query``: a condition on it."""
    spark = vectors.sparkSession
    ship_package(spark)
    own = valid(vectors)
    n = partitions(spark)
    stats = own.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    stats = sorted(stats.collect())  # a row for each dimension
    if not stats:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    low = np.array([r["low"] for r in stats])
    width = np.maximum((np.array([r["high"] for r in stats]) - low) / cells, 1e-9)
    rows = own.mapInArrow(blocked(ROWS, "row"), "row_ids binary, row_v binary")
    rows = save(rows.mapInArrow(approximator(low, width, cells), "row_ids binary, row_v binary, cells binary"), "va-file")
    queries = own.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    asked = save(queries.mapInArrow(blocked(QUERIES, "query"), "query_ids binary, query_v binary"), "va-queries")
    # Blocks of the query set against blocks of rows: few rows, each of bounded size.
    pairs = asked.crossJoin(rows.select("row_ids", "cells")).repartition(n)
    best = pairs.mapInArrow(lower_scan(low, width, k), FOUND)
    kth = F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf")))
    reach = ranked(best, k).groupBy("query_id").agg(kth.alias("reach"))
    own_reach = queries.join(reach.withColumnRenamed("query_id", "_q"), F.col("id") == F.col("_q"))
    blocks = own_reach.select("id", F.concat(F.array("reach"), "v").alias("v"))
    blocks = save(blocks.mapInArrow(with_reach, "query_ids binary, query_v binary, reach binary"), "va-reach")
    pairs = blocks.crossJoin(rows).repartition(n)
    out = ranked(pairs.mapInArrow(exact_scan(low, width, k), FOUND), k)
    return out.select("query_id", F.col("rank"), "vec_id", "score")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op10_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows by integer inner product for every 50th vector."""
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = table(spark, sf_dir, "embeddings").where(finite)
    vectors = vectors.select(F.col("vec_id").alias("id"), scaled.alias("v"))
    found = search(vectors, F.col("id") % 50 == 0, 5)
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.e, r.e)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
), t AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""
