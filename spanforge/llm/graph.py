"""Connected components of an edge table, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

MOST_ROUNDS = 50


def _lowest(edges: DataFrame) -> DataFrame:
    """a, b with the least b of each a. Partial aggregates meet a hot node before the shuffle; the join is one that Spark can split."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    return edges.join(low.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).drop("_a")


def connected_components(edges: DataFrame) -> DataFrame:
    """id, root (the least id of the component) of every node of edges a, b (longs).

    Alternating large-star and small-star: each round links larger neighbours, then smaller ones, to the
    least neighbour, until the edges are stars. Every round is a saved table; edges never outnumber the input.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _lowest(both).where("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b")).distinct()
        small = _lowest(large)
        linked = small.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        now = save(linked.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
