"""Packing documents into sequences of a fixed window, by non-negative least squares.

A document's ids are cut into whole windows and a tail; a tail of more than
``longest_tail`` is cut once more. Piece lengths are counted in classes of UNIT
ids. Shallow combinations of classes that fill a window (some of one length and
some of another, or three lengths once each) are the columns of a matrix; repeat
counts for them come from a non-negative least squares fit to the histogram,
rounded down. The pieces of a class are numbered, and the combinations take them
by number. What remains is packed greedily (best fit, longest first), in groups
of bounded size.

Only the histogram goes to the driver, a count for each class; pieces are
numbered with counts by class and salt, so a frequent length is never one task's.

Cases: a null or empty text is just the end id, a piece of one id; rows of equal
id are packed each; null ids are packed like others; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import save, table
from .tokens import default_path, encoder

WINDOW, UNIT, LONGEST_TAIL = 4096, 16, 2048
#: Pieces that one task numbers or packs greedily at a time.
GROUP = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long"


def cutter(tokenizer_path: str, end_id: int, window: int, longest_tail: int):
    names = [x.split()[0] for x in PIECES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(enc.encode(text) + end, dtype=enc.dtype).astype("<u4")
                n, at = len(ids), 0
                while at < n:
                    size = window if n - at >= window else min(n - at, longest_tail)
                    for column, value in zip(out, (doc_id, at, size, zlib.crc32(ids[at : at + size].tobytes()), n), strict=True):
                        column.append(value)
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in out], names=names)

    return cut


def combinations(classes: int) -> list[dict[int, int]]:
    """Ways to fill ``classes`` units to the last but one: class -> how many."""
    found: dict[tuple, dict[int, int]] = {}

    def add(*parts: tuple[int, int]) -> None:
        own: dict[int, int] = {}
        for c, m in parts:
            if m:
                own[c] = own.get(c, 0) + m
        if classes - 1 <= sum(c * m for c, m in own.items()) <= classes:
            found[tuple(sorted(own.items()))] = own

    for a in range(1, classes + 1):
        add((a, classes // a))
        for m in range(1, min(classes // a, 4) + 1):
            rest = classes - m * a
            for b in range(1, min(a, rest + 1)):
                add((a, m), (b, rest // b))
        for b in range(1, a):
            if 0 < classes - a - b < b:
                add((a, 1), (b, 1), (classes - a - b, 1))
    return list(found.values())


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    scale = max(float(np.abs(b).max(initial=0)), 1.0)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-9 * scale:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            gone = at[(x[at] <= 1e-12 * scale) & low]
            if not len(gone):
                gone = at[low][:1]
            free[gone] = False
            x[gone] = 0
    return x


def repeat_counts(histogram: np.ndarray, classes: int) -> list[tuple[dict[int, int], int]]:
    """Combinations with how often each is used: rounded down, and never more pieces than there are. histogram[c - 1]: pieces of class c."""
    used = [c for c in combinations(classes) if all(histogram[k - 1] for k in c)]
    if not used:
        return []
    a = np.zeros((classes, len(used)))
    for j, c in enumerate(used):
        for k, m in c.items():
            a[k - 1, j] = m
    left, out = histogram.astype(np.int64).copy(), []
    x = nnls(a, histogram.astype(float))
    for j in np.argsort(-x, kind="stable"):
        n = min([int(x[j] + 1e-6), *(int(left[k - 1]) // m for k, m in used[j].items())])
        if n > 0:
            out.append((used[j], n))
            for k, m in used[j].items():
                left[k - 1] -= n * m
    return out


def best_fit(lengths: np.ndarray, window: int) -> np.ndarray:
    """The bin of each length, longest first, each into the fullest bin that it fits."""
    bins = np.empty(len(lengths), dtype=np.int64)
    spaces: list[tuple[int, int]] = []
    opened = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        k = bisect.bisect_left(spaces, (n, -1))
        if k < len(spaces):
            space, b = spaces.pop(k)
        else:
            space, b, opened = window, opened, opened + 1
        bins[i] = b
        if space > n:
            bisect.insort(spaces, (space - n, b))
    return bins


def greedy(window: int):
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        pdf["bin"] = best_fit(pdf["length"].to_numpy(), window)
        return pdf

    return place


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, longest_tail: int = LONGEST_TAIL) -> DataFrame:
    ship_package(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(cutter(tokenizer_path, end_id, window, longest_tail), PIECES)


def pack(cut: DataFrame, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """The pieces (a saved table) with sequence_id and offset."""
    spark = cut.sparkSession
    ship_package(spark)
    classes = window // unit
    total = cut.count()
    salts = max(1, -(-total // GROUP))
    own = cut.withColumns(
        {
            "class": F.ceil(F.col("length") / unit).cast("int"),
            "salt": F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"),
        }
    )
    counts = save(own.groupBy("class", "salt").agg(F.count("*").alias("n")), "pack-counts")
    histogram = np.zeros(classes, dtype=np.int64)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # a row for each class at most
        histogram[r["class"] - 1] = r["n"]
    used = repeat_counts(histogram, classes)

    lower = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("class", "salt", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("base"))
    within = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")
    own = own.withColumn("nth", F.row_number().over(within) - 1).join(base, ["class", "salt"])
    own = own.withColumn("nth", F.col("nth") + F.col("base"))

    taken = np.zeros(classes, dtype=np.int64)
    plan, sequence = [], 0
    for combination, n in used:
        for k, m in combination.items():
            plan.append((k, int(taken[k - 1]), int(taken[k - 1] + n * m), m, sequence))
            taken[k - 1] += n * m
        sequence += n
    schema = "class int, first long, past long, times int, sequence long"
    # As many rows as least squares has columns in use, times the lengths of each: it grows with neither documents nor tasks.
    rules = spark.createDataFrame(plan, schema).withColumnRenamed("class", "k")
    hit = (F.col("class") == F.col("k")) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("past"))
    own = own.join(F.broadcast(rules), hit, "left")
    at = F.col("sequence") + F.floor((F.col("nth") - F.col("first")) / F.col("times"))
    own = save(own.withColumn("sequence_id", at.cast("long")).select(*PLACED.replace(" long", "").split(", ")), "pack-placed")

    rest = own.where("sequence_id IS NULL").drop("sequence_id")
    left = total - int(taken.sum())
    groups = max(1, -(-left // GROUP))
    rest = rest.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    packed = save(rest.groupBy("group").applyInPandas(greedy(window), PIECES + ", group int, bin long"), "pack-rest")
    sizes = packed.groupBy("group").agg((F.max("bin") + 1).alias("bins"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("group", (F.coalesce(F.sum("bins").over(before), F.lit(0)) + sequence).alias("first"))
    packed = packed.join(sizes, "group").withColumn("sequence_id", F.col("first") + F.col("bin"))
    names = PLACED.replace(" long", "").split(", ")
    every = own.where("sequence_id IS NOT NULL").select(*names).unionByName(packed.select(*names))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "ids_crc32")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    cut = save(pieces(docs, tokenizer_path or default_path(), end_id, window), "pack-pieces")
    return pack(cut, window)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents; a row per piece."""
    return pack_documents(table(spark, sf_dir, "documents"))
