"""What the operators share: the shared folder, saved tables, ranges of an ordered column."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new one where it is unset (tests)."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spanforge.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanforge-")
        spark.conf.set("spanforge.shared.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Where ``save`` notes what it wrote (in this thread of work), if anyone is to remove it.
_saved: ContextVar[list[str] | None] = ContextVar("saved", default=None)


#: Spark's setting: a query's shuffle files go when it ends, and not when the driver next collects garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts lineage, so that lost executors cost no recomputation.

    Nothing but the table is left on disk: what was shuffled for it goes.
    """
    path, conf = new_folder(df.sparkSession, name), df.sparkSession.conf
    if (noted := _saved.get()) is not None:
        noted.append(path)
    before = conf.get(SHUFFLES_GO, "false")
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Adds the folders of tables saved meanwhile to ``paths``, for whoever removes them when results that need them are written."""
    token = _saved.set(paths)
    try:
        yield
    finally:
        _saved.reset(token)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_prefix(columns: list[str], prefix: str) -> str:
    """The prefix, with as many underscores before it as it takes for no column to start with it."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def wrapped(df: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept``, and all others in a struct ``row``, so that no name of theirs meets an operator's own."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in kept]
    # A struct needs a field.
    return df.select(F.struct(*rest or [F.lit(0).alias("none")]).alias("row"), *kept)


def unwrapped(df: DataFrame, columns: list[str], kept: list[str], more: dict[str, str]) -> DataFrame:
    """The ``columns`` of a table that was wrapped with ``kept``, in their order, and ``more``: names of added columns and what they hold."""
    own = [F.col(c) if c in kept else F.col("row").getField(c).alias(c) for c in columns]
    return df.select(*own, *(F.col(held).alias(name) for name, held in more.items()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, column: str, n: int) -> list:
    """At most n - 1 ascending values that cut a column into ranges of about equal row counts. Only that column is read."""
    if n < 2:
        return []
    at = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(column, at, F.lit(max(10_000, 20 * n))).alias("b")).first()["b"]
    return sorted(set(found or []))


def range_index(column: Column, bounds: list) -> Column:
    """How many of the bounds are at most the column's value, by binary search; null counts as above all."""
    if not bounds:
        return F.lit(0)
    values = F.array(*[F.lit(b) for b in bounds])
    steps = len(bounds).bit_length()
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        open_ = s["lo"] < s["hi"]
        right = open_ & (F.get(values, mid) <= column)
        return F.struct(
            F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(open_ & ~right, mid).otherwise(s["hi"]).alias("hi"),
        )

    found = F.aggregate(F.array(*[F.lit(i) for i in range(steps)]), start, halve, lambda s: s["lo"])
    return F.when(column.isNull(), F.lit(len(bounds))).otherwise(found)


FILTER_BITS = 1 << 22


def hash_filter(hashes: DataFrame, column: str) -> DataFrame:
    """A bit table of a column of 64-bit hashes: slot, bits; FILTER_BITS / 64 rows (1 MB) at most, however many hashes there are."""
    h = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    bit = F.expr(f"shiftleft(1L, cast({column} & 63L AS int))")
    return hashes.select(F.shiftright(h, 6).alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def may_hold(df: DataFrame, column: str, bits: DataFrame, inverse: bool = False) -> DataFrame:
    """The rows whose hash may be among those of the filter, or those whose hash is not."""
    slot = F.shiftright(F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1).cast("long")), 6)
    b = F.broadcast(bits.select(F.col("slot").alias("_slot"), F.col("bits").alias("_bits")))
    hit = (slot == F.col("_slot")) & (F.expr(f"shiftrightunsigned(_bits, cast({column} & 63L AS int)) & 1L") == 1)
    return df.join(b, hit, "left_anti" if inverse else "left_semi")
