"""Mixing sources to target weights (Efraimidis-Spirakis sampling).

A document of weight w gets the exponential key ``-ln(u) / w`` with u in (0, 1)
hashed from its id and text: in ascending key order, a source's documents are a
weighted sample without replacement. A source's token target is met by whole
epochs of all its documents first; what is left is a prefix of that order, found
by prefix sums: the documents in order are taken once more while their sum stays
within the rest. The gap that remains is filled by the one later document whose
size is next to it, if that lessens the miss. Keys depend on content only, so
reruns agree.

Prefix sums are made in two levels: keys are cut into BUCKETS ranges within each
source, range totals are summed in key order, and only the one range in which the
target falls is summed document by document. So a source that holds a third of
all rows is never sorted in one task.

Targets: sources get shares of the budget by weight; a target stops at
``max_epochs`` times its source's size and the excess is reshared by weight until
none is above. That is a level L with target = min(cap, L * weight).

Cases: a null text has size 0; a null source is a source of its own, after all
others; documents of size 0 are taken as often as whole epochs say, with 0 words;
rows of equal id and text have equal keys and are taken or left together; null or
non-positive weights count as the least weight; an empty table gives no rows;
other columns pass through ``mix``. Columns that it adds must not be there:
``mix`` names them with a ``_mix_`` prefix and drops them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, table

BUCKETS = 2048
LEAST_WEIGHT = 1e-3
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 20


def word_count(text: Column) -> Column:
    r"""How often ``[^\x20\x09-\x0D]+`` matches; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of characters that are neither digits nor ASCII symbols."""
    n = F.greatest(F.length(text), F.lit(1))
    bad = n - F.length(F.regexp_replace(text, r"[!-+/-@\[-`{-~]+", ""))
    return F.coalesce(1 - 0.9 * bad / n, F.lit(0.1))


def exponential_key(weight: Column, *identity: Column, seed: int = SEED) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *identity), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(LEAST_WEIGHT))


def measure(docs: DataFrame, size: Column, weight: Column, *identity: Column) -> DataFrame:
    """The documents with _mix_size and _mix_key."""
    return docs.withColumns({"_mix_size": size, "_mix_key": exponential_key(weight, *identity)})


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: float = 1.0) -> DataFrame:
    """source, source_size, target of a table source, source_size; sources take the weights in turn by code point, null last."""
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("nth") - 1, F.lit(len(weights))).cast("int") + 1)
    own = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    own = own.withColumn("w", turn).withColumn("cap", F.col("source_size") * float(max_epochs))
    filled = Window.orderBy(F.col("cap") / F.col("w"), "nth")
    every = Window.partitionBy()
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rest = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # With the sources in ascending order of cap / weight, the level that would hold if just those before this one were capped.
    level = (F.sum("source_size").over(every) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    own = own.withColumn("level", level)
    # The true level is that of the first source which it does not cap; if it caps all, there is none.
    own = own.withColumn("found", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "nth", "level"))).over(every))
    target = F.least(F.col("cap"), F.coalesce(F.col("found.level") * F.col("w"), F.col("cap")))
    return own.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def plan(measured: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: float = 1.0) -> DataFrame:
    """One row per source: source, source_size, target, epochs, last_key (documents up to this key are taken once more; null: none), fill_key (so is that of this key).

    ``measured``: source, _mix_size, _mix_key; best a saved table, as it is read again and again.
    """
    bucket = F.least((F.lit(BUCKETS) * (1 - F.exp(-F.col("_mix_key")))).cast("int"), F.lit(BUCKETS - 1))
    keyed = measured.select("source", "_mix_size", "_mix_key", bucket.alias("bucket"))
    ranges = save(
        keyed.groupBy("source", "bucket").agg(F.sum("_mix_size").alias("words"), F.max("_mix_key").alias("top")),
        "mix-ranges",
    )
    goal = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs, budget)
    goal = goal.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    )
    goal = save(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-goals")
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    based = ranges.withColumn("base", F.coalesce(F.sum("words").over(order), F.lit(0)))
    g = goal.select(F.col("source").alias("_s"), "rest")
    based = based.join(g, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    done = F.max(F.struct(F.col("base") + F.col("words"), "top")).alias("last")
    full = based.where(F.col("base") + F.col("words") <= F.col("rest")).groupBy("source").agg(done)
    cut = based.where((F.col("base") < F.col("rest")) & (F.col("base") + F.col("words") > F.col("rest")))
    cut = cut.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "base", "rest")
    inner = keyed.join(cut, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    by_key = inner.groupBy("source", F.col("_mix_key").alias("top")).agg(
        F.sum("_mix_size").alias("words"), F.first("base").alias("base"), F.first("rest").alias("rest")
    )
    order = Window.partitionBy("source").orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    by_key = by_key.withColumn("base", F.col("base") + F.coalesce(F.sum("words").over(order), F.lit(0)))
    part = by_key.where(F.col("base") + F.col("words") <= F.col("rest")).groupBy("source").agg(done)
    last = full.unionByName(part).groupBy("source").agg(F.max("last").alias("last"))
    last = last.select(F.col("source").alias("_s"), F.col("last.col1").alias("more"), F.col("last.top").alias("last_key"))
    goal = goal.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    goal = save(goal.withColumn("gap", F.col("rest") - F.coalesce("more", F.lit(0))).drop("rest", "more"), "mix-prefix")
    # Of the documents behind the prefix, the one whose size is next to the gap fills it.
    g = goal.where("gap > 0").select(F.col("source").alias("_s"), "gap", "last_key")
    behind = keyed.join(g, F.col("source").eqNullSafe(F.col("_s"))).where("last_key IS NULL OR _mix_key > last_key")
    miss = F.abs(F.col("_mix_size") - F.col("gap"))
    fill = behind.where(miss < F.col("gap")).groupBy("source").agg(F.min(F.struct(miss, "_mix_key"))["_mix_key"].alias("fill_key"))
    fill = fill.withColumnRenamed("source", "_s")
    return goal.join(fill, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "gap")


def copies(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """The measured documents with _mix_copies, _mix_source_size and _mix_target.

    The plan has a row per source and is a saved table, so Spark broadcasts it only if it is small enough by its settings.
    """
    p = planned.select(
        F.col("source").alias("_mix_source"),
        F.col("source_size").alias("_mix_source_size"),
        F.col("target").alias("_mix_target"),
        F.col("epochs").alias("_mix_epochs"),
        F.col("last_key").alias("_mix_last"),
        F.col("fill_key").alias("_mix_fill"),
    )
    found = docs.join(p, F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source")
    once_more = (
        F.coalesce(F.col("_mix_key") <= F.col("_mix_last"), F.lit(False)) | F.coalesce(F.col("_mix_key") == F.col("_mix_fill"), F.lit(False))
    ).cast("int")
    return found.withColumn("_mix_copies", F.col("_mix_epochs") + once_more).drop("_mix_epochs", "_mix_last", "_mix_fill")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: float = 1.0, seed: int = SEED) -> DataFrame:
    """The documents (doc_id, text, source and others), each repeated as often as the mix takes it."""
    size, weight = word_count(F.col("text")), quality_weight(F.col("text"))
    measured = measure(docs, size, weight, F.col("doc_id"), F.col("text"))
    small = save(measured.select("source", "_mix_size", "_mix_key"), "mix-sizes")
    found = copies(measured, save(plan(small, weights, max_epochs, budget), "mix-plan"))
    found = found.where(F.col("_mix_copies") > 0)
    return found.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*[docs[c] for c in docs.columns])


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = measure(docs, word_count(F.col("text")), quality_weight(F.col("text")), F.col("doc_id"), F.col("text"))
    small = save(measured.select("doc_id", "source", "_mix_size", "_mix_key"), "mix-sizes")
    found = copies(small, save(plan(small), "mix-plan"))
    return found.select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"),
        F.col("_mix_copies").alias("copies"),
        "source",
    )
