"""Index maintenance from a change stream, in versions.

A store keeps documents in hash buckets. Every committed batch rewrites only the
buckets that it touches, as a new version, and appends one commit row: version, batch,
the bucket's versions and the sequence numbers seen by shard. Readers open the last
commit, or an earlier one. A batch that was committed is skipped when it comes again,
and records at or below a shard's sequence number are dropped as duplicates, so
replays change nothing. After a rollback the feed has to be replayed from the older
sequence numbers: batches come again from the next one or, of a new feed, from 0; a later
one is refused, as what lies between would be lost. Files of a version that was never committed are never read.
"""

from __future__ import annotations

import time
from collections.abc import Mapping
from enum import StrEnum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

UPSERT, DELETE, EXPIRE = "upsert", "delete", "expire"
COMMITS = "version long, batch long, buckets map<int,long>, seqnos map<int,long>, rolled boolean"


class Consistency(StrEnum):
    ANY = "any"
    SESSION = "session"
    AT_LEAST = "at_least"
    STRICT = "strict"


class NotConsistent(RuntimeError):
    pass


def as_recent(have: Mapping[int, int], want: Mapping[int, int]) -> bool:
    """Has every shard that is asked for come that far?"""
    return all(have.get(shard, 0) >= seqno for shard, seqno in want.items())


def union(a: Mapping[int, int], b: Mapping[int, int]) -> dict[int, int]:
    return {s: max(a.get(s, 0), b.get(s, 0)) for s in a.keys() | b.keys()}


def new_records(changes: DataFrame, seen: Mapping[int, int]) -> DataFrame:
    """Records above each shard's sequence number."""
    if not seen:
        return changes
    marks = changes.sparkSession.createDataFrame([(int(s), int(n)) for s, n in seen.items()], "shard int, _seen long")
    # A row for each shard; their number is a setting of the source.
    marked = changes.join(F.broadcast(marks), "shard", "left")
    return marked.where(F.col("seqno") > F.coalesce("_seen", F.lit(-1))).drop("_seen")


def latest(changes: DataFrame) -> DataFrame:
    """One final record for each document: the one of the greatest sequence number."""
    last = F.max_by(F.struct("op", "doc"), F.struct("seqno", "shard"))
    return changes.groupBy("doc_id").agg(last.alias("c")).select("doc_id", "c.op", "c.doc")


def apply_changes(state: DataFrame, changes: DataFrame, keep: Column | None = None) -> DataFrame:
    """doc_id, doc after a batch. ``keep``: a condition under which a deleted document stays (as a tombstone)."""
    final = latest(changes)
    put = F.col("op") == UPSERT
    if keep is not None:
        put = put | F.coalesce(keep, F.lit(False))
    changed = final.select(F.col("doc_id").alias("_changed"))
    return state.join(changed, F.col("doc_id").eqNullSafe(F.col("_changed")), "left_anti").unionByName(final.where(put).select("doc_id", "doc"))


class Store:
    """Versions of a document table below ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], COMMITS)

    def head(self, version: int | None = None):
        """The last commit, or one version's; None if there is none."""
        found = self.commits()
        found = found if version is None else found.where(F.col("version") == version)
        return found.orderBy(F.desc("version")).limit(1).first()

    def seqnos(self) -> dict[int, int]:
        head = self.head()
        return dict(head["seqnos"] or {}) if head else {}

    def _commit(self, version: int, batch: int, buckets: Mapping[int, int], seqnos: Mapping[int, int], rolled: bool = False) -> None:
        row = self.spark.createDataFrame([(version, batch, dict(buckets), dict(seqnos), rolled)], COMMITS)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def _open(self, buckets: Mapping[int, int], only: set[int] | None = None) -> DataFrame | None:
        paths = [f"{self.root}/version={v}/bucket={b}" for b, v in sorted(buckets.items()) if only is None or b in only]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self, version: int | None = None) -> DataFrame:
        """doc_id, doc of a version."""
        head = self.head(version)
        found = self._open(head["buckets"] or {}) if head else None
        return self.spark.createDataFrame([], "doc_id string, doc string") if found is None else found

    def commit(self, changes: DataFrame, batch: int, ordered: bool = True) -> int | None:
        """Applies a batch of change records; returns the version, or None if there was nothing new.

        ``ordered`` False is for a backfill whose records come out of order: sequence numbers don't filter.
        """
        head = self.head()
        last = head["batch"] if head else -1
        if head is not None and ordered and batch >= 0:
            if head["rolled"]:
                if batch > max(0, last + 1):
                    raise NotConsistent(f"batch {batch} after a rollback to batch {last}: replay what lies between")
                # A new feed may count anew; its old records are told by their sequence numbers.
                last = -1
            elif batch <= last:
                return None
        seen = dict(head["seqnos"] or {}) if head else {}
        fresh = (new_records(changes, seen) if ordered else changes).withColumn("bucket", self._bucket()).persist()
        try:
            marks = {r["shard"]: r["n"] for r in fresh.groupBy("shard").agg(F.max("seqno").alias("n")).collect()}
            touched = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}
            if not touched:
                return None
            version = head["version"] + 1 if head else 1
            buckets = dict(head["buckets"] or {}) if head else {}
            old = self._open(buckets, touched)
            final = fresh.drop("bucket")
            if old is None:
                after = latest(final).where(F.col("op") == UPSERT).select("doc_id", "doc")
            else:
                after = apply_changes(old, final)
            after = after.withColumn("bucket", self._bucket())
            after.repartition("bucket").sortWithinPartitions("doc_id").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/version={version}")
            left = {r["bucket"] for r in self.spark.read.parquet(f"{self.root}/version={version}").select("bucket").distinct().collect()} if not after.isEmpty() else set()
            for b in touched:
                buckets.pop(b, None)
            buckets |= dict.fromkeys(left, version)
            self._commit(version, max(batch, last), buckets, union(seen, marks))
            return version
        finally:
            fresh.unpersist()

    def rollback(self, version: int) -> int:
        """Makes an earlier version the last one. The feed has to go on from its sequence numbers (``seqnos``)."""
        old, head = self.head(version), self.head()
        if old is None:
            raise ValueError(f"no version {version}")
        self._commit(head["version"] + 1, old["batch"], old["buckets"] or {}, old["seqnos"] or {}, rolled=True)
        return head["version"] + 1

    def snapshot(self, consistency: Consistency = Consistency.ANY, seqnos: Mapping[int, int] | None = None, query: StreamingQuery | None = None, wait_s: float = 0.0) -> DataFrame:
        """Documents of a version that is recent enough, waiting for the stream if there is one."""
        if consistency == Consistency.ANY:
            return self.read()
        if consistency == Consistency.STRICT and seqnos is None and query is not None:
            query.processAllAvailable()
            return self.read()
        until = time.monotonic() + wait_s
        while not as_recent(self.seqnos(), seqnos or {}):
            if query is not None and query.isActive:
                query.processAllAvailable()
                query = None
                continue
            if time.monotonic() >= until:
                raise NotConsistent(f"asked for {dict(seqnos or {})}, have {self.seqnos()}")
            time.sleep(0.2)
        return self.read()

    def maintain(self, changes: DataFrame, checkpoint: str, trigger_s: float | None = None) -> StreamingQuery:
        """Starts the stream: every micro-batch is one commit."""
        writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: self.commit(df, batch) and None)
        return (writer.trigger(availableNow=True) if trigger_s is None else writer.trigger(processingTime=f"{trigger_s} seconds")).start()
