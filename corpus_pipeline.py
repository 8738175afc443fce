"""The corpus pipeline: documents are classified, deduplicated by line and by n-grams, mixed and packed.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next one's ``docs``. All but the last
return the columns of ``docs``; the last returns the pieces of packed sequences.

SQL can't express the stages (trained models, hashes); tests hold each stage against
a brute-force version or what it promises.
"""

from __future__ import annotations

import functools
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import cotraining, linededup, mixing, ngramjoin, packing
from spanforge.llm.common import free_prefix, new_folder, noting, remove, table


#: What the last stage of each run saved for itself, by run.
_saved: dict[str, list[str]] = {}
#: The run that stages belong to; where they are called by themselves, it is that over their tables.
_run: ContextVar[str | None] = ContextVar("run", default=None)


def staged(function):
    """A stage first removes the tables that the run's stage before saved for itself: that stage's result is written."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run_id = _run.get() or sf_dir
        remove(spark, _saved.pop(run_id, []))
        with noting(_saved.setdefault(run_id, [])):
            return function(spark, docs, sf_dir)

    return run_stage


@staged
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    model = cotraining.fit(cotraining.feature_table(docs), cotraining.quality_labels(spark, sf_dir))
    scored = cotraining.score_documents(docs, model)
    return scored.where(F.col("_quality_score") >= cotraining.KEEP_FROM).select(*docs.columns)


@staged
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without fuzzy copies of lines; those with no words left go. n_chars follows the text."""
    found = linededup.dedup_lines(docs, drop_empty=True, tidy=True)
    gone = f"{free_prefix(docs.columns, '_line')}_gone"
    n_chars = F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(*docs.columns)


@staged
def ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    return ngramjoin.one_of_each(docs)


@staged
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


@staged
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("ngrams", ngrams), ("mix", mix), ("pack", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    run_id = uuid.uuid4().hex
    token = _run.set(run_id)
    try:
        docs, before = table(spark, sf_dir, "documents"), None
        for name, stage in STAGES:
            made = stage(spark, docs, sf_dir)
            path = new_folder(spark, f"stage-{name}")
            made.write.parquet(path)
            docs = spark.read.schema(made.schema).parquet(path)
            if before:
                remove(spark, [before])
            before = path
        remove(spark, _saved.pop(run_id, []))
        return docs
    finally:
        _run.reset(token)
