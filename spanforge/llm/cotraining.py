"""Quality classifier by co-training of two views.

One view sees a text's content (hashed byte trigrams and word repetition), the other
the page's metadata (language, source, declared length, line layout and character
classes). Each is a logistic regression. In every round each view scores all
documents; unlabelled ones of which it is sure become pseudo-labels for the *other*
view, which is fitted anew. In the end each view's logit is calibrated on held-out
labelled documents, a logistic combination of both is fitted there, and all
documents are scored.

Fitting is bounded by parameters: MOST_LABELLED labelled documents and MOST_PSEUDO
pseudo-labels per class, view and round, the first ones by a hash of the id among
all documents. Only those rows' features go to the driver; scoring is done where
the documents are.

Cases: a null text is empty; null language, source or length count as values of
their own; of repeated labels of an id the lower counts; null labels are dropped;
if the labels lack one of both classes, every document gets the share of good ones
(1 without any labels) as its score; rows of equal id are scored each; an empty
table gives no rows; other columns pass through ``score_documents``, whose own
start with ``_quality``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import save, table

CONTENT, META = 258, 40
MOST_LABELLED, MOST_PSEUDO, ROUNDS = 12_000, 2_000, 3
SURE = 0.98
HELD_OUT = 5
#: Low, so that clean documents stay.
KEEP_FROM = 0.2
FEATURES = "doc_id long, content binary, meta binary"


def byte_classes() -> np.ndarray:
    """0 other signs, 1 lower, 2 upper, 3 digit, 4 blank, 5 newline, 6 point or comma, 7 beyond ASCII."""
    found = np.zeros(256, dtype=np.int64)
    for chars, c in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t", 4), (b"\n", 5), (b".,", 6)):
        found[list(chars)] = c
    found[128:] = 7
    return found


CLASSES = byte_classes()


def features(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    content = np.zeros(CONTENT, dtype=np.float32)
    if len(raw) > 2:
        b = raw.astype(np.uint32)
        mixed = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        content[:256] = np.sqrt(np.bincount(mixed >> np.uint32(24), minlength=256) / (len(raw) - 2))
    words = (text or "").split()
    content[256] = len(set(words)) / max(len(words), 1)
    content[257] = min(np.log1p(len(words)), 16.0) / 16
    meta = np.zeros(META, dtype=np.float32)
    meta[zlib.crc32(repr(lang).encode()) % 8] = 1
    meta[8 + zlib.crc32(repr(source).encode()) % 16] = 1
    meta[24] = np.log1p(max(n_chars or 0, 0)) / 16
    meta[25] = n_chars is None
    counts = np.bincount(CLASSES[raw], minlength=8)
    meta[26:34] = counts / max(len(raw), 1)
    lines = counts[5] + 1
    meta[34] = np.log1p(lines) / 8
    meta[35] = np.log1p(len(raw) / lines) / 16
    meta[36] = np.log1p(len(raw) / max(len(words), 1)) / 8
    meta[37] = counts[2] / max(counts[1] + counts[2], 1)
    meta[38] = counts[0] / max(len(words), 1)
    return content, meta


def column(batch: pa.RecordBatch, name: str) -> list:
    i = batch.schema.get_field_index(name)
    return batch.column(i).to_pylist() if i >= 0 else [None] * batch.num_rows


def batch_features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    rows = zip(*(column(batch, n) for n in ("text", "lang", "source", "n_chars")), strict=True)
    both = [features(*r) for r in rows]
    if not both:
        return np.zeros((0, CONTENT), np.float32), np.zeros((0, META), np.float32)
    return np.stack([c for c, _ in both]), np.stack([m for _, m in both])


def packed(values: np.ndarray) -> np.ndarray:
    """Features lie in 0..1 but for a few above; two bytes each are plenty."""
    return np.minimum(np.round(values * 16384), 65535).astype("<u2")


def unpacked(column_: pa.Array, width: int) -> np.ndarray:
    raw = b"".join(column_.to_pylist())
    return (np.frombuffer(raw, "<u2").astype(np.float32) / 16384).reshape(-1, width)


def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        content, meta = (packed(x) for x in batch_features(batch))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x.tobytes() for x in content], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())],
            names=["doc_id", "content", "meta"],
        )


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights and intercept, by Newton steps; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class Model:
    """Scales and weights of both views, their calibration, and the combination; or a constant."""

    content: np.ndarray | None = None
    meta: np.ndarray | None = None
    calibration: tuple | None = None
    combination: np.ndarray | None = None
    constant: float = 1.0

    def views(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = [logits(content, self.content), logits(meta, self.meta)]
        if self.calibration is not None:
            z = [np.clip(a * x + b, -30, 30) for x, (a, b) in zip(z, self.calibration, strict=True)]
        return z[0], z[1]

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.content is None:
            return tuple(np.full(len(content), self.constant) for _ in range(3))
        a, b = self.views(content, meta)
        return sigmoid(a), sigmoid(b), sigmoid(logits(np.stack([a, b], 1), self.combination))


def view_scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, m = unpacked(batch.column(1), CONTENT), unpacked(batch.column(2), META)
            found = model.scores(c, m)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x.astype(np.float64)) for x in found]], names=["doc_id", "content_score", "meta_score", "score"])

    return score


def pseudo_picker(model: Model):
    """Rows of which a view is sure: view, label, and all features."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, m = unpacked(batch.column(1), CONTENT), unpacked(batch.column(2), META)
            for view, z in enumerate(model.views(c, m)):
                p = sigmoid(z)
                for label, at in ((1, np.flatnonzero(p >= SURE)), (0, np.flatnonzero(p <= 1 - SURE))):
                    if len(at):
                        own = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays(
                            [*own.columns, pa.array(np.full(len(at), view, np.int32)), pa.array(np.full(len(at), label, np.int32))],
                            names=["doc_id", "content", "meta", "view", "label"],
                        )

    return pick


def document_scorer(model: Model, columns: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(*batch_features(batch))[2]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.float64))], names=[*columns, "_quality_score"])

    return score


def feature_table(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    wanted = [F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    return save(docs.select(*wanted).mapInArrow(featurise, FEATURES), "quality-features")


def by_hash(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(n)


def arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
    un = lambda name, width: (np.frombuffer(b"".join(r[name] for r in rows), "<u2").astype(np.float32) / 16384).reshape(-1, width)
    return un("content", CONTENT), un("meta", META)


def fit(found: DataFrame, labels: DataFrame, rounds: int = ROUNDS, most_labelled: int = MOST_LABELLED, most_pseudo: int = MOST_PSEUDO) -> Model:
    """A model from a feature table (saved) and labels doc_id, label (0 or 1)."""
    labels = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    labels = labels.join(found.select("doc_id"), "doc_id", "left_semi")
    sample = save(by_hash(labels, most_labelled), "quality-sample")
    # At most most_labelled rows.
    rows = found.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 1.0)
    content, meta = arrays(rows)
    held = np.array([zlib.crc32(str(r["doc_id"]).encode()) % HELD_OUT == 0 for r in rows])
    if min(np.bincount(y[held].astype(int), minlength=2).min(), np.bincount(y[~held].astype(int), minlength=2).min()) == 0:
        held[:] = False
    train = ~held if held.any() else np.ones(len(y), bool)
    held = held if held.any() else train
    extra: dict[int, tuple] = {0: None, 1: None}
    model = Model()
    unlabelled = found.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")
    for round_ in range(rounds + 1):
        fitted = []
        for view, own in enumerate((content, meta)):
            x, t = own[train], y[train]
            if extra[view] is not None:
                x, t = np.vstack([x, extra[view][0]]), np.concatenate([t, extra[view][1]])
            fitted.append(fit_logistic(x, t))
        model = Model(content=fitted[0], meta=fitted[1])
        if round_ == rounds:
            break
        sure = save(unlabelled.mapInArrow(pseudo_picker(model), FEATURES + ", view int, label int"), "quality-sure")
        for view in (0, 1):
            picked = []
            for label in (0, 1):
                picked += by_hash(sure.where((F.col("view") == 1 - view) & (F.col("label") == label)), most_pseudo).collect()
            if picked:
                extra[view] = (arrays(picked)[view], np.array([r["label"] for r in picked], dtype=np.float64))
    z = model.views(content[held], meta[held])
    calibrated = [fit_logistic(x[:, None], y[held], ridge=1e-3) for x in z]
    model.calibration = tuple((float(max(c[0], 0.0)), float(c[1])) for c in calibrated)
    model.combination = fit_logistic(np.stack(model.views(content[held], meta[held]), 1), y[held], ridge=1e-1)
    return model


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))


def score_features(found: DataFrame, model: Model) -> DataFrame:
    return found.mapInArrow(view_scorer(model), "doc_id long, content_score double, meta_score double, score double")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with _quality_score."""
    ship_package(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("_quality_score", T.DoubleType())])
    return docs.mapInArrow(document_scorer(model, docs.columns), schema)


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all documents, and whether they stay."""
    found = feature_table(table(spark, sf_dir, "documents"))
    scored = score_features(found, fit(found, quality_labels(spark, sf_dir)))
    return scored.withColumn("keep", F.col("score") >= KEEP_FROM)
