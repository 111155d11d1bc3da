"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Every class has a Gaussian with its own covariance, shrunk towards the pooled one and its diagonal.
A text's score is the logistic of the difference of the class log densities (Mahalanobis terms
from Cholesky factors that are computed once) and the prior. Class sums come from all labelled rows by
distributed partial sums; only one row per class and moment reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, importable, materialize, table

#: Byte classes whose share of the text is a feature.
BYTE_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b"#$%&*@^~<>{}[]\\+=_/",
    b"!?",
    b".,;:",
    b"\n",
    b"|",
    bytes(range(128, 256)),
)
FEATURES = 5 + len(BYTE_CLASSES)
#: Shares enter as log(share + FLOOR).
FLOOR = 2e-3
#: Weights of the pooled covariance and of its diagonal in a class covariance.
SHRINK, DIAGONAL = 0.1, 0.02
#: Weight of the prior: of that many rows, half of each class, added to the class counts.
PRIOR_ROWS = 2.0

_MASKS = np.zeros((256, len(BYTE_CLASSES)))
for _k, _c in enumerate(BYTE_CLASSES):
    _MASKS[list(_c), _k] = 1


def text_features(text: str) -> np.ndarray:
    """Transformed statistics of one whole text; the empty text has those of no bytes and no words."""
    raw = text.encode()
    words = text.split()
    n, w = max(1, len(raw)), max(1, len(words))
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _MASKS / n
    out = np.empty(FEATURES)
    out[0] = np.log1p(len(words))
    out[1] = np.log(n / w)
    out[2] = np.log(len(set(words)) + 1) / np.log(w + 1.0)
    out[3] = np.log(sum(map(eq, words, words[1:])) / w + FLOOR)
    out[4] = np.log(max(map(len, words), default=0) + 1)
    out[5:] = np.log(shares + FLOOR)
    return out


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log constants of the classes 0 and 1."""

    means: np.ndarray
    whiten: np.ndarray
    offsets: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float = SHRINK, diagonal: float = DIAGONAL) -> Discriminant:
        """From the number of rows, the sums and the sums of outer products of each class.

        A class without rows takes the pooled moments; without any rows all scores are 0.5.
        """
        d = sums.shape[1]
        if not counts.sum():
            return cls(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
        whole_mean = sums.sum(0) / counts.sum()
        means = np.array([s / n if n else whole_mean for n, s in zip(counts, sums, strict=True)])
        scatter = np.array([q - n * np.outer(m, m) for n, q, m in zip(counts, squares, means, strict=True)])
        pooled = scatter.sum(0) / max(1.0, counts.sum() - 2)
        spread = np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        whiten, offsets = [], []
        for n, s in zip(counts, scatter, strict=True):
            own = s / (n - 1) if n > 1 else pooled
            factor = np.linalg.cholesky((1 - shrink - diagonal) * own + shrink * pooled + diagonal * spread)
            whiten.append(np.linalg.inv(factor))
            offsets.append(np.log((n + PRIOR_ROWS / 2) / (counts.sum() + PRIOR_ROWS)) - np.log(np.diag(factor)).sum())
        return cls(means, np.array(whiten), np.array(offsets))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of x."""
        log = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, o in zip(self.means, self.whiten, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


def featurize(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and x, the features of the whole text."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [text_features(t.as_py() or "") for t in batch.column("text")]
            flat = np.concatenate(x) if x else np.empty(0)
            arrays = [batch.column("doc_id"), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, FEATURES, dtype=np.int32), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(bounded(run), "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from the fit: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def class_moments(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of outer products of x by label (0 or 1), over all rows (x, label)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(2), np.zeros((2, FEATURES + FEATURES**2))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                total[k, :FEATURES] += own.sum(0)
                total[k, FEATURES:] += (own.T @ own).ravel()
        size = 1 + total.shape[1]
        label, at = np.repeat([0, 1], size), np.tile(np.arange(size), 2)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(at, pa.int32()), pa.array(np.column_stack([n, total]).ravel())], ["label", "at", "v"])

    sums = labelled.mapInArrow(bounded(partial), "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v"))
    moments = np.zeros((2, 1 + FEATURES + FEATURES**2))
    for r in sums.collect():  # two classes times the number of moments
        moments[r["label"], r["at"]] = r["v"]
    return moments[:, 0], moments[:, 1 : 1 + FEATURES], moments[:, 1 + FEATURES :].reshape(2, FEATURES, FEATURES)


def fit_quality(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """The classes' Gaussians from all labelled rows that are not held out."""
    train = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    return Discriminant.fit(*class_moments(features.join(train.where(~held_out(F.col("doc_id"))), "doc_id").select("x", "label")))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Returns a row for each row of docs: doc_id, held_out, score, predicted.

    * Learns from all rows of labels with a label of 0 or 1 whose id is not held out; other labels,
      null ids and ids that docs does not have are left out. Rows that repeat count as often as they
      occur. Nothing but the text enters a score.
    * A null text is the empty text and is scored like any other. A null id is not held out.
    * Without labelled rows every score is 0.5; with one class only, both classes share its moments.
    * predicted is 1 where score >= 0.5, ties at 0.5 included. An empty table gives an empty result; columns
      of docs other than id and text are not read, whatever their names. Whole texts are read, of any length.
    """
    features = materialize(featurize(docs, id_col, text_col), "quality-features")
    model = fit_quality(features, labels, id_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            score = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = features.mapInArrow(bounded(run), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs that score_quality() predicts as 1, with all their columns; texts are not shuffled.

    Nulls, empty texts, repeated rows and labels are as there; without labelled rows all rows stay. Whole texts
    are read, of any length, one Arrow batch at a time. An empty table gives an empty result.
    """
    model = fit_quality(featurize(docs, id_col, text_col), labels, id_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([text_features(t.as_py() or "") for t in batch.column(text_col)])
                yield batch.filter(pa.array(model.scores(x) >= 0.5))

    return docs.mapInArrow(bounded(run), docs.schema)


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents, fitted on the labels that are not held out."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
