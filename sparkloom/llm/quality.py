"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Words and pairs of neighbouring words of the whole text are hashed into a fixed number of dimensions. Training takes a
bounded, seeded sample of labelled rows and streams it through one task that holds nothing but the model; scoring is a
sparse dot product for each document on all executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, as_bytes, documents, held_out, training_row

DIMENSION_BITS = 18
#: Labelled rows to learn from, at most, and how often each is shown.
TRAINING_ROWS, EPOCHS = 8192, 2
#: Learning rate, its smoothing, and the two penalties of the per-coordinate updates.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
FOLDS = 3
#: Odd multipliers of the pair hash (fixed values).
LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and values of a text: log-scaled counts of its words and word pairs, of length 1, and a constant in dimension 0."""
    import xxhash

    words = (text or b"").lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    shift = np.uint64(64 - DIMENSION_BITS)
    pairs = (hashes[:-1] * LEFT) ^ (hashes[1:] * RIGHT + LEFT)
    # pairs of equal words count as one kind of pair too, whatever the word
    twice = np.full(np.count_nonzero(hashes[:-1] == hashes[1:]), RIGHT)
    found, counts = np.unique(np.concatenate([hashes, pairs * RIGHT, twice]) >> shift, return_counts=True)
    values = np.log1p(counts)
    if len(values):
        values /= np.sqrt(values @ values)
    found = np.concatenate([[0], found.astype(np.int64)])
    return found, np.concatenate([[1.0], values])


class FollowTheLeader:
    """Logistic regression with per-coordinate follow-the-regularised-leader updates."""

    def __init__(self, dimensions: int = 1 << DIMENSION_BITS):
        self.z, self.n = np.zeros(dimensions), np.zeros(dimensions)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = (sigmoid(float(w @ values)) - label) * values
        squared = gradient * gradient
        step = (np.sqrt(self.n[at] + squared) - np.sqrt(self.n[at])) / ALPHA
        # dimension 0 may stand twice; ufunc.at adds both
        np.add.at(self.z, at, gradient - step * w)
        np.add.at(self.n, at, squared)


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -500.0, 500.0))))


def train(sample: DataFrame, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from ``sample`` (place long, label int, text); rows are shown in the order of place, in each epoch."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in as_bytes(batch.column(2))]
            packed = [[x.astype(t).tobytes() for x in column] for column, t in zip(zip(*found), ("<i4", "<f4"))] or [[], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in packed)], names=["place", "label", "at", "values"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = FollowTheLeader()
        for batch in batches:
            for label, at, values in zip(*(batch.column(i).to_pylist() for i in range(3))):
                model.learn(np.frombuffer(at, "<i4"), np.frombuffer(values, "<f4").astype(float), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).astype("<f4").tobytes()])], names=["weights"])

    rows = sample.select("place", "label", "text").mapInArrow(extract, "place long, label int, at binary, values binary")
    shown = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).repartition(1).sortWithinPartitions("epoch", "place")
    model = shown.select("label", "at", "values").mapInArrow(follow, "weights binary").first()
    # Spark runs nothing over an empty table
    return np.frombuffer(model["weights"], "<f4") if model else np.zeros(1 << DIMENSION_BITS, "<f4")


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """(place, label, text): up to ``most`` rows of ``docs`` that are labelled and not held out, drawn by a hash of doc_id.

    Rows with a null label or id are left out; a document with several labels has the one that most of its labels have, 1
    at a tie.
    """
    one = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = one.agg((F.avg("quality") >= 0.5).cast("int").alias("label")).where(training_row(F.col("doc_id"), FOLDS))
    drawn = one.select("doc_id", "label", F.xxhash64("doc_id").alias("place")).orderBy("place", "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a few thousand rows of three numbers, whatever the input's size
    return texts.join(F.broadcast(drawn), "doc_id").select("place", "label", "text")


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) for each row of ``docs``, 0 to 1. A null or empty text has the model's constant alone."""
    held = docs.sparkSession.sparkContext.broadcast(weights)  # of a fixed size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            scores = [sigmoid(float(w[at] @ values)) for at, values in map(features, as_bytes(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return arrow_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Learns from labelled rows whose crc32 of doc_id doesn't leave 1 over 3. Nothing but the text enters a score. Without
    any such row all scores are 0.5. Repeated rows are scored alike; rows with a null doc_id are scored, not learned from.
    """
    weights = train(labelled_sample(docs, labels, most))
    scored = score_quality(docs, weights)
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
