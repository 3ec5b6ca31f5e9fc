"""Quality by nearest-neighbour voting over latent-semantic vectors.

A document's terms are hashed character trigrams and one term for words said
twice running; weighted terms are projected on the leading singular vectors of a
bounded labelled sample. Each document is compared with every labelled vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefit.llm.common import batch_of, draw, held_out, small_batches, table, texts

_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
_BLOCK = 1 << 20


@dataclass(frozen=True)
class Settings:
    """sample_per_label bounds the labelled rows that are fitted, for each label."""

    sample_per_label: int = 1024
    buckets_log2: int = 13
    dimensions: int = 64
    neighbours: int = 11
    sharpness: int = 8
    repeat_weight: float = 0.5

    @property
    def terms(self) -> int:
        return (1 << self.buckets_log2) + 1


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by term
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled x dimensions, unit length
    labels: np.ndarray


def term_counts(text: str | None, settings: Settings) -> np.ndarray:
    """Counts of hashed trigrams over the whole text, and of repeated words as a share of words."""
    raw = (text or "").encode()
    counts = np.zeros(settings.terms, np.float32)
    for at in range(0, len(raw), _BLOCK):
        part = np.frombuffer(raw[max(0, at - 2) : at + _BLOCK], np.uint8).astype(np.uint32)
        if len(part) >= 3:
            key = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
            key = (key * np.uint32(2654435761)) >> np.uint32(32 - settings.buckets_log2)
            counts[:-1] += np.bincount(key, minlength=settings.terms - 1)
    words = raw.split()
    if words:
        counts[-1] = sum(map(eq, words, words[1:])) / len(words)
    return counts


def weighted(counts: np.ndarray, weights: np.ndarray, settings: Settings) -> np.ndarray:
    """Unit rows of root relative frequency times weight, with the repeat term beside them."""
    body = np.sqrt(counts[:, :-1] / np.maximum(counts[:, :-1].sum(1, keepdims=True), 1)) * weights
    body /= np.maximum(np.linalg.norm(body, axis=1, keepdims=True), 1e-12)
    return np.hstack([body, settings.repeat_weight * np.sqrt(counts[:, -1:])])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """The model of at most sample_per_label rows of either label, drawn by the hash of doc_id.

    Labels other than 0 and 1, and rows without a document, are left out; None if nothing is left.
    """
    spark = docs.sparkSession
    small_batches(spark)
    drawn = [draw(labels.where(F.col("quality") == q).select("doc_id", "quality"), settings.sample_per_label, "doc_id") for q in (0, 1)]
    sample = docs.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [term_counts(t, settings) for t in texts(b, "text")]
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array([x.astype("<i4").tobytes() for x in at]), pa.array([r[x].astype("<f4").tobytes() for r, x in zip(rows, at, strict=True)])], ["quality", "at", "n"])

    found = sorted((r["quality"], bytes(r["at"]), bytes(r["n"])) for r in sample.mapInArrow(run, "quality int, at binary, n binary").collect())
    if not found:
        return None
    counts = np.zeros((len(found), settings.terms), np.float32)
    for i, (_, at, n) in enumerate(found):
        counts[i, np.frombuffer(at, "<i4")] = np.frombuffer(n, "<f4")
    weights = (np.log((1 + len(found)) / (1 + (counts[:, :-1] > 0).sum(0))) + 1).astype(np.float32)
    rows = weighted(counts, weights, settings).astype(np.float32)
    values, left = np.linalg.eigh((rows @ rows.T).astype(np.float64))
    keep = np.argsort(values)[::-1][: settings.dimensions]
    keep = keep[values[keep] > 1e-9]
    axes = (rows.T @ left[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    return Model(weights, axes, _unit(rows @ axes).astype(np.float32), np.array([q for q, _, _ in found], np.float32))


def vote(counts: np.ndarray, model: Model, settings: Settings) -> np.ndarray:
    """Scores of a block of documents from exact cosines with every labelled vector.

    A document that is like none of them gets 0: nothing speaks for it.
    """
    near = _unit(weighted(counts, model.weights, settings).astype(np.float32) @ model.axes) @ model.vectors.T
    k = min(settings.neighbours, near.shape[1])
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weight = np.clip(np.take_along_axis(near, at, 1), 0, 1).astype(np.float64) ** settings.sharpness
    return np.clip((weight * model.labels[at]).sum(1) / np.maximum(weight.sum(1), 1e-12), 0, 1)


def score(docs: DataFrame, model: Model | None, settings: Settings = Settings()) -> DataFrame:
    """docs(doc_id, held_out, text) -> doc_id, held_out, score, predicted.

    Null and empty texts score 0; without a model every score is 0.5.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = texts(b, "text")
            scores = np.full(len(rows), 0.5)
            for at in range(0, len(rows), 128):
                if sent.value is not None:
                    scores[at : at + 128] = vote(np.stack([term_counts(t, settings) for t in rows[at : at + 128]]), sent.value, settings)
            yield batch_of([b.column(0), b.column(1), scores, (scores >= 0.5).astype(np.int32)], _OUT)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op2_quality_knn(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 3, 1))
    return score(docs, fit(docs, labels))
