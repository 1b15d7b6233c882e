"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal updates.

Terms are tokens and pairs of neighbouring tokens, hashed to 2**18 buckets; a document is the sparse vector of
log(1 + count), scaled to length 1, and its score the sigmoid of a dot product.  FTRL keeps a per-coordinate
learning rate and an L1 term that holds most weights at exactly 0.

Fitted on a bounded sample: at most PER_CLASS labelled documents of each class, EPOCHS times over in an order
given by a hash.  The weights (2 MB) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import settings
from .grams import distinct_counts, held_out, labelled, word_grams
from .words import blocks, release

BITS, PER_CLASS, EPOCHS = 18, 3000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05


def _vectors(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) sorted by row."""
    rows, terms, counts = distinct_counts(*word_grams(block, BITS), BITS)
    x = np.log1p(counts)
    norm = np.sqrt(np.bincount(rows, x * x, block.hi - block.lo))
    return rows, terms, x / norm[rows]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in blocks(b.column(2), lower=True):
            rows, terms, x = _vectors(k)
            at = pa.array(np.searchsorted(rows, np.arange(k.hi - k.lo + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0)[k.lo : k.hi], b.column(1)[k.lo : k.hi], pa.ListArray.from_arrays(at, pa.array(terms.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(x.astype(np.float32)))],
                ["place", "label", "terms", "x"],
            )


class Ftrl:
    """FTRL-proximal for the logistic loss; bucket 2**BITS is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * weight * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def train(sample: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights of the buckets and the bias; classes weigh the same."""
    model = Ftrl((1 << BITS) + 1)
    ones = sum(y for y, _, _ in sample)
    weight = {1: len(sample) / (2 * max(1, ones)), 0: len(sample) / (2 * max(1, len(sample) - ones))}
    for _ in range(EPOCHS):
        for y, terms, x in sample:
            model.update(np.append(terms, 1 << BITS), np.append(x, 1.0), y, weight[y])
    return model.weights()


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, column: str, modulus: int, remainder: int) -> np.ndarray:
    """Weights of the buckets and the bias, from the rows of docs whose labels may be learned from.

    Of several labels of one document the largest counts; null labels and labels without a doc_id do not.  Without
    labelled documents every weight is 0 and every score 0.5.
    """
    sample = labelled(labels, column, modulus, remainder, PER_CLASS)
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.xxhash64(F.lit(1), "doc_id").alias("place"), "label", "text")
    found = picked.repartition("doc_id").select("place", "label", "text").mapInArrow(_gather, "place long, label int, terms array<int>, x array<float>").toArrow()
    lists = lambda name: (v.values.to_numpy() for c in found.column(name).chunks for v in c)
    rows = sorted(zip(found.column("place").to_pylist(), found.column("label").to_pylist(), lists("terms"), lists("x")), key=lambda r: (r[0], r[1], r[2].tobytes()))
    return train([r[1:] for r in rows])


def _score(batches: Iterator[pa.RecordBatch], weights, place: int, name: str) -> Iterator[pa.RecordBatch]:
    w = weights.value
    for b in batches:
        out = np.zeros(b.num_rows)
        for k in blocks(b.column(place), lower=True):
            rows, terms, x = _vectors(k)
            out[k.lo : k.hi] = np.bincount(rows, w[terms] * x, k.hi - k.lo)
        score = 1 / (1 + np.exp(-np.clip(out + w[-1], -30, 30)))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, name])
    release()


def with_score(docs: DataFrame, weights: np.ndarray, name: str = "__score") -> DataFrame:
    """docs(..., text) with a further column, from 0 to 1; a null or empty text has the bias alone.

    docs must not have a column called name.

    Every row stays, repeated rows included; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = "".join(f"`{c}` {t}, " for c, t in docs.dtypes) + f"`{name}` double"
    return docs.mapInArrow(partial(_score, weights=shared, place=docs.columns.index("text"), name=name), schema)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    settings(spark)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = with_score(docs.select("doc_id", "text"), fit(spark, docs, labels, "quality", 4, 2))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.7).cast("int").alias("predicted"))
