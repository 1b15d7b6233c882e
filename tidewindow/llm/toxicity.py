"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of w_i + sum over pairs of <v_i, v_j>) over the distinct terms of a document.  Linear weights
add up insults; the factors learn pairs (an insult and what it is aimed at) that no sum of single weights can.  Terms
are tokens and the beginnings of longer tokens, hashed to 2**18 buckets.

Regularisation is a score test at zero: a bucket's weight and factors leave zero only if the gradient of the loss
there, on its weight or on one of its pairs, exceeds Z (for a pair, Z_PAIR) standard errors under no effect.  So a term that says nothing alone
is learned if its pairs do.  Pairs to test are proposed by the leading eigenvectors of the matrix of pair gradients
(sum over documents of residual * x_i * x_j), which is only ever multiplied with vectors.  However many buckets pass,
all are kept.

A toxic document counts POSITIVE times a clean one after the classes are balanced, as one missed costs more than one
sent to review.

Fitted on a bounded sample: at most PER_CLASS labelled documents of each class.  The model (at most 2**18 buckets with
FACTORS + 1 numbers each, 10 MB) is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import settings
from .grams import distinct_counts, held_out, labelled, word_terms
from .words import blocks, release

BITS, FACTORS, PER_CLASS, POSITIVE = 18, 4, 4000, 2.0
Z, Z_PAIR = 4.0, 6.0
#: Eigenvectors of pair gradients, rounds of the power iteration, and the entries of each whose pairs are tested.
VECTORS, ROUNDS, TESTED = 4, 12, 64


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in blocks(b.column(1), lower=True):
            rows, terms, _ = distinct_counts(*word_terms(k, BITS), BITS)
            at = np.searchsorted(rows, np.arange(k.hi - k.lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0)[k.lo : k.hi], pa.ListArray.from_arrays(pa.array(at), pa.array(terms.astype(np.int32)))], ["label", "terms"])


class FactorizationMachine:
    """Terms of a document come as (row, term) pairs sorted by row; every value is 1."""

    def __init__(self, n: int, factors: int, seed: int = 7):
        self.bias, self.w = 0.0, np.zeros(n)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (n, factors))

    def raw(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(rows, self.w[terms], n)
        for f in range(self.v.shape[1]):
            x = self.v[terms, f]
            out += (np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n)) / 2
        return out

    def fit(self, rows: np.ndarray, terms: np.ndarray, y: np.ndarray, epochs: int = 200, rate: float = 0.1, decay: float = 1e-3) -> None:
        """Full-batch AdaGrad on the logistic loss of balanced classes, the toxic one weighed by POSITIVE; deterministic."""
        n, share = len(y), POSITIVE / (1 + POSITIVE)
        weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
        g2 = [1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)]
        for _ in range(epochs):
            p = 1 / (1 + np.exp(-np.clip(self.raw(rows, terms, n), -30, 30)))
            e = (p - y) * weight
            gw = np.bincount(terms, e[rows], len(self.w)) + decay * self.w
            gv = np.empty_like(self.v)
            for f in range(self.v.shape[1]):
                x = self.v[terms, f]
                total = np.bincount(rows, x, n)
                gv[:, f] = np.bincount(terms, e[rows] * (total[rows] - x), len(self.w)) + decay * self.v[:, f]
            for i, g in enumerate((e.sum(), gw, gv)):
                g2[i] = g2[i] + g * g
            self.bias -= rate * e.sum() / np.sqrt(g2[0])
            self.w -= rate * gw / np.sqrt(g2[1])
            self.v -= rate * gv / np.sqrt(g2[2])


def linear_test(rows: np.ndarray, terms: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Buckets whose weight has a gradient at zero of Z standard errors or more (half a document is taken off, as
    counts are whole)."""
    n = np.bincount(terms, minlength=1 << BITS)
    ones = np.bincount(terms, y[rows], 1 << BITS)
    share = y.mean()
    z = (np.abs(ones - n * share) - 0.5) / np.sqrt(np.maximum(n * share * (1 - share) * (1 - n / len(y)), 1e-9))
    return np.flatnonzero((z >= Z) & (n < len(y)))


def pair_test(rows: np.ndarray, terms: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Buckets with a partner, so that the gradient on their pair has Z_PAIR standard errors or more."""
    e, n = y - y.mean(), len(y)
    df = np.bincount(terms, minlength=1 << BITS)
    rarer = min(y.mean(), 1 - y.mean())
    # a pair in k documents has at most sqrt(k * (1 - rarer) / rarer) standard errors
    used = np.flatnonzero((df > 1) & (df >= Z_PAIR**2 * rarer / (1 - rarer)) & (df < n))
    if len(used) < 2:
        return used[:0]
    at = np.full(1 << BITS, -1)
    at[used] = np.arange(len(used))
    inside = np.flatnonzero(at[terms] >= 0)
    r, t = rows[inside], at[terms[inside]]
    # entries of unit column norm, and documents of unit norm, so that neither rare terms nor long texts rule
    x = 1 / np.sqrt(df[used][t])
    length = np.sqrt(np.bincount(r, x * x, n))
    x = x / np.sqrt(length[r])
    own = np.bincount(t, e[r] * x * x, len(used))
    u = np.random.default_rng(7).normal(size=(len(used), VECTORS))
    for _ in range(ROUNDS):
        u, _ = np.linalg.qr(u)
        u = np.stack([np.bincount(t, (np.bincount(r, c[t] * x, n) * e)[r] * x, len(used)) - own * c for c in u.T], axis=1)
    found = []
    for c in u.T:
        top = np.sort(np.argsort(-np.abs(c), kind="stable")[:TESTED])
        there = np.zeros((n, len(top)))
        k = np.flatnonzero(np.isin(t, top))
        there[r[k], np.searchsorted(top, t[k])] = 1
        # the pair's own effect: both columns and the mean are taken out of the product of two
        centred = there - there.mean(axis=0)
        z = centred.T @ (e[:, None] * centred) / np.sqrt(np.maximum((centred**2).T @ (centred**2) * (e * e).mean(), 1e-9))
        np.fill_diagonal(z, 0)
        both = there.T @ there
        found.append(used[top[((np.abs(z) >= Z_PAIR) & (both > 1)).any(axis=1)]])
    return np.unique(np.concatenate(found))


class Model:
    """Scores texts; without both classes in the sample every score is 0."""

    def __init__(self, sample: list[tuple[int, np.ndarray]]):
        y = np.array([label for label, _ in sample], dtype=np.float64)
        self.column = np.full(1 << BITS, -1, dtype=np.int32)
        self.machine = None
        if 0 < y.sum() < len(y):
            rows = np.repeat(np.arange(len(sample)), [len(t) for _, t in sample])
            terms = np.concatenate([t for _, t in sample]).astype(np.int64)
            kept = np.union1d(linear_test(rows, terms, y), pair_test(rows, terms, y))
            self.column[kept] = np.arange(len(kept))
            at = np.flatnonzero(self.column[terms] >= 0)
            self.machine = FactorizationMachine(len(kept), FACTORS)
            self.machine.fit(rows[at], self.column[terms[at]], y)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        if self.machine is None:
            return out
        for k in blocks(column, lower=True):
            rows, terms = word_terms(k, BITS)
            at = np.flatnonzero(self.column[terms] >= 0)
            rows, terms, _ = distinct_counts(rows[at], self.column[terms[at]].astype(np.int64), BITS)
            out[k.lo : k.hi] = 1 / (1 + np.exp(-np.clip(self.machine.raw(rows, terms, k.hi - k.lo), -30, 30)))
        return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, column: str, modulus: int, remainder: int) -> Model:
    """The sample (at most 2 * PER_CLASS rows) is small enough to broadcast; terms are gathered, not texts.

    Of several labels of one document the largest counts; null labels and labels without a doc_id do not.
    """
    sample = labelled(labels, column, modulus, remainder, PER_CLASS)
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text").repartition("doc_id")
    found = picked.select("label", "text").mapInArrow(_terms, "label int, terms array<int>").toArrow()
    pairs = sorted(((x, t.values.to_numpy()) for x, t in zip(found.column(0).to_pylist(), (t for c in found.column(1).chunks for t in c))), key=lambda p: (p[0], p[1].tobytes()))
    return Model(pairs)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.scores(b.column(1)))], ["doc_id", "score"])
    release()


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, in no order.  A null or empty text has no terms and the bias alone; an empty
    table gives an empty result; rows that are repeated are scored again."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(partial(_score, model=shared), "doc_id long, score double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    settings(spark)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity(docs, fit(spark, docs, labels, "toxic", 3, 1))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
