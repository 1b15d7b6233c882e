"""Hashed terms of texts, and bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Block, WORD_BASES, mix, span_hashes

U = np.uint64
#: Stands for "the same token again" in a pair, so that repetition is one term whatever is repeated.
AGAIN = U(0x2545F4914F6CDD1D)


def _of_rows(first: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]


def word_grams(block: Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document of the block, bucket) of every token and of every pair of neighbouring tokens."""
    starts, ends, first = block.tokens()
    one = span_hashes(block.buf, starts, ends)
    row = _of_rows(first, len(one))
    inside = np.flatnonzero(row[1:] == row[:-1])
    a, b = one[inside], one[inside + 1]
    two = mix(np.where(a == b, AGAIN, a * U(WORD_BASES[0])) + np.where(a == b, U(0), b * U(WORD_BASES[1])))
    return np.concatenate((row, row[inside])), (np.concatenate((one, two)) >> U(64 - bits)).astype(np.int64)


#: Lengths in bytes of the beginnings of words that are terms of their own, for inflected forms.
BEGINNINGS = (3, 4, 5, 6, 7, 8)


def word_terms(block: Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document of the block, bucket) of every token and of the beginnings of longer tokens."""
    starts, ends, first = block.tokens()
    row = _of_rows(first, len(starts))
    rows, out = [row], [span_hashes(block.buf, starts, ends)]
    for n in BEGINNINGS:
        at = np.flatnonzero(ends - starts > n)
        rows.append(row[at])
        out.append(mix(span_hashes(block.buf, starts[at], starts[at] + n) + U(n)))
    return np.concatenate(rows), (np.concatenate(out) >> U(64 - bits)).astype(np.int64)


def distinct_counts(rows: np.ndarray, buckets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count), sorted by row and bucket."""
    key, count = np.unique((rows << bits) | buckets, return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), count


def eligible(labels: DataFrame, column: str, held_modulus: int, held_remainder: int) -> DataFrame:
    """(doc_id, label) of every document that may be learned from.

    Documents held out (crc32 of doc_id as text, modulo held_modulus) never are.  Of several labels of one
    document the largest counts; null labels do not.
    """
    ok = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % held_modulus != held_remainder))
    return ok.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))


def labelled(labels: DataFrame, column: str, held_modulus: int, held_remainder: int, per_class: int) -> DataFrame:
    """(doc_id, label): at most per_class eligible documents of each label, the first by a hash of doc_id."""
    one = eligible(labels, column, held_modulus, held_remainder)
    picks = [one.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return picks[0].unionByName(picks[1])


def held_out(modulus: int, remainder: int):
    """False for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))
