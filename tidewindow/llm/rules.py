"""Quality rules: counts of surface faults, and the log-likelihood ratio of hashed n-grams.

Two multinomials over BUCKETS hashed tokens and token pairs: the trusted target (documents labelled as of good
quality) and the raw corpus (every document), each counted over all their rows and smoothed by SMOOTH.  A
document's ratio is the mean of log p_target - log p_raw over its n-grams, so length does not matter.  Every
document gets a verdict from the same fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import settings
from .grams import word_grams
from .words import Block, blocks, window_hashes

BITS, SMOOTH, THRESHOLD = 17, 1.0, -0.35
#: Bytes of bitmaps of trusted ids that are broadcast (a bit an id where ids are dense, 4 KB for each range of 32,768
#: that has one); larger ones are joined by shuffle, which moves the texts once.
BROADCAST_BITS = 64 << 20
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of the task's texts, a row for each bucket that occurs."""
    total = np.zeros(1 << BITS, dtype=np.int64)
    for b in batches:
        for k in blocks(b.column(0), lower=True):
            total += np.bincount(word_grams(k, BITS)[1], minlength=1 << BITS)
    at = np.flatnonzero(total)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all buckets (at most 2**BITS rows reach the driver)."""
    found = texts.select("text").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS, dtype=np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """All zero without a target."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    p, q = ((x + SMOOTH) / (x.sum() + SMOOTH * len(x)) for x in (target, raw))
    return np.log(p) - np.log(q)


def _repeated_words(tokens: np.ndarray, width: int = 3) -> int:
    """Words inside a window of width words that the text holds twice or more."""
    h = window_hashes(tokens, width)
    if len(h) < 2:
        return 0
    _, back, count = np.unique(h, return_inverse=True, return_counts=True)
    again = count[back] > 1
    covered = np.zeros(len(tokens), dtype=bool)
    for i in range(width):
        covered[i : i + len(h)] |= again
    return int(covered.sum())


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def faults(k: Block) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document of a block."""
    n = np.diff(k.first)
    within = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[k.offsets])
    space = np.zeros(len(k.buf), dtype=bool)
    space[(k.buf == 0x20) | ((k.buf >= 0x09) & (k.buf <= 0x0D))] = True
    chars = within(~space & ((k.buf & 0xC0) != 0x80))
    tokens = k.hashes()
    repeats = np.array([_repeated_words(tokens[a:b]) for a, b in zip(k.first[:-1], k.first[1:])], dtype=np.int64)
    lines = np.array([_repeated_lines(k.text(i)) for i in range(k.hi - k.lo)], dtype=np.int64)
    return [n.astype(np.int64), chars, within(SYMBOLS[k.buf]), lines, repeats]


def _judge(batches: Iterator[pa.RecordBatch], ratios) -> Iterator[pa.RecordBatch]:
    r = ratios.value
    for b in batches:
        plain = [faults(k) for k in blocks(b.column(1))]
        means = []
        for k in blocks(b.column(1), lower=True):
            rows, buckets = word_grams(k, BITS)
            n = np.bincount(rows, minlength=k.hi - k.lo)
            means.append(np.bincount(rows, r[buckets], k.hi - k.lo) / np.maximum(n, 1))
        columns = [np.concatenate(x) for x in zip(*plain)] if plain else [np.zeros(0, np.int64)] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns), pa.array(np.concatenate(means) if means else np.zeros(0))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio"])


def _trusted(docs: DataFrame, good: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows of docs whose doc_id is in good, each once."""
    ids = good.filter("doc_id IS NOT NULL").select("doc_id")
    limit = BROADCAST_BITS if limit is None else limit
    if ids.select(F.bitmap_bucket_number("doc_id").alias("b")).distinct().count() * 4200 > limit:
        return docs.join(ids.distinct(), "doc_id", "left_semi")
    bits = ids.groupBy(F.bitmap_bucket_number("doc_id").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("__bits"))
    at = F.bitmap_bit_position("doc_id")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    both = docs.join(F.broadcast(bits), F.bitmap_bucket_number("doc_id") == F.col("__bucket"))
    return both.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*docs.columns)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_ratio, base_failed, kept), a row each.

    Terms are tokens and pairs of neighbours, but a token beside itself is one term, "again", whatever the token, so that
    repetition tells in any language.  A null or empty text has no words, ratio 0, and fails the base rules; documents without an id are judged too,
    but are never trusted.  Several good labels of one document count once, rows of one doc_id each.  No trusted
    document makes every ratio 0; an empty table gives an empty result.
    """
    target = gram_counts(_trusted(docs.select("doc_id", "text"), labels.filter("quality = 1")))
    shared = docs.sparkSession.sparkContext.broadcast(log_ratio(target, gram_counts(docs)))
    out = docs.select("doc_id", "text").mapInArrow(
        partial(_judge, ratios=shared), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ratio double"
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("log_ratio") >= threshold))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    settings(spark)
    return judged(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
