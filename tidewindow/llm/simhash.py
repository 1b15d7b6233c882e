"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has two halves of 32 bits.  Two fingerprints at distance 3 or less differ by at most one bit
in one of them (T = 1).  The anchors of a half are the words of the Hamming(31, 26) code with the last bit
free: every half lies within R = 1 of an anchor.  A fingerprint is copied to every anchor within R + T = 2 of
each of its halves (at most 17 of them), so a pair close in that half always meets at the nearest anchor of
either.  Rows that meet at an anchor are compared in full, so only true links leave an anchor.

Only distinct fingerprints travel: copies were folded before.  At one anchor a search outward from linked
fingerprints compares each with those not reached yet, and emits a spanning forest instead of all pairs.

An anchor of more than LARGE fingerprints is split by the other half.  That differs in at most 3 bits, so of its four
bytes at least one is equal: copies go to four keys (which byte, its value), and a linked pair still meets at one.  A
key that is large even so is split again, by four groups of six of the 24 bits left, for the same reason.  A task
thus holds small groups only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, settings
from .components import components
from .names import spare
from .words import LOWER_BYTES, raw_text, release

U = np.uint64
THRESHOLD = 3


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's shingles of width words, repeats included; no word gives zero.

    A text of fewer words has one shingle, the whole sequence.
    """
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=U)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        n = len(words) - width + 1
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), U, n)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(U)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, offsets = raw_text(b.column(2))
        data = memoryview(buf)
        fps = np.fromiter((fingerprint(bytes(data[s:e]), width) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())), U, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "key", "fp"])
    release()


#: Pairs of positions 1..31 by their exclusive or: the codewords two flips away from a half of that syndrome.
_PAIRS = [[(i, i ^ s) for i in range(1, 32) if 0 < i ^ s and i < i ^ s] for s in range(32)]


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into halves, anchor) of every anchor within distance 2 of each 32-bit half.

    Bits 0..30 hold positions 1..31 of the Hamming code, bit 31 is free.
    """
    x = halves.astype(U)
    syndrome = np.zeros(len(x), dtype=np.int64)
    for position in range(1, 32):
        syndrome ^= np.where((x >> U(position - 1)) & U(1), position, 0)
    flips = [0] + [1 << (p - 1) for p in range(1, 32)]
    nearest = x ^ np.array(flips, dtype=U)[syndrome]
    rows, out = [np.arange(len(x))] * 2, [nearest, nearest ^ U(1 << 31)]
    for s in range(1, 32):
        at = np.flatnonzero(syndrome == s)
        for i, j in _PAIRS[s]:
            rows.append(at)
            out.append(x[at] ^ U(flips[i] | flips[j]))
    return np.concatenate(rows), np.concatenate(out)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy().view(U)
        for lo in range(0, len(fps), 8192):
            part = fps[lo : lo + 8192]
            for half in (0, 1):
                rows, anchor = anchors((part >> U(32 * half)) & U(0xFFFFFFFF))
                key = (anchor | U(half << 32)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(rows), np.int32)), pa.array(part[rows].view(np.int64))], ["anchor", "sub", "fp"])


#: Fingerprints of a group beyond which it is split.
LARGE = 4096


def sub_keys(anchor: np.ndarray, sub: np.ndarray, fps: np.ndarray) -> list[np.ndarray]:
    """Four finer keys of each row: sub 0 is a whole anchor, 1..1024 a byte of the other half and its value."""
    other = np.where((anchor.view(U) >> U(32)) & U(1), fps & U(0xFFFFFFFF), fps >> U(32))
    whole = sub == 0
    byte = np.where(whole, 0, (sub - 1) // 256).astype(U)
    low = other & ((U(1) << (U(8) * byte)) - U(1))
    rest = low | (other >> (U(8) * byte + U(8)) << (U(8) * byte))  # the 24 bits beside the byte
    out = []
    for i in range(4):
        first = 1 + 256 * i + ((other >> U(8 * i)) & U(0xFF)).astype(np.int64)
        second = 1024 + 256 * (sub.astype(np.int64) - 1) + 64 * i + ((rest >> U(6 * i)) & U(0x3F)).astype(np.int64) + 1
        out.append(np.where(whole, first, second).astype(np.int32))
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        anchor, sub, fps = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(U)
        for finer in sub_keys(anchor, sub, fps):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(finer), b.column(2)], ["anchor", "sub", "fp"])


def spanning_links(fps: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what pairs at distance threshold or less join, as (ends, ends), without all pairs."""
    out, stack, left = [], [], fps
    while left.size:
        if not stack:
            stack, left = [left[0]], left[1:]
        x = stack.pop()
        near = np.bitwise_count(left ^ x) <= threshold
        if near.any():
            hit = left[near]
            left = left[~near]
            out.append((hit, np.full(len(hit), x, dtype=U)))
            stack.extend(hit)
    return out


#: Fingerprints of an anchor up to which all its pairs are compared at once, side by side with other anchors.
FEW = 8


def _links_of(key: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys stand together."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(key)])))
    of = np.repeat(size, size)
    found = []
    few = np.flatnonzero((of > 1) & (of <= FEW))
    k, f = key[few], fps[few]
    for lag in range(1, FEW):
        at = np.flatnonzero((k[lag:] == k[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= threshold)) if len(k) > lag else []
        if len(at):
            found.append((f[at + lag], f[at]))
    for i in np.flatnonzero(size > FEW):
        found += spanning_links(fps[first[i] : first[i] + size[i]], threshold)
    if not found:
        return np.zeros(0, U), np.zeros(0, U)
    pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _link(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by anchor and sub; the last group of what is held waits for its remaining rows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows, number, last = 0, 0, None

    def emit(key, fps):
        a, b = _links_of(key, fps, threshold)
        for i in range(0, len(a), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 65536].view(np.int64)), pa.array(b[i : i + 65536].view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, sub = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.concatenate(([last is not None and last != (anchor[0], sub[0])], (anchor[1:] != anchor[:-1]) | (sub[1:] != sub[:-1])))
        key = number + np.cumsum(new)  # groups by number
        number, last = int(key[-1]), (anchor[-1], sub[-1])
        held.append((key, batch.column(2).to_numpy().view(U)))
        rows += batch.num_rows
        if rows >= 1 << 17 and held[0][0][0] != number:
            key, fps = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(key, number))
            yield from emit(key[:cut], fps[:cut])
            held, rows = [(key[cut:], fps[cut:])], 0
    if held:
        yield from emit(*(np.concatenate(x) for x in zip(*held)))
    release()


def links(fps: DataFrame, scratch: Scratch, threshold: int = THRESHOLD) -> DataFrame:
    """Of different fingerprints fps(fp): (a, b), links that join what all pairs within threshold join."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the anchors cover thresholds up to 3")
    key = ["anchor", "sub"]
    schema = "anchor long, sub int, fp long"
    rows, parts = fps.select("fp").mapInArrow(_replicate, schema), []
    for _ in range(2):
        large = scratch.save(rows.groupBy(*key).count().filter(F.col("count") > LARGE).select(*key), "large")
        if large.isEmpty():
            break
        parts.append(rows.join(large, key, "left_anti"))
        rows = scratch.save(rows.join(large, key, "left_semi").select("anchor", "sub", "fp").mapInArrow(_split, schema), "split")
    parts.append(rows)
    met = parts[0]
    for p in parts[1:]:
        met = met.unionByName(p)
    return met.repartition(*key).sortWithinPartitions(*key).mapInArrow(partial(_link, threshold=threshold), "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch, threshold: int = THRESHOLD, width: int = 3) -> DataFrame:
    """(doc_id, key, fp, class, component_id) for every row of docs(doc_id, text).

    component_id is the smallest doc_id that links of threshold bits or fewer reach, the row's own included; class, a
    fingerprint, tells components apart even where no row has an id; key is a hash of the text.  A null text has no
    words and fingerprint zero; a null doc_id takes the component of its fingerprint and never names one (null if no
    other row is reached).  Repeated rows stay.  An empty table gives an empty result.
    """
    made = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(partial(_fingerprints, width=width), "doc_id long, key long, fp long")
    prints = scratch.save(made, "prints")
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, scratch, threshold), scratch)
    linked = scratch.save(roots.join(distinct.withColumnRenamed("fp", "node"), "node").select("node", "root", "least"), "linked")
    least = scratch.save(linked.groupBy("root").agg(F.min("least").alias("component")), "least")
    named = linked.join(least, "root").select(F.col("node").alias("fp"), "root", "component")
    found = distinct.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("class"), F.coalesce("component", "least").alias("component_id"))
    return prints.join(scratch.save(found, "classes"), "fp").select("doc_id", "key", "fp", "class", "component_id")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    settings(spark)
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op10"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of each near-duplicate group of docs: the one of smallest doc_id (rows without an id come last), and of
    several rows of that id the one whose text has the smallest hash.

    Rows that repeat it, id and text, go too.  All columns stay; an empty table gives an empty result.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    found = scratch.save(near_duplicates(docs, scratch).groupBy("class", "doc_id", "key").agg(F.count("*").alias("n")), "found")
    first = scratch.save(found.groupBy("class").agg(F.min(order).alias("first")), "firsts")
    rows = found.join(first, "class").withColumn("stays", order == F.col("first"))
    gone = scratch.save(rows.filter("NOT stays").select("doc_id", "key"), "gone")
    again = scratch.save(rows.filter("stays AND n > 1").select("doc_id", "key"), "again")
    id_, key = spare(docs, "id", "key")

    def of(side: DataFrame, how: str, left: DataFrame) -> DataFrame:
        other = side.select(F.col("doc_id").alias(id_), F.col("key").alias(key))
        return left.join(other, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), how)

    kept = of(gone, "left_anti", docs)
    if again.isEmpty():
        return kept
    once = of(again, "left_semi", docs).withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key]).drop(key)
    return of(again, "left_anti", kept).unionByName(once)
