"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of documents, in an order given by a hash.  Time runs in slots of one block.
Block j (from 1) of a source of weight w is released at floor((j - 1) / w) and due at ceil(j / w); in every slot
the released block with the earliest deadline goes first.  On one machine that keeps every source within one
block of w * t after every slot t.

Releases and deadlines come from the exact weights (as integers) over a whole phase.  When a source runs out, its phase
ends and the others go on at their weights among themselves, until every document has its place.

The driver steps through the slots and hands them over as a table, HELD slots at a time.  There are at most SLOTS of
them and one a source, whatever the number of documents: a block has BLOCK documents, doubled until that suffices
(32 up to 134 million documents).  What else the driver holds is a few numbers a source.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from fractions import Fraction
from heapq import heapify, heappop, heappush
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, settings
from .names import spare

#: Least documents of a block, slots in all, and slots that the driver holds at a time.
BLOCK, SLOTS, HELD = 32, 1 << 22, 1 << 18


def block_size(rows: int) -> int:
    size = BLOCK
    while size * SLOTS < rows:
        size *= 2
    return size


def timetable(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int]]:
    """(source, block) of each slot, by earliest deadline among the released, the lighter source first (integers throughout)."""
    left, done = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0)
    while left:
        exact = {s: Fraction(weights[s]) for s in left}
        scale = lcm(*(w.denominator for w in exact.values()))
        w = {s: int(x * scale) for s, x in exact.items()}
        total = sum(w.values())
        # of the phase: blocks of each source so far; (deadline, weight, source) of released blocks, (release, source) of others
        nth, ready, later, t = dict.fromkeys(left, 0), [(-(-total // w[s]), w[s], s) for s in left], [], 0
        heapify(ready)
        while True:
            while later and later[0][0] <= t and left[later[0][1]]:
                _, s = heappop(later)
                heappush(ready, (-(-(nth[s] + 1) * total // w[s]), w[s], s))
            if later and later[0][0] <= t:  # a source would go on and has run out
                break
            *_, s = heappop(ready)
            yield s, done[s]
            done[s] += 1
            nth[s] += 1
            left[s] -= 1
            heappush(later, (nth[s] * total // w[s], s))
            t += 1
        left = {s: n for s, n in left.items() if n}


def placed(docs: DataFrame, scratch: Scratch, weights: Mapping[str, float] | None = None, block: int | None = None) -> DataFrame:
    """(doc_id, source, block, slot, place) of every row of docs(doc_id, source); place sorts rows into the mix.

    weights gives targets; a source without one weighs as much as its share of rows, which is also the default.
    A null source is the source ''.  Repeated rows and null ids have places of their own.  slot counts from 0 without
    gaps.  An empty table gives an empty result.  block is the documents of a block, by default as block_size says.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source")).withColumn("order", F.xxhash64("doc_id"))
    # ranks within a source without gathering a source: ranges in order, then offsets of (range, source) pieces
    ranged = rows.repartitionByRange("source", "order", "doc_id").sortWithinPartitions("source", "order", "doc_id")
    ranged = scratch.save(ranged.withColumn("row", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("row", 33)
    pieces = ranged.groupBy("source", part.alias("part")).agg(F.min("row").alias("start"), F.count("*").alias("n")).collect()
    sizes: dict[str, int] = {}
    offsets = []
    for r in sorted(pieces, key=lambda r: (r.source, r.part)):
        offsets.append((r.source, r.part, sizes.get(r.source, 0) - r.start))
        sizes[r.source] = sizes.get(r.source, 0) + r.n
    total = sum(sizes.values())
    target = {s: float((weights or {}).get(s, n / total)) for s, n in sizes.items()}
    if any(w <= 0 for w in target.values()):
        raise ValueError("weights must be positive")
    block = block or block_size(total)
    slots = None
    times = enumerate(timetable({s: -(-n // block) for s, n in sizes.items()}, target))
    while piece := list(islice(times, HELD)):
        columns = [pa.array([s for _, (s, _) in piece]), pa.array([b for _, (_, b) in piece]), pa.array([t for t, _ in piece])]
        made = spark.createDataFrame(pa.table(columns, ["source", "block", "slot"]))
        made = scratch.save(made.coalesce(1), "slots")
        slots = made if slots is None else slots.unionByName(made)
    if slots is None:
        slots = spark.createDataFrame([], "source string, block long, slot long")
    offsets = spark.createDataFrame(offsets, "source string, part long, offset long")
    ranked = ranged.withColumn("part", part).join(offsets, ["source", "part"])
    ranked = ranked.withColumn("rank", F.col("row") + F.col("offset")).withColumn("block", F.floor(F.col("rank") / block))
    out = ranked.join(slots, ["source", "block"])
    return out.select("doc_id", "source", "block", "slot", (F.col("slot") * block + F.col("rank") % block).alias("place"))


def in_mixed_order(docs: DataFrame, scratch: Scratch, weights: Mapping[str, float] | None = None, block: int | None = None) -> DataFrame:
    """docs, all rows and columns, sorted into the mix; rows that share an id and source share a place."""
    id_, source, at = spare(docs, "id", "source", "place")
    place = placed(docs.select("doc_id", "source").distinct(), scratch, weights, block).select(
        F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("place").alias(at)
    )
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.coalesce("source", F.lit("")) == F.col(source))
    return docs.join(place, same, "left").repartitionByRange(at, "doc_id").sortWithinPartitions(at, "doc_id").select(*docs.columns)


def tempered(counts: Mapping[str, int], alpha: float = 0.7) -> dict[str, float]:
    """Target weights proportional to rows ** alpha: small sources come up earlier than their share."""
    return {s: n**alpha for s, n in counts.items()}


def source_counts(docs: DataFrame) -> dict[str, int]:
    return {r.source: r["count"] for r in docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).count().collect()}


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    settings(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return placed(docs, Scratch(spark, "op6"), tempered(source_counts(docs)))
