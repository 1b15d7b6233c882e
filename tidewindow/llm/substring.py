"""Substring dedup by level-wise doubling.

Window lengths double from a short base up to the window: 13, 25, 50 words (halves are rounded up).  At the base, the
window of smallest hash among all base windows inside a 50-word window stands for it: it is the same in every document
that holds those 50 words, and only about one position in 20 stands for any.  At each level the windows that two or more
different texts hold survive, and only those are extended to twice their length (to the right where that stays inside
the 50-word window, else to the left) and tested again.  A level that leaves no candidate ends the loop.

At the last level the windows of WINDOW words whose stand-in survived are compared themselves, by two 64-bit hashes that
differ from the hashing of words on (equal words have equal hashes; different windows meet with a chance of 2**-128 a
pair).  A window of a document is repeated when it also starts in a document of smaller id.  Nothing longer needs a level
of its own: every repeat of 100 or more words is covered by its 50-word windows.

Documents with equal word sequences are folded first; only the first of them takes part in the levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, settings
from .names import spare
from .words import BYTE_BASE_2, WORD_BASES, Block, blocks, release, segment_min_positions, window_hashes

WINDOW = 50
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _joined(block: Block, i: int, keep: np.ndarray | None = None) -> bytes:
    words = block.text(i).split()
    return b" ".join(words if keep is None else [w for w, k in zip(words, keep.tolist()) if k])


def _list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def levels(window: int) -> list[int]:
    """Lengths below the window, shortest first."""
    return sorted({-(-window // 4), -(-window // 2)} - {window})


def _stand_ins(tokens: np.ndarray, window: int, lengths: list[int]) -> np.ndarray:
    """For each window of a document, where the window of the last of lengths that stands for it begins."""
    at = segment_min_positions(window_hashes(tokens, lengths[0]), window - lengths[0] + 1)
    start = np.arange(len(at))
    for short, long in zip(lengths, lengths[1:]):
        at = np.where(at - start <= window - long, at, at + short - long)
    return at


def _alive(tokens: np.ndarray, window: int, lengths: list[int], live: np.ndarray) -> np.ndarray:
    """Of each window of a document: whether its stand-in of the last of lengths is among live."""
    at = _stand_ins(tokens, window, lengths)
    used = np.unique(at)
    ok = np.zeros(len(tokens), dtype=bool)
    ok[used] = np.isin(window_hashes(tokens, lengths[-1])[used].view(np.int64), live)
    return ok[at]


def _scan(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    base = levels(window)[:1]
    for b in batches:
        for k in blocks(b.column(2)):
            tokens = k.hashes()
            shas, picked = [], []
            for i in range(k.hi - k.lo):
                own = tokens[k.first[i] : k.first[i + 1]]
                shas.append(hashlib.sha256(_joined(k, i)).hexdigest())
                picked.append(np.unique(window_hashes(own, base[0])[np.unique(_stand_ins(own, window, base))]).view(np.int64) if len(own) >= window else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0)[k.lo : k.hi], b.column(1)[k.lo : k.hi], pa.array(shas), pa.array(np.diff(k.first), type=pa.int64()), _list_array(picked, pa.int64())],
                ["doc_id", "key", "sha", "n_words", "grams"],
            )
    release()


def _extend(batches: Iterator[pa.RecordBatch], window: int, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, key, text, live): the stand-ins of the last of lengths for windows that are alive at the one before."""
    for b in batches:
        for k in blocks(b.column(2)):
            tokens, picked = k.hashes(), []
            for i in range(k.hi - k.lo):
                own = tokens[k.first[i] : k.first[i + 1]]
                alive = _alive(own, window, lengths[:-1], b.column(3)[k.lo + i].values.to_numpy())
                picked.append(np.unique(window_hashes(own, lengths[-1])[np.unique(_stand_ins(own, window, lengths)[alive])]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0)[k.lo : k.hi], b.column(1)[k.lo : k.hi], _list_array(picked, pa.int64())], ["doc_id", "key", "grams"])
    release()


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, key, text, live): the windows that are alive at the level below."""
    for b in batches:
        for k in blocks(b.column(2)):
            tokens = k.hashes()
            one, two = window_hashes(tokens, window, WORD_BASES[0]), window_hashes(k.hashes(BYTE_BASE_2), window, WORD_BASES[1])
            rows, places = [], []
            for i in range(k.hi - k.lo):
                lo, hi = k.first[i], k.first[i + 1]
                if hi - lo < window:
                    continue
                at = np.flatnonzero(_alive(tokens[lo:hi], window, levels(window), b.column(3)[k.lo + i].values.to_numpy()))
                rows.append(np.full(len(at), k.lo + i))
                places.append(at + lo)
            rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            places = np.concatenate(places) if len(rows) else np.zeros(0, np.int64)
            local = places - k.first[rows - k.lo]
            for s in range(0, len(rows), 1 << 16):
                r, p = rows[s : s + (1 << 16)], places[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[p].view(np.int64)), pa.array(two[p].view(np.int64)), b.column(0).take(pa.array(r)), b.column(1).take(pa.array(r)), pa.array(local[s : s + (1 << 16)].astype(np.int32))],
                    ["w1", "w2", "doc_id", "key", "pos"],
                )
    release()


def _covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int32)
    edge[starts] = 1
    total = np.concatenate(([0], np.cumsum(edge[:n])))
    at = np.arange(n)
    return total[at + 1] - total[np.maximum(at - window + 1, 0)] > 0


def _cut(batches: Iterator[pa.RecordBatch], window: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, key, text, starts): what stays of the text, or its digest."""
    for b in batches:
        for k in blocks(b.column(2)):
            gone, out = [], []
            for i in range(k.hi - k.lo):
                n = int(k.first[i + 1] - k.first[i])
                starts = np.unique(b.column(3)[k.lo + i].values.to_numpy())
                covered = _covered(n, starts[starts <= n - window], window)
                gone.append(int(covered.sum()))
                kept = _joined(k, i, ~covered)
                out.append(kept.decode() if texts else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0)[k.lo : k.hi], b.column(1)[k.lo : k.hi], pa.array(gone, type=pa.int64()), pa.array(out)], ["doc_id", "key", "n_removed", "kept"])
    release()


class Repeats:
    """What level-wise doubling finds in docs(doc_id, text).

    scan: (doc_id, key, sha, n_words, least) a row each; least is the smallest doc_id of the same word sequence.
    hits: (doc_id, key, starts), the repeated windows of the first document of each word sequence.
    key tells rows of one doc_id with different texts apart.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch, window: int = WINDOW):
        if window < 2:
            raise ValueError("a window has two words or more")
        self.docs = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
        self.scratch, self.window = scratch, window
        scan = scratch.save(self.docs.mapInArrow(partial(_scan, window=window), "doc_id long, key long, sha string, n_words long, grams array<long>"), "scan")
        least = scratch.save(scan.groupBy("sha").agg(F.min("doc_id").alias("least")), "least")
        self.scan = scan.select("doc_id", "key", "sha", "n_words").join(least, "sha")
        firsts = scan.filter(F.size("grams") > 0).select("doc_id", "sha", "key", "grams")
        firsts = firsts.join(least.withColumnRenamed("least", "doc_id"), ["doc_id", "sha"], "left_semi")
        #: (length, different windows that survive, documents that hold them) of each level
        self.survived: list[tuple[int, int, int]] = []
        live = self._survivors(firsts, levels(window)[0])
        for i in range(2, len(levels(window)) + 1):
            if not self.survived[-1][1]:
                break
            lengths = levels(window)[:i]
            longer = self._with_text(live, "live").mapInArrow(partial(_extend, window=window, lengths=lengths), "doc_id long, key long, grams array<long>")
            shorter, live = live, self._survivors(longer, lengths[-1])
            scratch.drop(shorter)
        picked = self._with_text(live, "live")
        windows = scratch.save(picked.mapInArrow(partial(_windows, window=window), "w1 long, w2 long, doc_id long, key long, pos int"), "windows")
        first = scratch.save(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("w1", "w2", "low"), "first")
        later = windows.join(first, ["w1", "w2"]).filter("doc_id > low")
        self.hits = scratch.save(later.groupBy("doc_id", "key").agg(F.collect_list("pos").alias("starts"), F.count("*").alias("n_starts")), "hits")
        scratch.drop(windows, first)

    def _survivors(self, grams: DataFrame, length: int) -> DataFrame:
        """(doc_id, key, live, n_live): of rows (doc_id, key, grams), the grams that different documents hold."""
        each = self.scratch.save(grams.select("doc_id", "key", F.explode("grams").alias("gram")), f"grams{length}")
        repeated = self.scratch.save(each.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("gram"), f"repeated{length}")
        live = self.scratch.save(each.join(repeated, "gram").groupBy("doc_id", "key").agg(F.collect_list("gram").alias("live"), F.count("*").alias("n_live")), f"live{length}")
        self.survived.append((length, repeated.count(), live.count()))
        self.scratch.drop(each, repeated)
        return live

    def _with_text(self, some: DataFrame, column: str) -> DataFrame:
        return self.docs.join(some.filter(f"n_{column} > 0").drop(f"n_{column}"), ["doc_id", "key"]).select("doc_id", "key", "text", column)

    def cut(self, texts: bool) -> DataFrame:
        """(doc_id, key, n_removed, kept) of the documents with hits; kept is the text, or its SHA-256."""
        out = self._with_text(self.hits, "starts").mapInArrow(partial(_cut, window=self.window, texts=texts), "doc_id long, key long, n_removed long, kept string")
        return out.dropDuplicates(["doc_id", "key"])

    @property
    def is_copy(self):
        return (F.col("doc_id") > F.col("least")) & (F.col("n_words") >= self.window)

    def digests(self) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_sha256) for every row."""
        cut = self.scratch.save(self.cut(texts=False), "cut")
        all_rows = self.scan.join(cut, ["doc_id", "key"], "left")
        return all_rows.select(
            "doc_id", "n_words",
            F.when(self.is_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(self.is_copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        )


def remove_repeats(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """docs with repeated passages cut out of text (and n_chars brought up to date); same columns, same rows.

    A text that loses nothing stays as it was; of others the kept words are joined by one space.  A document
    of which nothing is left keeps its row, with an empty text.  Null texts have no words and stay null; rows
    without a doc_id are left alone; windows are judged on the input.  An empty table gives an empty result.
    """
    found = Repeats(docs, scratch, window)
    copies = found.scan.filter(found.is_copy).select("doc_id", "key", F.lit("").alias("kept")).distinct()
    changed = scratch.save(found.cut(texts=True).select("doc_id", "key", "kept").unionByName(copies), "changed")
    id_, key, kept = spare(docs, "id", "key", "kept")
    new = changed.select(F.col("doc_id").alias(id_), F.col("key").alias(key), F.col("kept").alias(kept))
    out = docs.join(new, (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left")
    text = F.coalesce(kept, "text")
    n_chars = [F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType).alias("n_chars")] if "n_chars" in docs.columns else []
    return out.select(*[text.alias("text") if c == "text" else n_chars[0] if c == "n_chars" else F.col(c) for c in docs.columns])


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    settings(spark)
    return Repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op2")).digests()


#: Windows as lists of 50 words, grouped as strings: the plain definition.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, sha256(array_to_string(list_slice(w, p, p + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
low AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM win JOIN low USING (h) WHERE doc_id > first),
kept AS (SELECT d.doc_id, q.q, w[q.q] AS word FROM d, unnest(range(1, len(w) + 1)) AS q(q) ANTI JOIN gone ON gone.doc_id = d.doc_id AND gone.q = q.q)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS s FROM kept GROUP BY doc_id) USING (doc_id)
"""
