"""Media columns stored as content-defined chunks.

A payload is cut where a gear hash of its last 32 bytes has CUT_BITS leading zeros, at least LEAST and at most MOST
bytes apart.  A manifest lists the digests and lengths of its chunks.  Payloads that are equal share a manifest;
chunks that occur more than once, in several payloads or within one, are found by joins of digests alone, and each is stored once:

* an object row for each distinct payload: its manifest (the bytes ``CDC1``, payload length, number of chunks, and
  length and digest of each), and the bytes of the chunks that occur nowhere else;
* a chunk row for each shared chunk.

Reading joins shared chunks back by digest, puts every chunk in the manifest's order, and checks each digest.  The
stored form of a payload is what is stored for it: the bytes of its manifest, then of its chunks in order.

Writers learn which chunks of a document are shared from a table of marks.  A filter of FILTER_BITS bits, whatever the
size of the corpus, tells which documents may have one: all others are stored where they are read, and the texts of
those alone move to be joined with their marks.  A document that the filter passes in vain finds no mark and is stored
like the others; a corpus that fills the filter moves more texts, with the same result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, settings
from .words import raw_text, release

UNIT, CUT_BITS, LEAST, MOST, DIGEST = 192, 10, 256, 4096, 16
FILTER_BITS = 1 << 26
STEP = 1 << 20
#: Random numbers of the gear hash, from a fixed seed.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
PRIVATE, OWNED, FOREIGN = 0, 1, 2


def payload(text: bytes) -> bytes:
    """Spaces are appended up to a positive multiple of UNIT bytes."""
    return text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: sum of GEAR[b] << age over the last 32 bytes, by doubling."""
    h = GEAR[data]
    span = 1
    while span < 32:
        more = h.copy()
        more[span:] += h[:-span] << np.uint32(span)
        h, span = more, 2 * span
    return h


def cuts(payloads: list[bytes]) -> list[list[int]]:
    """The chunk lengths of each payload.  LEAST exceeds the hash's window, so neighbours in memory do not matter."""
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    marks = np.flatnonzero(gear(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, base = [], 0
    for p in payloads:
        lengths, last, end = [], base, base + len(p)
        i = int(np.searchsorted(marks, last + LEAST))
        while end - last > 0:
            cut = int(marks[i]) if i < len(marks) and marks[i] < end else end
            cut = min(cut, last + MOST, end)
            lengths.append(cut - last)
            last = cut
            i = int(np.searchsorted(marks, last + LEAST))
        out.append(lengths)
        base = end
    return out


def _payloads(column: pa.Array) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """(first row, payloads, text lengths) of about STEP bytes at a time."""
    buf, offsets = raw_text(column)
    at = offsets.tolist()
    lo = 0
    while lo < len(column):
        hi = lo + 1
        while hi < len(column) and at[hi + 1] - at[lo] <= STEP:
            hi += 1
        yield lo, [payload(buf[a:b].tobytes()) for a, b in zip(at[lo:hi], at[lo + 1 : hi + 1])], [b - a for a, b in zip(at[lo:hi], at[lo + 1 : hi + 1])]
        lo = hi


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def _pieces(data: bytes, lengths: list[int]) -> list[bytes]:
    out, at = [], 0
    for n in lengths:
        out.append(data[at : at + n])
        at += n
    return out


def _manifests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, loads, sizes in _payloads(b.column(1)):
            digests = [[_digest(x) for x in _pieces(p, n)] for p, n in zip(loads, cuts(loads))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0)[lo : lo + len(loads)], pa.array([_digest(p) for p in loads], type=pa.binary()), pa.array(sizes, type=pa.int64()), pa.array(digests, type=pa.list_(pa.binary()))],
                ["doc_id", "object", "n_bytes", "digests"],
            )


STORE = "object binary, manifest binary, kinds binary, digest binary, bytes binary"
ENTRY = struct.Struct(f"<I{DIGEST}s")


def manifest(lengths: list[int], digests: list[bytes]) -> bytes:
    return b"CDC1" + struct.pack("<QI", sum(lengths), len(lengths)) + b"".join(map(ENTRY.pack, lengths, digests))


def read_manifest(data: bytes) -> tuple[list[int], list[bytes]]:
    """Lengths and digests; ValueError for bytes that are no manifest."""
    if data[:4] != b"CDC1" or len(data) < 16 or len(data) != 16 + ENTRY.size * struct.unpack_from("<I", data, 12)[0]:
        raise ValueError("not a manifest")
    entries = list(ENTRY.iter_unpack(data[16:]))
    if sum(n for n, _ in entries) != struct.unpack_from("<Q", data, 4)[0]:
        raise ValueError("not a manifest")
    return [n for n, _ in entries], [d for _, d in entries]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, object, kinds) of one document for each object: its row, and rows of the shared chunks it owns."""
    names = ["object", "manifest", "kinds", "digest", "bytes"]
    types = [pa.binary()] * 5
    for b in batches:
        kinds_of = b.column(1)
        for lo, loads, _ in _payloads(b.column(0)):
            rows = []
            for i, (p, lengths) in enumerate(zip(loads, cuts(loads)), lo):
                kinds = kinds_of[i].as_py()
                if kinds == b"":  # another document stands for this payload
                    continue
                parts = _pieces(p, lengths)
                kinds = kinds or bytes(len(parts))
                digests = [_digest(x) for x in parts]
                rows.append((_digest(p), manifest(lengths, digests), kinds, None, b"".join(x for x, k in zip(parts, kinds) if k == PRIVATE)))
                owned = {d: x for d, x, k in zip(digests, parts, kinds) if k == OWNED}
                rows += [(None, None, None, d, x) for d, x in owned.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names)
    release()


def _filter(picks: DataFrame, bits: int) -> np.ndarray:
    """bits bits as bytes, set at the hashes picks(pick); each bitmap is made in one task."""
    at = F.pmod("pick", F.lit(bits)) + 1
    placed = picks.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("at")).repartition("bucket")
    found = placed.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).toArrow()
    out = np.zeros((-(-bits // (1 << 15)), 1 << 12), dtype=np.uint8)
    for bucket, data in zip(found.column("bucket").to_pylist(), found.column("bits").to_pylist()):
        out[bucket - 1] = np.frombuffer(data, dtype=np.uint8)
    return out.ravel()


def _passes(picks: pa.Array, marked: np.ndarray, bits: int) -> np.ndarray:
    """Which of the hashes have their bit set."""
    at = picks.to_numpy(zero_copy_only=False) % bits
    return (marked[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _unmarked(batches: Iterator[pa.RecordBatch], marked, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (text, pick) that the filter does not pass, stored."""
    alone = (b.filter(pa.array(~_passes(b.column(1), marked.value, bits))) for b in batches)
    return _store(pa.RecordBatch.from_arrays([b.column(0), pa.nulls(len(b), pa.binary())], ["text", "kinds"]) for b in alone if len(b))


def assemble(digests: list[bytes], lengths: list[int], kinds: bytes, own: bytes, shared: dict[int, bytes]) -> list[bytes]:
    """The chunks of an object in order, each checked against its digest."""
    out, at = [], 0
    for i, (n, kind) in enumerate(zip(lengths, kinds)):
        if kind == PRIVATE:
            out.append(own[at : at + n])
            at += n
        else:
            out.append(shared[i])
        if _digest(out[-1]) != digests[i]:
            raise ValueError(f"chunk {i} does not match its digest")
    return out


def feature(data: bytes) -> str:
    """Mean and deviation of the payload's samples, mean step between neighbours, and number of distinct samples."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    n = len(x)
    mean, square = int(x.sum()) / n, int((x * x).sum()) / n
    return f"mean={mean:.6f};std={max(0.0, square - mean * mean) ** 0.5:.6f};step={int(np.abs(np.diff(x)).sum()) / (n - 1):.6f};distinct={int((np.bincount(x, minlength=256) > 0).sum())}"


READ = "object binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches: Iterator[pa.RecordBatch], payloads: bool = False) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for key, head, kinds, own, shared in zip(*(b.column(c).to_pylist() for c in ("object", "manifest", "kinds", "bytes", "shared"))):
            lengths, digests = read_manifest(head)
            chunks = assemble(digests, lengths, kinds, own, {x["pos"]: x["bytes"] for x in shared or []})
            data = b"".join(chunks)
            if _digest(data) != key:
                raise ValueError("payload does not match its digest")
            if payloads:
                rows.append((key, data))
                continue
            media = hashlib.sha256(head)
            for x in chunks:
                media.update(x)
            rows.append((key, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(head) + sum(map(len, chunks)), media.hexdigest(), feature(data)))
        types = [pa.binary(), pa.binary()] if payloads else [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["object", "payload"] if payloads else [x.split()[0] for x in READ.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names)


class ChunkStore:
    """The media of docs(doc_id, text), deduplicated.

    of_docs: (doc_id, key, object, n_bytes), a row each; key tells rows of one doc_id apart by their text.
    Null texts are empty payloads; null ids and repeated rows are stored like any other; an empty table gives
    empty tables.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch, bits: int = FILTER_BITS):
        self.scratch = scratch
        made = docs.select(F.struct("doc_id", F.xxhash64("text").alias("key")).alias("doc_id"), "text")
        all_manifests = scratch.save(made.mapInArrow(_manifests, "doc_id struct<doc_id: long, key: long>, object binary, n_bytes long, digests array<binary>"), "manifests")
        self.of_docs = all_manifests.select("doc_id.*", "object", "n_bytes")
        # one document stands for each object, and one object owns each shared chunk: the one of smallest 64-bit hash.  Of
        # documents or objects that tie, both store, which costs space only: reading takes one.
        pick = F.xxhash64("doc_id.doc_id", "doc_id.key")
        stands = scratch.save(all_manifests.groupBy("object").agg(F.min(pick).alias("stands")), "stands")
        firsts = all_manifests.withColumn("pick", pick).join(stands.select("object", F.col("stands").alias("pick")), ["object", "pick"], "left_semi").dropDuplicates(["object"])
        chunks = scratch.save(firsts.select("object", F.posexplode("digests").alias("pos", "digest")), "chunks")
        owners = chunks.groupBy("digest").agg(F.min(F.xxhash64("object")).alias("owner"), F.count("*").alias("refs")).filter("refs > 1").select("digest", "owner")
        owners = scratch.save(owners, "owners")
        kind = F.when(F.xxhash64("object") == F.col("owner"), OWNED).otherwise(FOREIGN)
        self.shared_refs = scratch.save(chunks.join(owners, "digest").select("object", "pos", "digest", kind.alias("kind")), "refs")
        hot = self.shared_refs.groupBy("object").agg(F.map_from_entries(F.collect_list(F.struct("pos", "kind"))).alias("at"))
        code = F.transform(F.sequence(F.lit(0), F.size("digests") - 1), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("at", i), F.lit(PRIVATE))), 2, "0"))
        marked = firsts.join(hot, "object").select("doc_id", F.unhex(F.array_join(code, "")).alias("kinds"))
        others = all_manifests.join(stands, "object").filter(pick != F.col("stands")).select("doc_id", F.lit(b"").alias("kinds")).distinct()
        marks = scratch.save(marked.unionByName(others).select("doc_id.*", "kinds"), "marks")
        picked = F.xxhash64("doc_id", "key")
        marked = docs.sparkSession.sparkContext.broadcast(_filter(marks.select(picked.alias("pick")), bits))
        keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").withColumn("pick", picked)
        alone = keyed.select("text", "pick").mapInArrow(partial(_unmarked, marked=marked, bits=bits), STORE)
        passes = F.arrow_udf(lambda x: pa.array(_passes(x, marked.value, bits)), "boolean")
        m = marks.withColumnsRenamed({"doc_id": "m_id", "key": "m_key"}).hint("merge")  # its size does not choose the plan
        found = keyed.filter(passes("pick")).join(m, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")), "left").select("text", "kinds")
        self.table = scratch.save(alone.unionByName(found.mapInArrow(_store, STORE)), "store")
        marked.unpersist()

    def _objects(self) -> DataFrame:
        """Object rows with what they need of the shared chunks, as (pos, bytes).

        Repeated rows of the standing document store an object again; one is read.
        """
        objects = self.table.filter("object IS NOT NULL").drop("digest")
        whole = F.length(F.replace(F.hex("kinds"), F.lit("0"), F.lit(""))) == 0
        apart = objects.filter(~whole).dropDuplicates(["object"])
        shared = self.table.filter("digest IS NOT NULL").select("digest", "bytes").dropDuplicates(["digest"])
        parts = self.shared_refs.select("object", "pos", "digest").join(shared, "digest")
        parts = parts.groupBy("object").agg(F.collect_list(F.struct("pos", "bytes")).alias("shared"))
        empty = F.array().cast("array<struct<pos: int, bytes: binary>>")
        return objects.filter(whole).withColumn("shared", empty).unionByName(apart.join(parts, "object"))

    def features(self) -> DataFrame:
        """READ columns of each object, from the bytes read back."""
        return self._objects().mapInArrow(_read, READ).dropDuplicates(["object"])

    def payloads(self) -> DataFrame:
        """(object, payload) read back and verified."""
        return self._objects().mapInArrow(lambda b: _read(b, payloads=True), "object binary, payload binary").dropDuplicates(["object"])


def op7_media_chunks(spark, sf_dir: str) -> DataFrame:
    settings(spark)
    store = ChunkStore(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op7"))
    features = store.scratch.save(store.features(), "features")
    return store.of_docs.join(features, "object").drop("object", "key")
