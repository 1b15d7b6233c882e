"""Byte-level BPE encoding and decoding with numpy matrices.

A text is cut into pieces by the tokenizer's pattern.  Distinct pieces that a worker has not met are encoded
together: pieces of similar length are the padded rows of a matrix of token ids, and in each round every row
merges its leftmost pair of least rank.  Ranks of pairs come from an open-addressing hash table.  A merged row is
one id shorter, so deleting one column entry per row compacts the matrix; finished rows leave it.

A piece of more bytes than the widest bucket is a matrix of one row, as wide as itself.  There a round merges the
leftmost pair of least rank and every later pair of that rank, up to the first merge that makes a pair of lower
rank: just what that many single merges would do, so that a long run of one character takes few rounds.

One pass over the texts encodes, decodes again and digests; a worker remembers pieces up to a number of bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ..runtime import settings
from .words import raw_text, release

NONE = np.int32(2**31 - 1)
#: Row widths of matrices that many pieces share; a longer piece is a matrix of its own.
WIDTHS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128)
#: Cells of a matrix, and bytes of pieces, ids and their dictionary entries that a worker remembers.
CELLS, REMEMBERED, ENTRY = 1 << 18, 24 << 20, 180
#: Bytes of text that are encoded at a time, however long the texts are, and rows handed on together.
STEP, ROWS = 1 << 19, 1000


class PairTable:
    """(left id, right id) -> id of their concatenation, by multiplicative hashing with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))) + 1)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """NONE for a pair that does not merge; a negative id is padding."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        out = np.full(keys.shape, NONE, dtype=np.int32).ravel()
        todo = np.flatnonzero(((a >= 0) & (b >= 0)).ravel())
        keys = keys.ravel()[todo]
        slot = self._slot(keys)
        while len(todo):
            there = self.keys[slot]
            hit = there == keys
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & self.mask
        return out.reshape(a.shape)


class Tokenizer:
    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.pattern = regex.compile(pattern)
        self.vocab = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocab[rank] = token
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        splits = [((self.ranks[t[:i]] << 32) | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs = PairTable(*(np.array(x, dtype=np.int64) for x in zip(*splits))) if splits else PairTable(np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.known: dict[str, bytes] = {}
        self.held = 0

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > WIDTHS[-1]:
                out[i] = self._wide(p)
            else:
                by_width.setdefault(next(w for w in WIDTHS if w >= len(p)), []).append(i)
        for width, rows in by_width.items():
            for lo in range(0, len(rows), step := max(1, CELLS // width)):
                part = rows[lo : lo + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ids = np.full((len(pieces), width), -1, dtype=np.int32)
        ids[np.arange(width) < size[:, None]] = flat
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(len(pieces)), [b""] * len(pieces)
        while len(row):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            lines = np.arange(len(row))
            new = rank[lines, at] if rank.shape[1] else np.full(len(row), NONE)
            done = new == NONE
            if done.any():
                for i, line, n in zip(row[done].tolist(), ids[done].astype("<u4"), (ids[done] >= 0).sum(axis=1).tolist()):
                    out[i] = line[:n].tobytes()
                row, ids, rank, at, new = row[~done], ids[~done], rank[~done], at[~done], new[~done]
                lines = np.arange(len(row))
                if not len(row):
                    break
            ids[lines, at] = new
            keep = np.ones(ids.shape, dtype=bool)
            keep[lines, at + 1] = False
            ids = ids[keep].reshape(len(row), -1)
            keep = np.ones(rank.shape, dtype=bool)
            keep[lines, at] = False
            rank = rank[keep].reshape(len(row), -1)
            if rank.shape[1]:
                left = np.flatnonzero(at > 0)
                rank[left, at[left] - 1] = self.pairs.get(ids[left, at[left] - 1], ids[left, at[left]])
                right = np.flatnonzero(at < rank.shape[1])
                rank[right, at[right]] = self.pairs.get(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def _wide(self, piece: bytes) -> bytes:
        """A matrix of one row."""
        ids = self.bytes[np.frombuffer(piece, dtype=np.uint8)]
        rank = self.pairs.get(ids[:-1], ids[1:])
        while len(rank):
            least = rank.min()
            if least == NONE:
                break
            at = np.flatnonzero(rank == least)
            # of touching pairs (a run of one symbol) every second merges, from the left
            run = np.cumsum(np.concatenate(([True], np.diff(at) > 1)))
            first = at[np.searchsorted(run, run)]
            at = at[(at - first) % 2 == 0]
            # pairs that each merge makes, as it would find its neighbours when it comes from the left
            before = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
            before[1:] = np.where(at[1:] == at[:-1] + 2, least, before[1:])
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            merged = np.full(len(at), least, dtype=np.int32)
            lower = (self.pairs.get(before, merged) < least) | (self.pairs.get(merged, after) < least)
            if lower.any():
                at = at[: int(np.argmax(lower)) + 1]
            ids[at] = least
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep[1:]]
            new = at - np.arange(len(at))
            i = np.unique(np.concatenate((new - 1, new)))
            i = i[(i >= 0) & (i < len(rank))]
            rank[i] = self.pairs.get(ids[i], ids[i + 1])
        return ids.astype("<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(t) for t in texts]
        known = self.known
        new = list({p for pieces in cut for p in pieces if p not in known})
        ids = self.encode_pieces([p.encode() for p in new])
        known.update(zip(new, ids))
        self.held += sum(map(len, new)) + sum(map(len, ids)) + ENTRY * len(new)
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        if self.held > REMEMBERED:
            known.clear()
            self.held = 0
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_tokenizers: dict[tuple[int, str], Tokenizer] = {}


def tokenizer(rank_file: bytes, pattern: str) -> Tokenizer:
    key = (hash(rank_file), pattern)
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer(rank_file, pattern)
    return _tokenizers[key]


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about STEP bytes and ROWS rows at most; null is empty."""
    buf, offsets = raw_text(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, min(lo + ROWS, int(np.searchsorted(offsets, offsets[lo] + STEP, side="right")) - 1))
        yield lo, [bytes(buf[a:b]).decode() for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist())]
        lo = hi


class Codec:
    """Encodes and decodes columns with one tokenizer; the rank file (under 1 MB) is broadcast."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            self.file = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern

    def _map(self, docs: DataFrame, keep: tuple[str, ...], made, schema: str) -> DataFrame:
        """(*keep, *what made returns of a tokenizer and the ids of some texts), in one pass over docs(*keep, text)."""
        file, pattern, names = self.file, self.pattern, [c.split()[0] for c in schema.split(", ")]

        def run(batches):
            t = tokenizer(file.value, pattern)
            for b in batches:
                for lo, texts in _texts(b.column(b.num_columns - 1)):
                    kept = [c.slice(lo, len(texts)) for c in b.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*kept, *made(t, t.encode_batch(texts))], [*b.schema.names[:-1], *names])
            release()

        picked = docs.select(*keep, "text")
        return picked.mapInArrow(run, "".join(f"`{c}` {t}, " for c, t in picked.dtypes[:-1]) + schema)

    def encode(self, docs: DataFrame, *keep: str) -> DataFrame:
        """docs(*keep, text) -> (*keep, n_tokens, ids): ids holds little-endian unsigned 32-bit integers.

        A null or empty text has no tokens; every row stays, repeated rows included.  An empty table gives an empty result.
        """
        return self._map(docs, keep, lambda t, ids: [_sizes(ids), pa.array(ids, type=pa.binary())], "n_tokens long, ids binary")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """encoded(..., ids) -> (..., ids, decoded): the bytes that the ids stand for; null ids stand for none."""
        file, pattern = self.file, self.pattern

        def run(batches):
            t = tokenizer(file.value, pattern)
            for b in batches:
                for lo in range(0, b.num_rows, 64):
                    part = b.slice(lo, 64)
                    out = pa.array([t.decode(x.as_py() or b"") for x in part.column("ids")], type=pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns, out], [*b.schema.names, "decoded"])

        return encoded.mapInArrow(run, "".join(f"`{c}` {t}, " for c, t in encoded.dtypes) + "decoded binary")

    def digests(self, docs: DataFrame, *keep: str) -> DataFrame:
        """docs(*keep, text) -> (*keep, n_tokens, ids_sha256, decoded_sha256), rows as in encode; texts and ids stay in the task."""
        sha = lambda x: hashlib.sha256(x).hexdigest()
        made = lambda t, ids: [_sizes(ids), pa.array([sha(x) for x in ids], type=pa.string()), pa.array([sha(t.decode(x)) for x in ids], type=pa.string())]
        return self._map(docs, keep, made, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _sizes(ids: list[bytes]) -> pa.Array:
    return pa.array([len(x) // 4 for x in ids], type=pa.int64())


def public_codec(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> Codec:
    import public_tokenizers

    return Codec(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def op9_byte_level_bpe(spark, sf_dir: str) -> DataFrame:
    settings(spark)
    return public_codec(spark).digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
