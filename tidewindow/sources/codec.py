"""Binary blocks and engine metadata for exchange with other programs.

Fixed layouts, little-endian.  Block: magic 0x43564230, u16 version 1, u16 flags (1 payload, 2 int8), u32 dim, u32 count,
i64 t_start, i64 t_end, u32 payload size, u32 zero; then timestamps, vectors, scales (int8), payloads, CRC-32 of all
before.  Metadata (59 bytes): magic 0x4D564543, u16 version 1, u16 zero, u32 dim, u8 dtype, u8 metric, u32 payload size,
u64 capacity, i64 window, i64 interval, 16 bytes uuid, u8 recover flag.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import Config, Dtype, Metric
from ..errors import Code, EngineError

BLOCK_MAGIC, META_MAGIC, VERSION = 0x43564230, 0x4D564543, 1
HEADER, META = struct.Struct("<IHHIIqqII"), struct.Struct("<IHHIBBIQqq16sB")


@dataclass
class Block:
    timestamps: np.ndarray
    vectors: np.ndarray
    scales: np.ndarray | None = None
    payloads: np.ndarray | None = None

    @property
    def bounds(self) -> tuple[int, int]:
        return (int(self.timestamps.min()), int(self.timestamps.max())) if len(self.timestamps) else (0, 0)


def encode(block: Block) -> bytes:
    int8 = block.scales is not None
    vectors = np.asarray(block.vectors, "<i1" if int8 else "<f4")
    n, dim = vectors.shape
    size = 0 if block.payloads is None else block.payloads.shape[1]
    head = HEADER.pack(BLOCK_MAGIC, VERSION, (1 if size else 0) | (2 if int8 else 0), dim, n, *block.bounds, size, 0)
    body = head + np.asarray(block.timestamps, "<i8").tobytes() + vectors.tobytes()
    if int8:
        body += np.asarray(block.scales, "<f4").tobytes()
    if size:
        body += np.asarray(block.payloads, np.uint8).tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def peek(data: bytes) -> dict:
    """The header's fields; CORRUPTION for what no version-1 block can hold."""
    if len(data) < HEADER.size + 4:
        raise EngineError(Code.CORRUPTION, "too short")
    magic, version, flags, dim, count, t_start, t_end, size, _ = HEADER.unpack_from(data)
    if magic != BLOCK_MAGIC or version != VERSION or flags & ~3 or not dim or bool(flags & 1) != bool(size):
        raise EngineError(Code.CORRUPTION, "header")
    return {"dim": dim, "count": count, "t_start": t_start, "t_end": t_end, "payload_size": size, "int8": bool(flags & 2)}


def decode(data: bytes) -> Block:
    h = peek(data)
    n, dim, each = h["count"], h["dim"], 1 if h["int8"] else 4
    sizes = [8 * n, n * dim * each, 4 * n if h["int8"] else 0, n * h["payload_size"]]
    if len(data) != HEADER.size + sum(sizes) + 4:
        raise EngineError(Code.CORRUPTION, "size")
    if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise EngineError(Code.CORRUPTION, "checksum")
    at, parts = HEADER.size, []
    for s in sizes:
        parts.append(data[at : at + s])
        at += s
    return Block(
        np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "<i1" if h["int8"] else "<f4").reshape(n, dim), np.frombuffer(parts[2], "<f4") if h["int8"] else None,
        np.frombuffer(parts[3], np.uint8).reshape(n, -1) if h["payload_size"] else None,
    )


def encode_metadata(c: Config) -> bytes:
    return META.pack(META_MAGIC, VERSION, 0, c.dim, c.dtype, c.metric, c.payload_size, c.ring_capacity, c.window_ms, c.eviction_interval_ms, uuid.UUID(c.uuid).bytes, c.recover_hot_window)


def decode_metadata(data: bytes) -> Config:
    if len(data) != META.size or META.unpack(data)[:2] != (META_MAGIC, VERSION):
        raise EngineError(Code.CORRUPTION, "metadata")
    _, _, _, dim, dtype, metric, size, cap, window, interval, uid, recover = META.unpack(data)
    return Config(dim, payload_size=size, dtype=Dtype(dtype), metric=Metric(metric), ring_capacity=cap, window_ms=window, eviction_interval_ms=interval, uuid=str(uuid.UUID(bytes=uid)), recover_hot_window=bool(recover))


def export_blocks(rows: DataFrame) -> DataFrame:
    """rows(sensor_id, block_id, pos, ts, vec or q8 and scale[, payload]) -> (sensor_id, block_id, data), a block each.

    Payloads are written if every row of a block has one; they are of one length then.
    """
    import pandas as pd

    int8 = "q8" in rows.columns
    columns = ["sensor_id", "block_id", "pos", "ts", *(["q8", "scale"] if int8 else ["vec"]), *(["payload"] if "payload" in rows.columns else [])]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        payloads = None
        if "payload" in pdf and pdf["payload"].notna().all() and len(pdf["payload"].iloc[0]):
            payloads = np.stack([np.frombuffer(x, np.uint8) for x in pdf["payload"]])
        vectors = np.stack(pdf["q8" if int8 else "vec"].to_list())
        data = encode(Block(pdf["ts"].to_numpy(), vectors, pdf["scale"].to_numpy() if int8 else None, payloads))
        return pd.DataFrame({"sensor_id": [pdf["sensor_id"].iloc[0]], "block_id": [pdf["block_id"].iloc[0]], "data": [data]})

    return rows.select(*columns).groupBy("sensor_id", "block_id").applyInPandas(one, "sensor_id string, block_id long, data binary")


def import_blocks(blocks: DataFrame, columns: Sequence[str] = ("ts", "vec"), skip_corrupt: bool = False) -> DataFrame:
    """blocks(sensor_id, block_id, data) -> (sensor_id, block_id, pos, *columns), a row each.

    columns are of ts, vec (dequantized where a block is INT8), q8, scale and payload; only those are taken out of a
    block.  What a block does not have is null.  A corrupt block raises, or is left out.
    """
    types = {"ts": ("long", pa.int64()), "vec": ("array<float>", pa.list_(pa.float32())), "q8": ("array<tinyint>", pa.list_(pa.int8())), "scale": ("float", pa.float32()), "payload": ("binary", pa.binary())}
    if bad := [c for c in columns if c not in types]:
        raise ValueError(f"no such column: {bad[0]}")

    def lists(m: np.ndarray, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel(), kind))

    def of(b: Block, column: str) -> pa.Array:
        int8 = b.scales is not None
        if column == "ts":
            return pa.array(b.timestamps)
        if column == "vec":
            return lists(b.vectors.astype("f4") * b.scales[:, None] if int8 else b.vectors, pa.float32())
        if column == "q8" and int8:
            return lists(b.vectors, pa.int8())
        if column == "scale" and int8:
            return pa.array(b.scales)
        if column == "payload" and b.payloads is not None:
            return pa.array([x.tobytes() for x in b.payloads], pa.binary())
        return pa.nulls(len(b.timestamps), types[column][1])

    def run(batches):
        for batch in batches:
            for sensor, number, data in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    b = decode(data or b"")
                except EngineError:
                    if skip_corrupt:
                        continue
                    raise
                n = len(b.timestamps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sensor] * n, pa.string()), pa.array([number] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), *[of(b, c) for c in columns]], ["sensor_id", "block_id", "pos", *columns]
                )

    return blocks.select("sensor_id", "block_id", "data").mapInArrow(run, "sensor_id string, block_id long, pos int" + "".join(f", {c} {types[c][0]}" for c in columns))
