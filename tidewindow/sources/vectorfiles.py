"""fbin and ibin files: u32 count, u32 dim, then count * dim little-endian float32 or int32."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Code, EngineError


def parse(data: bytes, kind: str) -> np.ndarray:
    if len(data) < 8:
        raise EngineError(Code.CORRUPTION, "too short")
    count, dim = struct.unpack_from("<II", data)
    if len(data) != 8 + 4 * count * dim:
        raise EngineError(Code.CORRUPTION, "size")
    return np.frombuffer(data, kind, offset=8).reshape(count, dim)


def pack(values: np.ndarray, kind: str = "<f4") -> bytes:
    return struct.pack("<II", *values.shape) + np.ascontiguousarray(values, kind).tobytes()


def read(spark: SparkSession, path: str, integers: bool = False) -> DataFrame:
    """(file, row, values) of the files under path, a task per file."""
    kind, item = ("<i4", pa.int32()) if integers else ("<f4", pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                m = parse(data.as_py(), kind)
                for lo in range(0, len(m), 8192):
                    part = m[lo : lo + 8192]
                    offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * m.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(lo, lo + len(part))), pa.ListArray.from_arrays(offsets, pa.array(part.ravel(), item))], ["file", "row", "values"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content"))
    return files.mapInArrow(run, f"file string, row long, values array<{'int' if integers else 'float'}>")
