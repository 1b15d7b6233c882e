"""Engine configuration: defaults, validation, and the predicates on ids and vectors."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, replace
from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import Code, EngineError

API_VERSION = 1


class Dtype(IntEnum):
    FLOAT32 = 0
    INT8 = 1


class Metric(IntEnum):
    COSINE = 0
    EUCLIDEAN = 1


@dataclass(frozen=True)
class Config:
    """A zero stands for the default, except where zero is meaningful (payload_size, max_sensors)."""

    dim: int
    api_version: int = API_VERSION
    payload_size: int = 0
    dtype: Dtype = Dtype.FLOAT32
    metric: Metric = Metric.COSINE
    ring_capacity: int = 0
    window_ms: int = 0
    eviction_interval_ms: int = 0
    max_sensors: int = 0
    recover_hot_window: bool = False
    uuid: str = ""

    def resolved(self) -> Config:
        """With defaults filled in; raises INVALID_ARG for what is out of range."""
        c = replace(
            self, ring_capacity=self.ring_capacity or 65536, window_ms=self.window_ms or 600_000, eviction_interval_ms=self.eviction_interval_ms or 60_000,
            uuid=self.uuid or str(uuid.uuid4()),
        )
        rules = {
            "api_version": c.api_version == API_VERSION,
            "dim": 1 <= c.dim <= 65536,
            "payload_size": 0 <= c.payload_size <= 4096,
            "dtype": c.dtype in tuple(Dtype),
            "metric": c.metric in tuple(Metric),
            "ring_capacity": c.ring_capacity >= 64 and c.ring_capacity & (c.ring_capacity - 1) == 0,
            "window_ms": c.window_ms >= 0,
            "eviction_interval_ms": c.eviction_interval_ms >= 100,
            "max_sensors": c.max_sensors >= 0,
        }
        for name, ok in rules.items():
            if not ok:
                raise EngineError(Code.INVALID_ARG, name)
        return replace(c, dtype=Dtype(c.dtype), metric=Metric(c.metric))

    def same_schema(self, other: Config) -> bool:
        return all(getattr(self, k) == getattr(other, k) for k in ("dim", "dtype", "metric", "payload_size", "ring_capacity"))

    def as_dict(self) -> dict:
        return asdict(self) | {"dtype": int(self.dtype), "metric": int(self.metric)}

    @property
    def row_bytes(self) -> int:
        """Bytes of one slot of a ring: timestamp, vector, norm, scale, payload."""
        return 8 + self.dim * (1 if self.dtype == Dtype.INT8 else 4) + 4 + (4 if self.dtype == Dtype.INT8 else 0) + self.payload_size


def check_sensor_id(sensor_id: str | None) -> str:
    raw = (sensor_id or "").encode()
    if not 1 <= len(raw) <= 256 or b"\x01" in raw:
        raise EngineError(Code.INVALID_ARG, "sensor_id")
    return sensor_id


def valid_sensor_id(c: Column) -> Column:
    return F.coalesce(F.octet_length(c).between(1, 256) & (F.instr(c, "\x01") == 0), F.lit(False))


def valid_vector(c: Column, dim: int) -> Column:
    """Of length dim, all numbers finite."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(c) == dim) & finite, F.lit(False))
